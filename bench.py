"""Benchmark of the headline queries.

Runs each query on the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; every run executes the whole plan into a no-op sink.
One warm-up pass, then the median of $BENCH_REPEATS runs per query.  Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.registry import entries  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "entity_features", "group_mean", "sql_select", "dup_keys", "describe_cols", "undirected_join",
    "box_range_join", "successor_join", "argmin_per_group", "array_map", "layered_graph", "shortest_paths",
    "harmonic_centrality", "second_price", "next_bid", "chunk_fixed", "retrieve_topk", "bleu", "rank_sum",
    "info_gain_all", "rack_score", "missing_profile",
]


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    reg = entries()
    results: dict[str, float] = {}
    for name in names:
        fn = reg[name].fn
        run_once(spark, fn, sf_dir)  # warm-up (JIT, file listing, Python workers)
        times = [run_once(spark, fn, sf_dir) for _ in range(repeats)]
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeats": repeats,
    }))


if __name__ == "__main__":
    main()
