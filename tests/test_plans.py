"""Physical-plan checks: no cartesian products where an equi key exists,
filters and projections reach the scan, no unpartitioned windows on raw rows."""

from __future__ import annotations

import pytest

from tessera.plans.registry import entries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["undirected_join", "box_range_join", "argmin_per_group", "successor_join",
                                  "transfer_links", "layered_graph", "second_price", "bleu"])
def test_no_cartesian(spark, sf_dir, name):
    p = _plan(entries()[name].fn(spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_filter_pushed_to_scan(spark, sf_dir):
    p = _plan(entries()["filter_range"].fn(spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_projection_pruned(spark, sf_dir):
    p = _plan(entries()["filter_compound"].fn(spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string," \
           "l_linestatus:string>" in p


def test_top_k_is_partial(spark, sf_dir):
    p = _plan(entries()["topn_keys"].fn(spark, sf_dir))
    assert "TakeOrderedAndProject" in p


def test_per_group_limit(spark, sf_dir):
    df = entries()["order_limit_per_group"].fn(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["midranks", "split_by_rank", "next_bid", "rank_sum"])
def test_no_single_partition_window(spark, sf_dir, name):
    """Global ranks and running sums never move raw rows into one partition;
    single-partition exchanges only carry per-bucket totals (one row per
    bucket) or the partial results of a global aggregate."""
    lines = _plan(entries()[name].fn(spark, sf_dir)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1]
            assert "keys=[__scan_bkt" in nxt or "keys=[]" in nxt, "\n".join(lines[i:i + 3])


def test_bounded_broadcast_only(spark, sf_dir):
    from tessera.operators import relational as R
    from tessera.plans.common import tables

    li = tables(spark, sf_dir).lineitem
    top = R.top_n_keys(li, "l_suppkey", 25)
    assert R.max_rows(top) == 25
    assert R.max_rows(li) is None
    hinted = R.bounded_broadcast(li.select("l_suppkey"), 25)
    assert "broadcast" not in hinted._jdf.queryExecution().analyzed().toString().lower()
