"""Pairs that share a shard keep states of their own."""

from tessera.session import scratch_path
from tessera.streaming import bidder_stream as BS


def test_shards_hold_pairs_apart(spark):
    rows = [(k, f"2024-01-{1 + k % 9:02d} 00:00:{k % 60:02d}", None if k % 5 == 0 else 2 ** 60 + k % 3, None if k % 7 == 0 else "ab"[k % 2], float(k % 97))
            for k in range(1, 400)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr(
        "event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value")
    src = scratch_path(spark, "events-replay")
    BS.write_replay_files(events, src, 2)

    def run(delay, shards):
        return BS.run_bidder_stream(spark, src, events.schema, 3.0, scratch_path(spark, "sink"), scratch_path(spark, "ckpt"), delay, shards=shards)

    one, many = run("60 days", 1), run("60 days", 500)
    assert one.count() == many.count() == len(rows)
    assert one.exceptAll(many).count() == 0
    by_pair: dict = {}
    for k, t, user, kind, value in rows:
        by_pair.setdefault((kind, user), []).append((t, k, value))
    want = set()
    for (kind, user), log in by_pair.items():
        for n, (_, k, value) in enumerate(sorted(log), start=1):
            want.add((kind, user, k, n, sum(v >= 50 for _, _, v in sorted(log)[:n])))
    assert {(r.event_type, r.user_id, r.event_id, r.draws, r.wins) for r in one.collect()} == want


def test_calls_follow_shards():
    """A shard's rows are applied in one call, its states written once."""
    class State(list):
        puts = 0

        def exists(self):
            return bool(len(self))

        def get(self):
            return iter(list(self))

        def put(self, rows):
            self.puts += 1
            self[:] = rows

    b = BS.Bidder(3.0)
    b.run = State()
    got = b._applied([(5, 2, 60.0, "a", 1), (4, 1, 10.0, "a", 1), (4, 3, 70.0, None, None)])
    assert got[["event_id", "draws", "wins"]].values.tolist() == [[1, 1, 0], [2, 2, 1], [3, 1, 1]]
    got = b._applied([(9, 9, 80.0, "a", 1), (9, 8, 80.0, "b", 1)])
    assert got[["event_id", "draws", "wins"]].values.tolist() == [[9, 3, 2], [8, 1, 1]]
    assert b.run.puts == 2 and {s[:5] for s in b.run} >= {("a", 1, 3, 2, 1.4), (None, None, 1, 1, 0.7)}
