"""Bidder state as a stateful stream (K5).

``transformWithStateInPandas`` keeps per shard of the (bidder, user) pairs their
running (draws, wins, cost, cost_seen, clicks) and a list of the rows that the
watermark has not passed yet.  An event-time timer per shard fires when it has;
the rows below the watermark are then taken pair by pair in (ts, event_id)
order, applied and emitted.  Rows may thus arrive in any order within the
watermark's delay, over any number of micro-batches, and give exactly the batch
result of :func:`tessera.operators.auction.bidder_state`; later ones are dropped
by the watermark.  Every call for a group and every access to its state costs
the same whatever it holds, so pairs share them by the shard; memory per shard
is its rows of one delay, and the number of shards grows with the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAIR = [T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType())]
STATE_SCHEMA = T.StructType(PAIR + [
    T.StructField("draws", T.LongType()), T.StructField("wins", T.LongType()),
    T.StructField("cost", T.DoubleType()), T.StructField("cost_seen", T.DoubleType()),
    T.StructField("clicks", T.LongType()),
])

OUT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("draws", T.LongType()), T.StructField("wins", T.LongType()),
    T.StructField("cost", T.DoubleType()), T.StructField("cost_seen", T.DoubleType()),
    T.StructField("clicks", T.LongType()), T.StructField("bid", T.DoubleType()),
    T.StructField("next_bid", T.DoubleType()),
])


def _round_half_even(x: float, digits: int = 3) -> float:
    from decimal import ROUND_HALF_EVEN, Decimal

    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


PENDING_SCHEMA = T.StructType([
    T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), *PAIR,
])


def _rounded(x: np.ndarray) -> np.ndarray:
    values, where = np.unique(x, return_inverse=True)
    return np.array([_round_half_even(v) for v in values])[where]


class Bidder(StatefulProcessor):
    """Running states and rows in waiting of one shard of (event_type, user_id)."""

    def __init__(self, threshold: float, first_bid: float = 0.5):
        self.threshold, self.first_bid = threshold, first_bid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getListState("run", STATE_SCHEMA)
        self.waiting = handle.getListState("waiting", PENDING_SCHEMA)
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[part["known"]]
            if not len(part):
                continue
            micros = part["micros"].to_numpy()
            users = [None if none else u for u, none in zip(part["user"].tolist(), part["no_user"].tolist())]
            self.waiting.appendList(list(zip(micros.tolist(), part["id"].tolist(), part["value"].tolist(), part["event_type"].tolist(), users)))
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            self._wake(first // 1000 + 1)
        yield from ()

    def _wake(self, ms: int) -> None:
        """One timer per shard, at the earliest row in waiting."""
        if self.due.exists():
            known = self.due.get()[0]
            if known <= ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for r in self.waiting.get():
            (ready if r[0] < limit else rest).append(tuple(r))
        self.due.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            yield self._applied(ready)

    def _rule(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(w == 0, 1.0, np.where((w < self.threshold) & (c == 0), 1.0 / (2.0 * w), c / w))

    def _applied(self, ready: list) -> pd.DataFrame:
        states = {tuple(r)[:2]: tuple(r)[2:] for r in self.run.get()} if self.run.exists() else {}
        by_pair: dict = {}
        for micros, event_id, value, kind, user in ready:
            by_pair.setdefault((kind, user), []).append((micros, event_id, value))
        parts = []
        for pair, rows in by_pair.items():
            states[pair], columns = self._pair(states.get(pair, (0, 0, 0.0, 0.0, 0)), sorted(rows))
            parts.append(columns)
        self.run.put([pair + state for pair, state in states.items()])
        size = [len(c[0]) for c in parts]
        micros, event_id, draws, wins, cost, seen, clicks, bid, next_bid = (np.concatenate(c) for c in zip(*parts))
        kinds, users = ([x for pair, n in zip(by_pair, size) for x in [pair[k]] * n] for k in (0, 1))
        return pd.DataFrame({
            "event_type": pd.Series(kinds, dtype=object), "user_id": pd.array(users, dtype="Int64"), "event_id": event_id,
            "ts": pd.to_datetime(micros, unit="us"), "draws": draws, "wins": wins, "cost": cost, "cost_seen": seen, "clicks": clicks,
            "bid": _rounded(bid), "next_bid": _rounded(next_bid),
        })

    def _pair(self, state: tuple, ready: list) -> tuple[tuple, tuple]:
        """The rows of one pair, in order, applied to its state: the new state
        and the columns of the rows."""
        draws0, wins0, cost0, seen0, clicks0 = state
        micros, event_id, value = (np.array(c) for c in zip(*ready))
        won = (value >= 50).astype(np.int64)
        price = value / 100
        click = ((value >= 50) & (event_id % 3 == 0)).astype(np.int64)
        draws = draws0 + np.arange(1, len(ready) + 1)
        wins, clicks = wins0 + np.cumsum(won), clicks0 + np.cumsum(click)
        cost, seen = cost0 + np.cumsum(price * won), seen0 + np.cumsum(price)
        bid = np.where(draws == 1, self.first_bid, self._rule(wins - won, clicks - click))
        after = (int(draws[-1]), int(wins[-1]), float(cost[-1]), float(seen[-1]), int(clicks[-1]))
        return after, (micros, event_id, draws, wins, cost, seen, clicks, bid, self._rule(wins, clicks))

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_bidder_stream(spark: SparkSession, source_dir: str, schema: T.StructType, threshold: float,
                      sink_dir: str, checkpoint_dir: str, delay: str, max_files_per_trigger: int = 1,
                      shards: int = 64) -> DataFrame:
    """Replay a folder of event files through the stateful query
    (``availableNow``), write the per-event output to ``sink_dir`` and return
    it as a batch DataFrame.  ``delay`` is how far a row may come behind the
    latest one; rows without an event_id only move the watermark (a filter
    would be pushed below it).  Take ``shards`` so that one holds some thousands
    of the rows of a delay."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    events = events.select(
        F.pmod(F.xxhash64("event_type", "user_id"), F.lit(shards)).alias("shard"), "event_type",
        F.coalesce("user_id", F.lit(0)).alias("user"), F.col("user_id").isNull().alias("no_user"),
        F.coalesce("event_id", F.lit(0)).alias("id"), F.col("event_id").isNotNull().alias("known"),
        F.col("ts").cast("timestamp").alias("at"), "value")
    events = events.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    out = events.groupBy("shard").transformWithStateInPandas(
        Bidder(threshold), OUT_SCHEMA, "Append", "EventTime")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # timers and lists need it; read when the query starts
    try:
        q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return spark.read.schema(OUT_SCHEMA).parquet(sink_dir)


def write_replay_files(events: DataFrame, path: str, n_files: int) -> None:
    """Write a log as files that are shuffled in time: every row lands in a
    file by a hash, so each file spans the whole log.  Two last files close the
    log with one row of no event_id each, a year and more behind the last: the
    first moves the watermark, the second brings the batch that sees it."""
    events.repartition(n_files, F.xxhash64("event_id")).write.mode("overwrite").parquet(path)
    for days in (366, 367):
        last = events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
        last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.mode(
            "append").parquet(path)
