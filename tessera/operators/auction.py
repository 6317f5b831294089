"""Second-price auction settlement and per-(bidder, user) bidder state (K1-K4).

A round is a sealed-bid auction: the highest bid wins and pays the second
highest bid (its own bid when it bid alone).  Top-2 per round uses
``row_number() <= 2``, which Spark plans with a partial WindowGroupLimit, so
at most two bids per round per task cross the shuffle even for a huge round.
Bidder running state is a distributed segmented scan (hot keys split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import running_sums


def settle(bids: DataFrame, round_id: str, bidder: str, bid: str, tiebreak: Column | None = None,
           extra: tuple[str, ...] = ()) -> DataFrame:
    """Winner (rank 1) and price (bid at rank 2, or the winner's own bid when
    alone) per round.  ``tiebreak`` orders equal bids (ascending); the default
    is the bidder id, a hash of (round, bidder, seed) gives a reproducible
    uniform random choice."""
    tb = tiebreak if tiebreak is not None else F.col(bidder)
    w = Window.partitionBy(round_id).orderBy(F.desc(bid), tb.asc(), F.asc(bidder), *[F.asc(e) for e in extra])
    top = bids.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2)
    n = bids.groupBy(round_id).agg(F.count(F.lit(1)).alias("n_bids"))
    agg = top.groupBy(round_id).agg(
        F.max(F.when(F.col("__r") == 1, F.struct(*[F.col(c) for c in bids.columns]))).alias("win"),
        F.max(F.when(F.col("__r") == 2, F.col(bid))).alias("second"),
    )
    out = agg.join(n, round_id)
    return out.select(
        round_id, *[F.col("win")[c].alias(c) for c in bids.columns if c != round_id],
        F.coalesce(F.col("second"), F.col("win")[bid]).alias("price"), "n_bids",
    )


def balances(bids: DataFrame, rounds: DataFrame, round_id: str, bidder: str, winner: str, price: str,
             clicked: str) -> DataFrame:
    """Per bidder: sum over won rounds of (clicked - price); bidders that never
    won have 0.  ``disqualified`` marks a balance at or below -1000."""
    won = rounds.select(round_id, F.col(winner).alias(bidder), price, clicked).withColumn("__won", F.lit(True))
    every = bids.select(round_id, bidder).distinct()
    j = every.join(won, [round_id, bidder], "left")
    delta = F.when(F.col("__won"), F.col(clicked).cast("double") - F.col(price)).otherwise(0.0)
    out = j.groupBy(bidder).agg(F.sum(delta).alias("balance"), F.count_if(F.col("__won").isNotNull()).alias("n_wins"),
                               F.count(F.lit(1)).alias("n_rounds"))
    return out.withColumn("disqualified", F.col("balance") <= -1000)


def next_bid_rule(wins: Column, clicks: Column, threshold: Column) -> Column:
    """Bid after an update: 1 with no win yet; 1/(2 wins) while wins are under
    the threshold and nothing was clicked; otherwise the click rate."""
    return (
        F.when(wins == 0, F.lit(1.0))
        .when((wins < threshold) & (clicks == 0), F.lit(1.0) / (F.lit(2.0) * wins))
        .otherwise(clicks / wins)
    )


def bidder_state(log: DataFrame, keys: list[str], order: list[str], won: Column, price: Column, clicked: Column,
                 threshold: Column, first_bid: float = 0.5) -> DataFrame:
    """Running per-key draws, wins, cost (winning prices), cost_seen (every
    price seen), clicks (on won rounds), the bid used in each round and the
    next bid (rounded half-even to 3 decimals, as Python's round)."""
    base = log.select("*", won.cast("int").alias("__won"), price.cast("double").alias("__price"),
                      (clicked & won).cast("int").alias("__click"))
    sums = {
        "draws": F.lit(1).cast("long"),
        "wins": F.col("__won").cast("long"),
        "cost": F.col("__price") * F.col("__won"),
        "cost_seen": F.col("__price"),
        "clicks": F.col("__click").cast("long"),
    }
    s = running_sums(base, keys, order, sums)
    prev_w = F.col("wins") - F.col("__won")
    prev_c = F.col("clicks") - F.col("__click")
    bid = F.when(F.col("draws") == 1, F.lit(first_bid)).otherwise(next_bid_rule(prev_w, prev_c, threshold))
    nxt = next_bid_rule(F.col("wins"), F.col("clicks"), threshold)
    return s.select(
        *[c for c in log.columns], "draws", "wins", "cost", "cost_seen", "clicks",
        F.bround(bid, 3).alias("bid"), F.bround(nxt, 3).alias("next_bid"),
    )
