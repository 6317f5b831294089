"""Auction settlement, bidder state and word-rack queries (K1-K4, K6, K7).

Auction log: a round is an order, the user is its customer, every line is a
sealed bid by its supplier for its extended price, and the ad is clicked when
the winning line was returned (flag R).  Bidder log: events keyed by
(event_type as bidder, user_id) in (ts, event_id) order; a round is won when
value >= 50, the price is value / 100 and a won round is clicked when
event_id is a multiple of 3.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tessera.operators import auction as AU
from tessera.operators import words as WD
from tessera.plans.common import tables
from tessera.plans.registry import query

_BIDS_SQL = """(SELECT l.l_orderkey AS round_id, o.o_custkey AS user_id, l.l_suppkey AS bidder_id,
  l.l_extendedprice AS bid, l.l_linenumber AS line, l.l_returnflag AS flag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

_SETTLE_SQL = f"""
WITH b AS {_BIDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY bid DESC, bidder_id, line) AS rn,
             count(*) OVER (PARTITION BY round_id) AS n_bids FROM b),
s AS (SELECT w.round_id, w.user_id, w.bidder_id AS winner, w.bid AS win_bid, coalesce(s.bid, w.bid) AS price,
             w.n_bids, w.flag = 'R' AS clicked
      FROM r w LEFT JOIN r s ON s.round_id = w.round_id AND s.rn = 2 WHERE w.rn = 1)
"""


def bids_df(t):
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_returnflag")
    o = t.orders.select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("round_id"), F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("bidder_id"), F.col("l_extendedprice").alias("bid"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))


def settled(t, tiebreak=None):
    s = AU.settle(bids_df(t), "round_id", "bidder_id", "bid", tiebreak=tiebreak, extra=("line",))
    return s.select("round_id", "user_id", F.col("bidder_id").alias("winner"), F.col("bid").alias("win_bid"),
                    "price", "n_bids", (F.col("flag") == "R").alias("clicked"))


@query("second_price", _SETTLE_SQL + "SELECT * FROM s")
def second_price(spark, sf_dir):
    """Winner, second price and click of every round."""
    return settled(tables(spark, sf_dir))


@query("second_price_tie")
def second_price_tie(spark, sf_dir):
    """Same settlement, ties among top bids broken by a seeded hash of
    (round, bidder): reproducible and uniform over rounds."""
    tb = F.xxhash64(F.col("round_id"), F.col("bidder_id"), F.lit(42))
    return settled(tables(spark, sf_dir), tiebreak=tb)


@query(
    "bidder_balances",
    _SETTLE_SQL
    + """, p AS (SELECT DISTINCT round_id, bidder_id FROM b)
SELECT p.bidder_id, round(sum(CASE WHEN s.winner IS NOT NULL THEN CAST(s.clicked AS INTEGER) - s.price ELSE 0 END), 6)
  AS balance, count(s.winner) AS n_wins, count(*) AS n_rounds,
  sum(CASE WHEN s.winner IS NOT NULL THEN CAST(s.clicked AS INTEGER) - s.price ELSE 0 END) <= -1000 AS disqualified
FROM p LEFT JOIN s ON p.round_id = s.round_id AND p.bidder_id = s.winner GROUP BY p.bidder_id""",
)
def bidder_balances(spark, sf_dir):
    t = tables(spark, sf_dir)
    b = AU.balances(bids_df(t), settled(t), "round_id", "bidder_id", "winner", "price", "clicked")
    return b.select("bidder_id", F.round("balance", 6).alias("balance"), "n_wins", "n_rounds", "disqualified")


def _rule_sql(w: str, c: str) -> str:
    return f"CASE WHEN {w} = 0 THEN 1.0 WHEN {w} < g.thr AND {c} = 0 THEN 1.0 / (2.0 * {w}) ELSE {c} / {w} END"


@query(
    "next_bid",
    f"""
WITH g AS (SELECT count(*) / count(DISTINCT user_id) / 10.0 AS thr FROM events),
e AS (SELECT event_type, user_id, event_id, ts, CAST(value >= 50 AS INTEGER) AS won, value / 100 AS price,
             CAST(event_id % 3 = 0 AND value >= 50 AS INTEGER) AS click FROM events),
s AS (SELECT *, count(*) OVER w AS draws, sum(won) OVER w AS wins, sum(price * won) OVER w AS cost,
             sum(price) OVER w AS cost_seen, sum(click) OVER w AS clicks FROM e
      WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, user_id, event_id, ts, draws, CAST(wins AS BIGINT) AS wins, round(cost, 6) AS cost,
  round(cost_seen, 6) AS cost_seen, CAST(clicks AS BIGINT) AS clicks,
  round_even(CASE WHEN draws = 1 THEN 0.5 ELSE {_rule_sql('(wins - won)', '(clicks - click)')} END, 3) AS bid,
  round_even({_rule_sql('wins', 'clicks')}, 3) AS next_bid
FROM s CROSS JOIN g
""",
)
def next_bid(spark, sf_dir):
    """Running per-(bidder, user) state and the bid rule after every round."""
    ev = tables(spark, sf_dir).events.select("event_type", "user_id", "event_id", "ts", "value")
    thr = ev.agg(F.count(F.lit(1)) / F.countDistinct("user_id") / F.lit(10.0)).scalar()
    st = AU.bidder_state(ev, ["event_type", "user_id"], ["ts", "event_id"], won=F.col("value") >= 50,
                         price=F.col("value") / 100, clicked=(F.col("event_id") % 3) == 0, threshold=thr)
    return st.select("event_type", "user_id", "event_id", "ts", "draws", "wins", F.round("cost", 6).alias("cost"),
                     F.round("cost_seen", 6).alias("cost_seen"), "clicks", "bid", "next_bid")


# ------------------------------------------------------------------ word rack
RACK = "tearing"
WILDCARDS = 1


def words_df(t):
    parts = WD.ascii_words(t.part, "p_name")
    docs = WD.ascii_words(t.documents, "text")
    return parts.unionByName(docs).distinct()


_WORDS_SQL = """(SELECT DISTINCT w AS word FROM (
  SELECT unnest(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+')) AS w FROM part
  UNION ALL SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) FROM documents)
  WHERE regexp_full_match(w, '[a-z]+'))"""


def _cnt_sql(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, '{ch}', '')))"


def _rack_case(ch_expr: str) -> str:
    rc = {c: RACK.count(c) for c in set(RACK)}
    return "CASE " + ch_expr + " " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in sorted(rc.items())) + " ELSE 0 END"


_PLAYABLE_SQL = (
    f"length(word) <= {len(RACK) + WILDCARDS} AND ("
    + " + ".join(f"greatest({_cnt_sql('word', c)} - {RACK.count(c)}, 0)" for c in string.ascii_lowercase)
    + f") <= {WILDCARDS}"
)
_WILD_SQL = (
    "array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN "
    "(length(substring(word, 1, i)) - length(replace(substring(word, 1, i), substring(word, i, 1), ''))) > "
    + _rack_case("substring(word, i, 1)")
    + " THEN substring(word, i, 1) ELSE '' END), '')"
)


@query("rack_match", f"SELECT word, {_WILD_SQL} AS wild_letters FROM {_WORDS_SQL} w WHERE {_PLAYABLE_SQL}")
def rack_match(spark, sf_dir):
    """Words playable from the rack with the wildcard count, and the letters
    the wildcards stand for."""
    w = words_df(tables(spark, sf_dir))
    return w.where(WD.playable("word", RACK, WILDCARDS)).select("word", WD.wildcard_letters("word", RACK).alias(
        "wild_letters"))


@query(
    "rack_score",
    "SELECT word, CAST("
    + " + ".join(f"least({_cnt_sql('word', c)}, {RACK.count(c)}) * {WD.LETTER_VALUES[c]}" for c in sorted(set(RACK)))
    + f" AS INTEGER) AS score FROM {_WORDS_SQL} w WHERE {_PLAYABLE_SQL}",
)
def rack_score(spark, sf_dir):
    w = words_df(tables(spark, sf_dir))
    return w.where(WD.playable("word", RACK, WILDCARDS)).select("word", WD.score("word", RACK).alias("score"))
