"""Graph analytics on ``vertices(id, ...)`` / ``edges(src, dst, weight)``
DataFrames (G*).

Iterative algorithms run as a driver loop of DataFrame jobs.  Each iteration
is a join of the frontier with the edges plus an aggregate; the state is cut
from its lineage by writing it as a table in the shared folder named by
``spark.checkpoint.dir`` and reading it back, so a lost executor recomputes
at most one iteration.  The only value brought to the driver per iteration is a count.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.operators.scan import global_row_number
from tessera.session import scratch_path


def _cut(df: DataFrame) -> DataFrame:
    """Materialise iteration state as a Parquet table in the shared scratch
    folder and read it back.  Unlike ``checkpoint()``, whose result keeps a
    reference to the plan it came from (for statistics and constraints), the
    re-read table starts a fresh plan, so planning time does not grow with the
    number of iterations."""
    spark = df.sparkSession
    path = scratch_path(spark, "iter")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ building
def two_way(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a pair present twice keeps its
    smallest weight (loading both ways never doubles an edge)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(rev).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def resolve_edges(named: DataFrame, vertices: DataFrame, src_name="src_name", dst_name="dst_name",
                  vid="id", vname="name") -> DataFrame:
    """Attach vertex ids to edges given by names; unknown names drop the edge."""
    a = vertices.select(F.col(vid).alias("src"), F.col(vname).alias("__sn"))
    b = vertices.select(F.col(vid).alias("dst"), F.col(vname).alias("__dn"))
    return (
        named.join(a, named[src_name] == a["__sn"]).join(b, named[dst_name] == b["__dn"])
        .drop("__sn", "__dn", src_name, dst_name)
    )


def induced_subgraph(edges: DataFrame, membership: DataFrame, node="node", community="community") -> DataFrame:
    """Edges whose two endpoints are in the same community, for all
    communities at once (two equi joins and a filter)."""
    ms = membership.select(F.col(node).alias("src"), F.col(community).alias("__cs"))
    md = membership.select(F.col(node).alias("dst"), F.col(community).alias("__cd"))
    j = edges.join(ms, "src").join(md, "dst")
    return j.where(F.col("__cs") == F.col("__cd")).select("src", "dst", "weight", F.col("__cs").alias(community))


def transit_edges(stops: DataFrame, stations: DataFrame, travel: DataFrame) -> DataFrame:
    """Layered transit graph from ``stops(line, seq, station)``,
    ``stations(station, transfer_time)`` and undirected
    ``travel(station_1, station_2, travel_time)``.

    Nodes: ``depart S``, ``arrive S``, ``L S`` (line L at station S) and
    ``transfer S``.  Edges: depart -> line node and line node -> arrive (0),
    line node -> transfer (transfer time) and transfer -> line node (0) at
    stations served by two or more lines (hub form of the pairwise transfer
    join: same shortest paths, linear size), and both directions of every
    segment between consecutive stops with its travel time (looked up on the
    unordered station pair).
    """
    from tessera.operators import relational as R

    def node(line, station):
        return F.concat_ws(" ", line.cast("string"), station.cast("string"))

    def both(df, there, back):
        """Two edges of every row."""
        ends = [F.struct(a.alias("src"), b.alias("dst"), w.cast("long").alias("weight")) for a, b, w in (there, back)]
        return df.select(F.inline(F.array(*ends)))

    zero = F.lit(0)
    st = stops.select("line", "station").distinct()
    here, name = node(F.col("line"), F.col("station")), F.col("station").cast("string")
    doors = both(st, (F.concat(F.lit("depart "), name), here, zero), (here, F.concat(F.lit("arrive "), name), zero))
    hub = F.concat(F.lit("transfer "), name)
    changes = both(R.transfer_links(st, stations), (here, hub, F.col("transfer_time")), (hub, here, zero))
    seg = R.successor_join(stops).where(F.col("from_station") != F.col("to_station")).select(
        "line", F.col("from_station").alias("a"), F.col("to_station").alias("b"))
    a, b, time = node(F.col("line"), F.col("a")), node(F.col("line"), F.col("b")), F.col("travel_time")
    return doors.unionByName(changes).unionByName(both(R.undirected_join(seg, travel), (a, b, time), (b, a, time)))


# ------------------------------------------------------------------ shortest paths
class _Bucketed:
    """A table whose rows stay dealt by a key, so that joins and aggregates on
    it move only the other side.  Rows may be added, also from what was read
    of it; ``drop`` forgets it."""

    def __init__(self, df: DataFrame, *key: str, parts: int = 0, by: tuple[str, ...] = (), dealt: bool = False):
        self.spark, self.key, self.by = df.sparkSession, key, by
        self.parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"tessera_{uuid.uuid4().hex}"
        self.add(df, dealt=dealt, path=scratch_path(self.spark, "bucketed"))

    def add(self, df: DataFrame, dealt: bool = False, **options) -> None:
        """``dealt``: the rows lie dealt by the key already."""
        rows = df if dealt else df.repartition(self.parts, *self.key)
        out = rows.write.mode("append").bucketBy(self.parts, *self.key).options(**options)
        (out.partitionBy(*self.by) if self.by else out).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


_PART_EDGES = 2_000_000  # edges of a block
_SLOTS = 8_000_000  # pairs of a source and a node that a block may hold at once
_STEP = 4_000_000  # edges of a block that are followed at a time
_FOLD = 16  # rounds whose changes are kept apart
_ROWS = 1 << 16  # rows of a batch sent to Spark
_RANK_BITS = 40
_NO_RANK = (1 << _RANK_BITS) - 1  # of a source, with no hops
_FAR = np.iinfo("i8").max
_MAIL = ("i8", "f8", "i8", "i4")  # key of the node, cost, tie, source; tie: hops, then rank of the predecessor
_CHANGE = ("i8", "f8", "i8", "?")  # slot, cost, tie, open
_GRAPH = pa.schema({"block": pa.int64(), "n": pa.int64(), "wide": pa.int64(), "clash": pa.bool_()} | dict.fromkeys(
    ("nodes", "ranks", "ends", "at", "weight", "weights", "ports", "bounds", "names"), pa.binary()))
_ROUND = pa.schema({"block": pa.int64(), "nth": pa.int32(), "mail": pa.bool_(), "to": pa.int64(), "least": pa.float64(), "what": pa.binary()})


def _key(name: Column, salt: int, parts: int, place) -> Column:
    """63 bits that stand for a node in the search; modulo ``parts`` they are its block."""
    own = F.shiftright(F.xxhash64(F.lit(salt), name), 1)
    return own - F.pmod(own, F.lit(parts)) + F.pmod(F.xxhash64(place(name)), F.lit(parts))


def _packed(kinds: tuple[str, ...], columns) -> bytes:
    return b"".join(np.ascontiguousarray(c, k).tobytes() for k, c in zip(kinds, columns))


def _unpacked(kinds: tuple[str, ...], what: bytes) -> list[np.ndarray]:
    size = [np.dtype(k).itemsize for k in kinds]
    n = len(what) // sum(size)
    return [np.frombuffer(what, k, n, n * sum(size[:i])) for i, k in enumerate(kinds)]


def _homes(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` blocks; rows dealt by these numbers to
    as many partitions come to lie evenly."""
    dealt = spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in dealt.collect()}
    return [found.get(i, 32 * parts + i) for i in range(parts)]


def _block_rows(batches, homes: list[int]):
    """One row per block of the graph from the rows of its nodes (no weight;
    key, rank, second hash, name) and of the edges that start in it (keys of
    both ends, second hash of the start, weight).  Edges that start at no node
    of the block are dropped: nothing leads to their start."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    whole = pa.Table.from_batches(batches)
    blocks = whole["a"].to_numpy() % len(homes)
    for block in np.unique(blocks):
        rows = whole.filter(pa.array(blocks == block))
        is_node = rows["weight"].is_null()
        nodes, edges = rows.filter(is_node), rows.filter(pc.invert(is_node))
        order = np.argsort(nodes["a"].to_numpy())
        key, ranks, check = (nodes[c].to_numpy()[order] for c in ("a", "b", "c"))
        names = nodes["name"].combine_chunks().take(pa.array(order))
        src, dst, own, weight = (edges[c].to_numpy() for c in ("a", "b", "c", "weight"))
        start = np.searchsorted(key, src)
        start[start == len(key)] = 0
        known = (key[start] == src) & (check[start] == own) if len(key) else np.zeros(len(src), bool)
        start, dst, weight = start[known], dst[known], weight[known]
        order = np.argsort(start, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(key)))])
        ports, at = np.unique(dst[order], return_inverse=True)
        to = ports % len(homes)
        by = np.argsort(to, kind="stable")
        place = np.empty(len(by), "i4")
        place[by] = np.arange(len(by))
        bounds = np.searchsorted(to[by], np.arange(len(homes) + 1))
        weights, weight = np.unique(weight[order], return_inverse=True)  # mostly few: a byte tells which
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([names], ["name"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        row = {"block": homes[block], "n": len(key), "wide": max(len(key), len(ports)), "clash": bool((key[1:] == key[:-1]).any())}
        columns = {"nodes": key, "ranks": ranks, "ends": ends.astype("i8"), "at": place[at].astype("i4"),
                   "weight": weight.astype(np.min_scalar_type(len(weights))), "weights": weights, "ports": ports[by], "bounds": bounds.astype("i8")}
        row |= {k: c.tobytes() for k, c in columns.items()} | {"names": sink.getvalue().to_pybytes()}
        yield pa.RecordBatch.from_pylist([row], schema=_GRAPH)


def _lower(cost: np.ndarray, tie: np.ndarray, slots: np.ndarray, c: np.ndarray, t: np.ndarray) -> None:
    """Puts in place the least (cost, tie) of every slot."""
    was = cost.copy()
    np.minimum.at(cost, slots, c)
    tie[cost < was] = _FAR
    least = c == cost[slots]
    np.minimum.at(tie, slots[least], t[least])


def _state(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, tie and what is open, of every slot (node, source) of a block,
    from the changes of all rounds."""
    cost, tie, is_open = np.full(row["n"] * k, np.inf), np.full(row["n"] * k, _FAR), np.zeros(row["n"] * k, bool)
    for change in sorted(row["log"] or [], key=lambda r: r["nth"]):
        slot, c, t, o = _unpacked(_CHANGE, change["what"])
        cost[slot], tie[slot], is_open[slot] = c, t, o
    return cost, tie, is_open


def _follow(row: dict, k: int, cost: np.ndarray, tie: np.ndarray, slots: np.ndarray, out: tuple[np.ndarray, np.ndarray]) -> None:
    """Puts into ``out`` the least (cost, tie) at the ends of the edges from
    ``slots``, by the place of the end in ``ports`` and the source."""
    ends, at, weights, ranks = (np.frombuffer(row[c], t) for c, t in (("ends", "i8"), ("at", "i4"), ("weights", "f8"), ("ranks", "i8")))
    weight = np.frombuffer(row["weight"], f"u{len(row['weight']) // max(len(at), 1) or 1}")
    node = slots // k
    first, many = ends[node], ends[node + 1] - ends[node]
    upto = np.cumsum(many)
    ties = ((tie[slots] >> _RANK_BITS) + 1) << _RANK_BITS | ranks[node]
    cuts = [0, *np.searchsorted(upto, np.arange(_STEP, upto[-1], _STEP), "right"), len(slots)]
    for a, b in itertools.pairwise(cuts):
        n = many[a:b]
        edge = np.arange(n.sum()) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
        to = at[edge].astype("i8")
        to *= k
        to += np.repeat(slots[a:b] % k, n)
        _lower(*out, to, np.repeat(cost[slots[a:b]], n) + weights[weight[edge]], np.repeat(ties[a:b], n))


def _round_rows(batches, k: int, nth: int, end: float, homes: list[int], fold: bool, stay: bool):
    """A round in every block: takes its mail, follows the edges of what is open
    below ``end`` (``stay``: on and on, as long as they end in the block),
    returns what changed (``fold``: all) and mail to blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            cost, tie, is_open = _state(row, k)
            changed = np.isfinite(cost) if fold else np.zeros(len(cost), bool)
            nodes, ports, bounds = (np.frombuffer(row[c], "i8") for c in ("nodes", "ports", "bounds"))
            me = homes.index(row["block"])
            here = slice(bounds[me] * k, bounds[me + 1] * k) if stay else slice(0)  # ends in this block
            home_slots = (np.searchsorted(nodes, ports[bounds[me]:bounds[me + 1]])[:, None] * k + np.arange(k)).ravel() if stay else np.zeros(0, "i8")

            def take(slots, c, t):
                was, useful = (cost.copy(), tie.copy()), c <= cost[slots]
                _lower(cost, tie, slots[useful], c[useful], t[useful])
                np.logical_or(is_open, (cost < was[0]) | (tie >> _RANK_BITS < was[1] >> _RANK_BITS), out=is_open)
                np.logical_or(changed, (cost < was[0]) | (tie < was[1]), out=changed)

            if row["mail"]:
                key, c, t, s = (np.concatenate(x) for x in zip(*(_unpacked(_MAIL, m) for m in row["mail"])))
                take(np.searchsorted(nodes, key) * k + s, c, t)
            out = np.full(len(ports) * k, np.inf), np.full(len(ports) * k, _FAR)
            while len(now := np.flatnonzero(is_open & (cost < end))):
                is_open[now], changed[now] = False, True
                _follow(row, k, cost, tie, now, out)
                if not stay:
                    break
                take(home_slots, out[0][here], out[1][here])
            out[0][here] = np.inf
            slot, left = np.flatnonzero(changed), cost[is_open]
            rows = [{"mail": False, "to": None, "least": left.min() if len(left) else None,
                     "what": _packed(_CHANGE, (slot, cost[slot], tie[slot], is_open[slot]))}] if len(slot) or len(left) else []
            reached = np.flatnonzero(np.isfinite(out[0]))
            cuts = np.searchsorted(reached, bounds * k)
            for home, a, b in zip(homes, cuts, cuts[1:]):
                if a < b:
                    x = reached[a:b]
                    rows.append({"mail": True, "to": home, "least": out[0][x].min(), "what": _packed(_MAIL, (ports[x // k], out[0][x], out[1][x], x % k))})
            if rows:
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "nth": nth} | r for r in rows], schema=_ROUND)


def _found_rows(batches, k: int, first: int):
    """(source's number, node, cost, hops, pred's rank) of all that was reached in a block."""
    for batch in batches:
        for row in batch.to_pylist():
            cost, tie, _ = _state(row, k)
            with pa.ipc.open_stream(row["names"]) as read:
                names = read.read_next_batch()["name"]
            slots = np.flatnonzero(np.isfinite(cost))
            for a in range(0, len(slots), _ROWS):
                s = slots[a:a + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + s % k), names.take(pa.array(s // k)), pa.array(cost[s]), pa.array((tie[s] >> _RANK_BITS).astype("i4")), pa.array(tie[s] & _NO_RANK)],
                    ["nth", "node", "cost", "hops", "rank"])


def shortest_paths(edges: DataFrame, sources: DataFrame, delta: float | None = None, place=None) -> DataFrame:
    """Single- or multi-source weighted shortest paths by delta-stepping
    (Meyer and Sanders 2003).

    ``sources`` has a column ``id``.  Returns (source, node, cost, hops, pred)
    for every reachable node; unreachable nodes have no row (never cost 0).
    Ties on cost prefer fewer hops, then the smaller predecessor, which is a
    total order, so the result is deterministic and predecessor cycles cannot
    form even with zero-weight edges.

    Costs are settled in buckets of width ``delta`` (four times the mean
    positive weight): a round follows the edges of what got cheaper below the
    end of the bucket, until nothing there does.  A node goes by a 64-bit key
    (tested for clashes) and its rank among the names.  Nodes with the edges
    that start there lie in blocks, one row of packed arrays each, dealt by
    their block, as do the distances found: a round brings to each block the
    least costs that other blocks offer its nodes and adds what changed, so
    it moves neither edges nor distances.  Blocks grow in number with the
    edges; sources beyond what a block may hold are searched in turn.

    ``place`` makes a column from a node's: nodes of one value share a block,
    and within a round ways are followed on inside it.  It changes the number
    of rounds and what is moved, not the result.
    """
    spark, kind = edges.sparkSession, sources.schema["id"].dataType
    e, d = _cut(edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("weight").cast("double").alias("weight"))
                .where("src IS NOT NULL AND weight IS NOT NULL")), F.col("weight")
    n, low, top, mean = e.agg(F.count(F.lit(1)), F.min(d), F.max(d), F.avg(F.when(d > 0, d))).first()
    if low is not None and low < 0:
        raise ValueError("negative edge weights are not supported")
    delta = float(delta or 4 * (mean or 1.0))
    parts = n // _PART_EDGES + 1
    homes = _homes(spark, parts)
    starts = _cut(sources.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("mark")))
    starts = _cut(global_row_number(starts, ["mark"], "nth").select("id", (F.col("nth") - 1).alias("nth")))
    everything = e.select(F.col("dst").alias("name")).unionByName(starts.select(F.col("id").alias("name"))).distinct()
    # sorted parts, numbered in their order: the part in the upper bits, the row in the lower 33
    names = _cut(everything.repartitionByRange(parts, "name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("mark")))
    part, row = F.shiftright("mark", 33), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    longest, last_part = names.agg(F.max(row), F.max(part)).first()
    if ((last_part or 0) + 1) * ((longest or 0) + 1) >= _NO_RANK:
        raise ValueError("too many nodes")
    names = names.select("name", (part * F.lit((longest or 0) + 1) + row).alias("rank"))

    def key_of(name: Column) -> Column:
        return _key(name, salt, parts, place or (lambda c: c))

    def home(key: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, homes)), (F.pmod(key, F.lit(parts)) + 1).cast("int"))

    def blocks() -> tuple[_Bucketed, int]:
        """The graph in blocks, and the most nodes or ends of edges in one (0: two nodes have one key)."""
        nodes = names.select(key_of(F.col("name")).alias("a"), F.col("rank").alias("b"), F.hash("name").alias("c"), F.lit(None).cast("double").alias("weight"), "name")
        lines = e.select(key_of(F.col("src")).alias("a"), key_of(F.col("dst")).alias("b"), F.hash("src").alias("c"), "weight", F.lit(None).cast(kind).alias("name"))
        rows = nodes.unionByName(lines).repartition(parts, home(F.col("a")))
        seen = Observation()
        packed = rows.mapInArrow(functools.partial(_block_rows, homes=homes), from_arrow_schema(_GRAPH)).observe(seen, F.max("wide").alias("wide"), F.bool_or("clash").alias("clash"))
        graph = _Bucketed(packed, "block", parts=parts, dealt=True)
        return graph, 0 if seen.get["clash"] else seen.get["wide"] or 1

    for salt in itertools.count():
        graph, wide = blocks()
        if wide:
            break
        graph.drop()

    def search(first: int, k: int) -> DataFrame:
        """From the sources numbered ``first`` and up, ``k`` of them."""
        def mail(batches):
            for batch in batches:
                key, to, s = (batch.column(c).to_numpy() for c in ("key", "to", "s"))
                rows = [{"block": int(h), "nth": 0, "mail": True, "to": int(h), "least": 0.0, "what": _packed(
                    _MAIL, (key[to == h], np.zeros((to == h).sum()), np.full((to == h).sum(), _NO_RANK), s[to == h]))} for h in np.unique(to)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ROUND)

        key = key_of(F.col("id"))
        begin = starts.where((F.col("nth") >= first) & (F.col("nth") < first + k)).select(key.alias("key"), home(key).alias("to"), (F.col("nth") - first).alias("s"))
        log, last = _Bucketed(begin.mapInArrow(mail, from_arrow_schema(_ROUND)), "block", parts=parts, by=("nth", "mail")), None
        try:
            def states() -> DataFrame:
                changes = log.read().where(~F.col("mail")).groupBy("block").agg(F.collect_list(F.struct("nth", "what")).alias("log"))
                return changes.hint("shuffle_hash")

            least = 0.0
            for nth in itertools.count(1):
                mails = log.read().where(F.col("mail") & (F.col("nth") == nth - 1)).select(F.col("to").alias("block"), "what")
                mails = mails.repartition(parts, "block").groupBy("block").agg(F.collect_list("what").alias("mail"))
                work = graph.read().drop("names").join(states(), "block", "left").join(mails.hint("shuffle_hash"), "block", "left")
                step, seen = functools.partial(_round_rows, k=k, nth=nth, end=(least // delta + 1) * delta, homes=homes, fold=nth % _FOLD == 0, stay=place is not None), Observation()
                out = work.mapInArrow(step, from_arrow_schema(_ROUND)).observe(seen, F.min("least").alias("least"))
                if nth % _FOLD:
                    log.add(out, dealt=True)
                else:
                    last, log = log, _Bucketed(out, "block", parts=parts, by=log.by, dealt=True)
                    last.drop()
                least = seen.get["least"]
                if least is None:
                    break
            kinds = T.StructType().add("nth", "long").add("node", kind).add("cost", "double").add("hops", "integer").add("rank", "long")
            held = graph.read().select("block", "n", "names").join(states(), "block")
            return _cut(held.mapInArrow(functools.partial(_found_rows, k=k, first=first), kinds))
        finally:
            log.drop()

    try:
        k, total = max(1, _SLOTS // wide), starts.count()
        found = [search(first, min(k, total - first)) for first in range(0, max(total, 1), k)]
    finally:
        graph.drop()
    # names come back by left joins with one row a key, which a query that asks for no names leaves out
    pred = names.select("rank", F.col("name").alias("pred")).repartition(parts, "rank").hint("shuffle_hash")
    every = functools.reduce(DataFrame.unionByName, found).repartition(parts, "rank").join(pred, "rank", "left")
    return every.join(starts.select("nth", F.col("id").alias("source")), "nth", "left").select("source", "node", "cost", "hops", "pred")


_LEVELS = 100  # hops up to which every task may write rows of each


def _by_hops(dist: DataFrame, targets: DataFrame | None, start: dict, step: dict, values: DataFrame | None = None) -> DataFrame:
    """Columns gathered along the chosen paths: ``start`` says what they are at
    a source, ``step`` how they follow from those of the predecessor (``p_*``).

    A predecessor lies one hop nearer, so the nodes are taken hop by hop, those
    of one hop joined with those of the hop before: every row is joined once.
    With ``targets`` (column ``id``) only nodes on the way to one are
    taken, marked hop by hop from the farthest, and ``values`` (node, value; 0
    where missing) are looked up for these alone.  Rounds: twice the hops of the
    longest path.
    """
    def valued(df: DataFrame, known: DataFrame) -> DataFrame:
        return df.join(known.select("node", "value"), "node", "left").withColumn("value", F.coalesce("value", F.lit(0)))

    spark, far, levels = dist.sparkSession, dist.agg(F.max("hops")).first()[0], []
    if far is None:
        return (dist if values is None else valued(dist, values)).select("source", "node", *[c.alias(k) for k, c in start.items()])
    path = scratch_path(spark, "hops")
    if values is not None and targets is None:
        dist = valued(dist, values)
    (dist if far < _LEVELS else dist.repartition("hops", F.pmod(F.hash("node"), F.lit(8)))).write.partitionBy("hops").parquet(path)
    spread = spark.read.schema(dist.schema).parquet(path)
    at = [spread.where(F.col("hops") == h) for h in range(far + 1)]
    if targets is not None:
        ends = targets.select(F.col("id").alias("node")).distinct()
        for h in range(far, -1, -1):
            on_way = at[h].select("source", "node").join(ends, "node").select("source", "node")
            if h < far:
                on_way = on_way.unionByName(at[h + 1].select("source", F.col("pred").alias("node"))).distinct()
            at[h] = _cut(at[h].join(on_way, ["source", "node"]))
        if values is not None:
            passed = functools.reduce(DataFrame.unionByName, [level.select("node") for level in at]).distinct()
            known = _cut(values.join(passed, "node", "left_semi"))
            at = [valued(level, known) for level in at]
    for h, level in enumerate(at):
        if h:
            near = levels[-1].select("source", F.col("node").alias("pred"), *[F.col(k).alias(f"p_{k}") for k in step])
            got = level.join(near, ["source", "pred"]).select("source", "node", *[c.alias(k) for k, c in step.items()])
        else:
            got = level.select("source", "node", *[c.alias(k) for k, c in start.items()])
        levels.append(_cut(got))
    found = functools.reduce(DataFrame.unionByName, levels)
    return found if targets is None else found.join(ends, "node")


def paths_to(dist: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Node list and cumulative costs of the chosen path to every node in
    ``dist``, or to the ``targets`` (column ``id``) alone."""
    own = {"nodes": F.array("node"), "costs": F.array("cost")}
    found = _by_hops(dist, targets, own, {k: F.concat(f"p_{k}", c) for k, c in own.items()})
    return found.select("source", F.col("node").alias("target"), F.element_at("costs", -1).alias("total"), "nodes", "costs")


def path_sums(dist: DataFrame, values: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Sum of ``values`` (node, value; 0 where missing) over the nodes of the
    chosen path to every node, or to the ``targets`` (column ``id``) alone:
    source, target, path_sum.  One number per row is carried, whatever the
    length of the paths."""
    found = _by_hops(dist, targets, {"total": F.col("value")}, {"total": F.col("p_total") + F.col("value")}, values)
    return found.select("source", F.col("node").alias("target"), F.col("total").alias("path_sum"))


# ------------------------------------------------------------------ harmonic centrality
def bfs_hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Unweighted hop distances (source, node, hops) from every source."""
    e = _cut(edges.select("src", "dst").distinct())
    dist = _cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops")))
    frontier = dist
    while True:
        nxt = frontier.join(e, frontier.node == e.src).select("source", F.col("dst").alias("node"), "hops").distinct()
        nxt = nxt.join(dist.select("source", "node"), ["source", "node"], "left_anti").select(
            "source", "node", (F.col("hops") + 1).alias("hops"))
        nxt = _cut(nxt.groupBy("source", "node").agg(F.min("hops").alias("hops")))
        if nxt.count() == 0:
            break
        dist = _cut(dist.unionByName(nxt))
        frontier = nxt
    return dist


def harmonic_exact(vertices: DataFrame, edges: DataFrame,
                   group: DataFrame | None = None) -> DataFrame:
    """Exact harmonic centrality sum_{u != v} 1/d(v,u) / (n - 1) by BFS from
    every vertex: V^2 rows, so for small graphs; harmonic_hyperball is the way
    for large ones.  With ``group``
    (node, community) the normaliser is the community size."""
    n = vertices.count()
    hops = bfs_hops(edges, vertices.select("id"))
    s = hops.where(F.col("hops") > 0).groupBy(F.col("source").alias("id")).agg(F.sum(1.0 / F.col("hops")).alias("s"))
    v = vertices.select("id").join(s, "id", "left")
    if group is None:
        return v.select("id", (F.coalesce("s", F.lit(0.0)) / F.lit(max(n - 1, 1))).alias("harmonic"))
    sizes = group.groupBy("community").agg(F.count(F.lit(1)).alias("__size"))
    g = group.select(F.col("node").alias("id"), "community").join(sizes, "community")
    return v.join(g, "id").select(
        "id", "community",
        (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("__size") - 1, F.lit(1))).alias("harmonic"))


def harmonic_hyperball(vertices: DataFrame, edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """Approximate harmonic centrality (HyperBall, Boldi & Vigna 2013): each
    vertex keeps an HLL sketch of the vertices within t hops; round t+1 unions
    the sketches of its out-neighbours, and the growth of the estimate, divided
    by t+1, is added to the score.  Memory per vertex is one sketch."""
    n = vertices.count()
    e = _cut(edges.select("src", "dst").distinct())
    state = vertices.groupBy("id").agg(F.hll_sketch_agg(F.col("id"), lg_k).alias("sk"))
    state = state.select("id", "sk", F.hll_sketch_estimate("sk").cast("double").alias("cnt"),
                         F.lit(0.0).alias("score"))
    state = _cut(state)
    for t in itertools.count():
        nb = e.join(state.select(F.col("id").alias("dst"), "sk"), "dst").select(F.col("src").alias("id"), "sk")
        own = state.select("id", "sk")
        merged = own.unionByName(nb).groupBy("id").agg(F.hll_union_agg("sk", True).alias("sk2"))
        nxt = state.join(merged, "id").select(
            "id", F.col("sk2").alias("sk"), F.hll_sketch_estimate("sk2").cast("double").alias("cnt2"), "score", "cnt")
        nxt = nxt.select("id", "sk", F.col("cnt2").alias("cnt"),
                         (F.col("score") + F.greatest(F.col("cnt2") - F.col("cnt"), F.lit(0.0)) / F.lit(t + 1.0))
                         .alias("score"), (F.col("cnt2") - F.col("cnt")).alias("__grow"))
        nxt = _cut(nxt)
        grew = nxt.where(F.col("__grow") > 0).limit(1).count()
        state = nxt.drop("__grow")
        if not grew:
            break
    return state.select("id", (F.col("score") / F.lit(max(n - 1, 1))).alias("harmonic"))


# ------------------------------------------------------------------ Louvain
def _modularity(edges: DataFrame, comm: DataFrame, two_m: float | None = None) -> float:
    """Q = sum_c [in_c / 2m - (tot_c / 2m)^2] on a both-directions edge list.
    ``comm`` is (node, community) and may carry the node degree as ``k``."""
    if two_m is None:
        two_m = edges.agg(F.sum("weight")).first()[0] or 0.0
    if two_m == 0:
        return 0.0
    if "k" in comm.columns:
        tot = comm.groupBy("community").agg(F.sum("k").alias("tot"))
        comm = comm.select("node", "community")
    else:
        k = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
        tot = k.join(comm, "node").groupBy("community").agg(F.sum("k").alias("tot"))
    cs = comm.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    cd = comm.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    inside = edges.join(cs, "src").join(cd, "dst").where("cs = cd").groupBy(F.col("cs").alias("community")).agg(
        F.sum("weight").alias("inw"))
    r = tot.join(inside, "community", "left").agg(
        F.sum(F.coalesce("inw", F.lit(0.0)) / two_m - F.pow(F.col("tot") / two_m, 2))).first()[0]
    return float(r or 0.0)


def _independent_movers(g: DataFrame, dec: DataFrame, two_m: float, *salt) -> DataFrame:
    """Which vertices of ``dec`` (id, k, c, to, rise, want) may move at once so
    that modularity rises: (id, nc), the community after the round.

    Two neighbours' moves are in each other's way only if one of them is in
    the community that the other wants (otherwise an edge between movers is
    worth at least what both counted on).  Wanting vertices get a hashed
    priority, and those that come before all neighbours in their way stay
    candidates: an independent set of these conflicts.  Two movers into (or out of) one community still lower each other's gain,
    by k k' / 2m.  Priorities fall into levels that double in number; a
    candidate moves if its rise exceeds its loss to all candidates of its own
    and earlier levels at either community.  The very first one always may, so
    every round with a wanting vertex raises modularity.
    """
    prio = F.xxhash64(F.col("id"), *map(F.lit, salt))
    want = dec.where("want").select("id", "k", "c", "to", "rise", F.struct(prio.alias("p"), "id").alias("prio"))
    there = want.select(F.col("id").alias("dst"), F.col("c").alias("c2"), F.col("to").alias("to2"), F.col("prio").alias("other"))
    here = want.select(F.col("id").alias("src"), F.col("c").alias("c1"), F.col("to").alias("to1"))
    near = g.where("src <> dst").join(there, "dst").join(here, "src").where("c2 = to1 OR c1 = to2")
    first = near.groupBy(F.col("src").alias("id")).agg(F.min("other").alias("first"))
    cand = want.join(first, "id", "left").where(F.col("first").isNull() | (F.col("prio") < F.col("first")))
    # levels 0, 1, 2, ...: a candidate's level grows by one as its priority's distance from the least doubles
    share = (F.col("prio.p").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    cand = cand.withColumn("level", F.greatest(F.lit(0), F.floor(F.lit(40.0) + F.log2(F.greatest(share, F.lit(1e-12))))).cast("int"))
    cand = _cut(cand.select("id", "k", "c", "to", "rise", "prio", "level"))

    def before(side: str) -> DataFrame:
        """Sum of k of the candidates up to a level, per community (a community has at most 41 levels)."""
        sums = cand.groupBy(side, "level").agg(F.sum("k").alias("k_level"))
        upto = Window.partitionBy(side).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return sums.select(side, "level", F.sum("k_level").over(upto).alias(f"k_{side}"))

    least = cand.agg(F.min("prio").alias("least"))
    priced = cand.join(before("to"), ["to", "level"]).join(before("c"), ["c", "level"]).join(F.broadcast(least))
    loss = F.col("k") * (F.col("k_to") + F.col("k_c") - 2 * F.col("k")) / F.lit(two_m)
    moving = priced.where((F.col("rise") > loss) | (F.col("prio") == F.col("least"))).select("id", F.col("to").alias("nc"))
    return dec.select("id", "c", "k").join(moving, "id", "left").select("id", F.coalesce("nc", "c").alias("c"), "k", F.col("nc").isNotNull().alias("moved"))


def louvain(vertices: DataFrame, edges: DataFrame, weight: str | None = None, tol: float = 1e-9,
            trace: list | None = None) -> tuple[DataFrame, list[float]]:
    """Louvain communities (Blondel et al. 2008) with intermediate levels.

    Edges are treated as undirected.  Each round every vertex computes, for
    each neighbouring community, the modularity gain of moving there, and an
    independent set of those that gain moves (``_independent_movers``), which
    raises modularity, so no round has to be taken back.  A level ends when no
    vertex gains more than ``tol`` of modularity by a move; the graph is then
    contracted (community pairs summed, self loops kept) and the next level
    starts, until a level moves nothing.  Communities are labelled by their
    smallest original vertex id; ids are numbers or strings.

    Returns (node, community, intermediate_communities) and the modularity
    after each level; ``trace`` gets (level, round, vertices moved).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).where("a <> b")
    und = base.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(
        F.max("w").alias("w"))
    g = und.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")).unionByName(
        und.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("w").alias("weight")))
    g = _cut(g)
    nodes = vertices.select(F.col("id").alias("node"))
    # mapping original node -> current super-node, and the history of labels
    own_type = vertices.schema["id"].dataType
    label_type = "long" if isinstance(own_type, T.IntegralType) else own_type.simpleString()
    mapping = _cut(nodes.select("node", F.col("node").alias("super"), F.array().cast(f"array<{label_type}>").alias("hist")))
    two_m = g.agg(F.sum("weight")).first()[0] or 0.0
    mods: list[float] = []
    if two_m == 0:
        out = mapping.select("node", F.col("node").alias("community"),
                             F.array(F.col("node").cast(label_type)).alias("intermediate_communities"))
        return out, mods
    sup_nodes = nodes.select(F.col("node").alias("id"))
    for level in itertools.count():
        k = g.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
        k = sup_nodes.join(k, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"))
        comm = _cut(k.select("id", F.col("id").alias("c"), "k"))
        moved_any = False
        for rnd in itertools.count():
            tot = comm.groupBy("c").agg(F.sum("k").alias("tot"))
            nbr = g.where("src <> dst").join(comm.select(F.col("id").alias("dst"), F.col("c").alias("cj")), "dst")
            kin = nbr.groupBy(F.col("src").alias("id"), F.col("cj").alias("c")).agg(F.sum("weight").alias("kin"))
            own = comm.select("id", "c", F.lit(0.0).alias("kin"))
            opts = own.unionByName(kin).groupBy("id", "c").agg(F.sum("kin").alias("kin"))
            me = comm.select("id", F.col("c").alias("d"), "k")
            score = F.col("kin") - (F.col("tot") - F.when(F.col("c") == F.col("d"), F.col("k")).otherwise(0.0)) * F.col("k") / F.lit(two_m)
            sc = opts.join(me, "id").join(tot, "c").select("id", "c", "d", "k", score.alias("s"))
            best = sc.groupBy("id").agg(
                F.min(F.struct((-F.col("s")).alias("less"), (F.col("c") != F.col("d")).alias("other"), F.col("c").alias("c"))).alias("b"),
                F.max(F.when(F.col("c") == F.col("d"), F.col("s"))).alias("s_own"), F.first("d").alias("c"), F.first("k").alias("k"))
            rise = -F.col("b.less") - F.col("s_own")
            seen = Observation()
            dec = best.select("id", "k", "c", (F.col("b.other") & (rise > tol * two_m)).alias("want"), rise.alias("rise"), F.col("b.c").alias("to"))
            dec = _cut(dec.observe(seen, F.count_if("want").alias("wants")))
            if not seen.get["wants"]:
                break
            moved = Observation()
            comm = _cut(_independent_movers(g, dec, two_m, level, rnd).observe(moved, F.count_if("moved").alias("n")).drop("moved"))
            moved_any = True
            if trace is not None:
                trace.append((level, rnd, moved.get["n"]))
        if not moved_any:
            break
        # label communities by smallest original node id
        orig_min = mapping.join(comm.select(F.col("id").alias("super"), "c"), "super").groupBy("c").agg(
            F.min("node").alias("label"))
        lab = comm.join(orig_min, "c").select(F.col("id").alias("super"), "label")
        mapping = _cut(mapping.join(lab, "super").select(
            "node", F.col("label").alias("super"), F.concat("hist", F.array(F.col("label").cast(label_type))).alias("hist")))
        # contract
        ls = lab.select(F.col("super").alias("src"), F.col("label").alias("s2"))
        ld = lab.select(F.col("super").alias("dst"), F.col("label").alias("d2"))
        g = _cut(g.join(ls, "src").join(ld, "dst").groupBy(F.col("s2").alias("src"), F.col("d2").alias("dst")).agg(
            F.sum("weight").alias("weight")))
        sup_nodes = lab.select(F.col("label").alias("id")).distinct()
        mods.append(_modularity(g, sup_nodes.select(F.col("id").alias("node"), F.col("id").alias("community")), two_m))
    out = mapping.select(
        "node", F.col("super").alias("community"),
        F.when(F.size("hist") > 0, F.col("hist")).otherwise(F.array(F.col("node").cast(label_type)))
        .alias("intermediate_communities"))
    return out.withColumn("first_level", F.try_element_at("intermediate_communities", F.lit(1))), mods


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None) -> float:
    """Modularity of a (node, community) assignment on an undirected graph."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).where("a <> b")
    und = base.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(
        F.max("w").alias("w"))
    g = und.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")).unionByName(
        und.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("w").alias("weight")))
    return _modularity(g, communities)
