"""Interpolated modified Kneser-Ney model of any order, counted in Spark.

* Words are 64-bit hashes; a word's id is its place among the sorted hashes of
  the training corpus.
* The key of an n-gram is the places of its first and of its last n - 1 words
  among the level below (a word's: its id) in one number of as few bits as they
  need (64 at most), run through an invertible mixing: exact, and spread evenly
  whatever the words, so a frequent word's n-grams lie in all segments and no
  task gets a hot key.  A text begins behind one start, which only begins n-grams.
* Tasks count keys in large pieces of text before the shuffle, level by level,
  and send each segment a row of its sorted keys' steps and their counts; each
  segment is then merged and written as arrays (keys, counts) to the shared
  folder.  Workers memory-map them; nothing of the model passes the driver but
  a dozen totals a level.
* From the highest level down, every n-gram adds to the continuation count of
  its last n - 1 words and to the followers (their sum, and how many count one,
  two and more) of its first n - 1.  These are summed per segment, sent in a row
  per block of places, added up there and written as rows of bytes.

P(w | u) = max(a(u w) - D(a), 0) / a(u .) + g(u) P(w | u without its first
word); a is the count at the highest level and for n-grams behind the start,
else the continuation count.  The lowest level is interpolated with
1 / (V + 1); one share of it is the probability of an unknown word.  D has three
values a level, for counts 1, 2 and more.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import Keys, Rows, batch, from_steps, packed, steps, unpacked, write_rows
from tessera.llm.common import held_out, only, slices, utf8
from tessera.session import scratch_path

END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
_ODD1, _ODD2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def mix(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """A bijection of numbers of so many bits: xor-shifts and odd factors."""
    x, half, mask = x.view(np.uint64), np.uint64(bits // 2 + 1), np.uint64((1 << bits) - 1)
    x = ((x ^ (x >> half)) * np.uint64(_ODD1)) & mask
    x = ((x ^ (x >> half)) * np.uint64(_ODD2)) & mask
    return (x ^ (x >> half)).view(np.int64)


def unmix(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """Inverse of mix."""
    x, half, mask = x.view(np.uint64), np.uint64(bits // 2 + 1), np.uint64((1 << bits) - 1)
    x = ((x ^ (x >> half)) * np.uint64(pow(_ODD2, -1, 1 << 64))) & mask
    x = ((x ^ (x >> half)) * np.uint64(pow(_ODD1, -1, 1 << 64))) & mask
    return (x ^ (x >> half)).view(np.int64)


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """A-Z lower-cased words of UTF-8 texts in a row, without the ends, and the
    number of each text's."""
    if texts.offset:
        texts = pa.concat_arrays([texts])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end splits off an empty one
    return words.filter(real).dictionary_encode(), np.bincount(text.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))


def _hashes(words: pa.DictionaryArray) -> np.ndarray:
    """Hashes of the distinct words."""
    distinct = words.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D for counts 1, 2 and more from the numbers n of items seen one to four
    times; where a number is zero, half of the count's own size is taken."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3))


BLOCK = 1 << 20
SLICE = 4 << 20  # bytes of text at once


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the totals.  bits: of the segment numbers of
    each level, words first; grams: n-grams of each level (words with the
    start); d: discounts of each level; block: places an array of figures holds
    at most."""

    folder: str
    order: int
    bits: tuple[int, ...]
    words: int
    tokens: int
    docs: int
    grams: tuple[int, ...]
    block: int
    d: tuple[tuple[float, float, float], ...] = ()
    word_rest: float = 1.0


def _name(n: int) -> str:
    return "word" if n == 1 else f"gram{n}"


class Words:
    """Ids of words by the memory-mapped vocabulary; unknown words are -1."""

    def __init__(self, m: Model):
        self.table = Keys(m.folder, _name(1), m.bits[0], 64)
        self.end = [int(x[0]) for x in self.table.find(np.array([END], np.uint64))]

    def sequence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids and training counts of every text's words and its end in a row,
        place of every text's first, tokens per text)."""
        words, n = tokens(texts)
        h, at = _hashes(words), words.indices.to_numpy()
        order = np.argsort(h)
        n = n.astype(np.int64) + 1
        ends = np.cumsum(n)
        inner = np.ones(int(n.sum()), bool)
        inner[ends - 1] = False
        out = []
        for found, end in zip(self.table.find(h[order]), self.end):
            x = np.empty(len(h), np.int64)
            x[order] = found
            out.append(np.full(len(inner), end, np.int64))
            out[-1][inner] = x[at]
        return *out, ends - n, n


def _after(x: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """Of every token what x holds for the one before; at a text's first, first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


class Grams:
    """The n-grams of levels 2 to ``top`` by their memory-mapped segments."""

    def __init__(self, m: Model, top: int):
        self.m = m
        self.half = {n: max(8, m.grams[n - 2].bit_length()) for n in range(2, len(m.grams) + 2)}
        self.levels = {n: Keys(m.folder, _name(n), m.bits[n - 1], 2 * self.half[n]) for n in range(2, top + 1)}

    def keys(self, n: int, prefix: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Keys of n-grams by the places of their first and last n - 1 words."""
        half = self.half[n]
        if half > 32:
            raise ValueError("two places do not fit 64 bits")
        return mix((prefix.view(np.uint64) << np.uint64(half)) | rest.view(np.uint64), 2 * half).view(np.uint64)

    def parts(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first, of the last n - 1 words) of keys."""
        half = np.uint64(self.half[n])
        x = unmix(keys, 2 * self.half[n]).view(np.uint64)
        return (x >> half).view(np.int64), (x & ((np.uint64(1) << half) - np.uint64(1))).view(np.int64)

    def pairs(self, n: int, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens whose n-gram can be known, its key), given the place of the
        last n - 1 words at every token (-1: unknown)."""
        prefix = _after(place, starts, self.m.words if n == 2 else -1)  # one start: nothing stands before it
        here = np.flatnonzero((prefix >= 0) & (place >= 0))
        return here, self.keys(n, prefix[here], place[here])

    def step(self, n: int, place: np.ndarray, starts: np.ndarray):
        """(tokens, for each the number of its n-gram among the distinct ones,
        their places, their counts); each distinct one is looked up once."""
        here, keys = self.pairs(n, place, starts)
        keys, back = np.unique(keys, return_inverse=True)
        return here, back, *self.levels[n].find(keys)


FIGURES = ("cont", "total", "n1", "n2", "n3")


def _block(m: Model, n: int) -> int:
    """Places in a block of figures of level n: an eighth as many blocks as the
    level above has segments or more, so that what one task adds up does not
    grow with the corpus when its words are all known."""
    return max(1, min(m.block, -(-m.grams[n - 1] // max(1, 1 << m.bits[n] >> 3))))


class Figures:
    """Rows of figures by place, in memory-mapped blocks."""

    def __init__(self, m: Model, n: int):
        self.size = _block(m, n)
        self.blocks = [Rows(m.folder, f"figures{n}-{i}", len(FIGURES)) for i in range(-(-m.grams[n - 1] // self.size))]

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        """Rows of places (-1: 0)."""
        out, number = np.zeros((len(places), len(FIGURES)), np.int64), places // self.size
        for k in np.unique(number[places >= 0]).tolist():
            if len(self.blocks[k]):
                here = np.flatnonzero(number == k)
                out[here] = self.blocks[k][places[here] % self.size]
        return out


def _bits(rows: int, per_segment: int = 2_000_000) -> int:
    return max(0, int(np.ceil(np.log2(max(rows, 1) / per_segment))))


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text"))


def _pieces(number: np.ndarray):
    """(number, start, end) of the runs of sorted numbers."""
    cuts = np.flatnonzero(np.diff(number, prepend=number[:1] - 1 if len(number) else []))
    return zip(number[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(number)])


def _by_part(keys: np.ndarray, counts: np.ndarray, rest: int):
    """A row of keys and counts for every segment among the sorted keys."""
    for i, a, e in _pieces((keys >> np.uint64(rest)).astype(np.int64)):
        yield batch(part=pa.array([i], pa.int32()), keys=[steps(keys[a:e] & np.uint64((1 << rest) - 1))], counts=[packed(counts[a:e])])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their sums)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts, first)


_COUNTED = "part int, keys binary, counts binary"


def _count_words(train: DataFrame, m: Model, limit: int = 1_000_000) -> DataFrame:
    """Rows of sorted hashes and counts of words by segment."""
    rest = 64 - m.bits[0]

    def run(batches):
        held, size, docs = [], 0, 0
        for part in slices(batches, "text", SLICE):
            words, _ = tokens(part.column("text"))
            held.append((_hashes(words), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
            size += len(held[-1][0])
            docs += part.num_rows
            if size > limit:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if 2 * size > limit:
                    yield from _by_part(*held[0], rest)
                    held, size = [], 0
        if docs:
            held.append((np.array([END], np.uint64), np.array([docs])))
            yield from _by_part(*_summed(*map(np.concatenate, zip(*held))), rest)

    return train.select("text").mapInArrow(run, _COUNTED)


def _count_grams(train: DataFrame, m: Model, n: int, limit: int = 3_000_000) -> DataFrame:
    """Rows of sorted keys and counts of level n by segment; the levels below
    are written."""

    def run(batches):
        words, grams, held, size = Words(m), Grams(m, n - 1), [], 0
        rest = 2 * grams.half[n] - m.bits[n - 1]

        def out():
            return _by_part(*np.unique(np.concatenate(held), return_counts=True), rest)

        for part in slices(batches, "text", SLICE):
            place, _, starts, _ = words.sequence(part.column("text"))
            for k in range(2, n):
                here, back, at, _ = grams.step(k, place, starts)
                place = np.full(len(place), -1, np.int64)
                place[here] = at[back]
            held.append(grams.pairs(n, place, starts)[1])
            size += len(held[-1])
            if size > limit:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return train.select("text").mapInArrow(run, _COUNTED)


def _by_number(df: DataFrame, number: str, n: int, merge, schema: str) -> DataFrame:
    """What merge(number, rows) gives for the rows of each number below n, which
    it reads one after the other."""

    def run(batches):
        rows = (row for b in batches for row in b.to_pylist())
        for k, own in groupby(rows, itemgetter(number)):
            yield merge(k, own)

    return df.repartition(n, number).sortWithinPartitions(number).mapInArrow(run, schema)


def _write_keys(counted: DataFrame, m: Model, n: int) -> list[int]:
    """Writes the segments of level n; gives how many keys it has and the sum
    of their counts."""
    folder, bits = m.folder, m.bits[n - 1]
    rest = (64 if n == 1 else 2 * Grams(m, 1).half[n]) - bits

    def merge(part, rows):
        keys, counts = zip(*((from_steps(r["keys"]), unpacked(r["counts"])) for r in rows))
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        Keys.write(folder, _name(n), part, rest, keys, counts.astype(np.int64))
        return batch(n=[len(keys)], total=[int(counts.sum())])

    return _sums(_by_number(counted, "part", 1 << bits, merge, "n long, total long"), "n", "total")


def _by_segment(spark: SparkSession, m: Model, n: int, describe, schema: str) -> DataFrame:
    """What describe(grams, keys, a) yields for every segment of level n, a
    being the counts that the level's probabilities use."""

    def run(batches):
        grams = Grams(m, n)
        cont = Figures(m, n) if n < m.order else None
        for b in batches:
            for i in b.column("id").to_pylist():
                keys, a = grams.levels[n].segment(i)
                if cont is not None:
                    # only what begins with the start has no word before it
                    c = cont[np.arange(len(keys)) + grams.levels[n].offsets[i]][:, 0]
                    a = np.where(c > 0, c, a)
                if len(keys):
                    yield from describe(grams, keys, a)

    parts = 1 << m.bits[n - 1]
    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def _of_counts(x: np.ndarray) -> dict:
    return {f"n{k}": pa.array([int((x == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}


def _sums(df: DataFrame, *names: str) -> list[int]:
    row = df.agg(*[F.sum(c).alias(c) for c in names]).first()
    return [row[c] or 0 for c in names]


def _write_figures(spark: SparkSession, m: Model, n: int) -> list[int]:
    """Figures of level n - 1 out of level n.  Gives how many of its
    continuation counts are 1, 2, 3, 4 and above 2, and their sum."""
    size = _block(m, n - 1)

    def figures(grams, keys, a):
        prefix, rest = grams.parts(n, keys)
        ids, at = np.unique(np.concatenate([prefix, rest]), return_inverse=True)
        before, behind = at[:len(prefix)], at[len(prefix):]
        count = lambda x, **k: np.bincount(x, minlength=len(ids), **k).astype(np.int64)
        f = np.stack([count(behind), count(before, weights=a), count(before[a == 1]), count(before[a == 2]), count(before[a > 2])])
        for k, i, e in _pieces(ids // size):
            yield batch(block=[k], places=[steps(ids[i:e] % size)], figures=[packed(f[:, i:e].ravel())])

    def merge(block, rows):
        f = np.zeros((len(FIGURES), min(size, m.grams[n - 2] - block * size)), np.int64)
        for r in rows:
            places = from_steps(r["places"]).astype(np.int64)
            f[:, places] += unpacked(r["figures"]).astype(np.int64).reshape(len(FIGURES), -1)
        write_rows(m.folder, f"figures{n - 1}-{block}", f.T)
        return batch(**_of_counts(f[0]), more=[int((f[0] > 2).sum())], pairs=[int(f[0].sum())])

    seen = _by_segment(spark, m, n, figures, "block long, places binary, figures binary")
    out = ("n1", "n2", "n3", "n4", "more", "pairs")
    return _sums(_by_number(seen, "block", m.grams[n - 2] // size + 1, merge, ", ".join(f"{c} long" for c in out)), *out)


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """What a query has shuffled goes when it ends: a level's arrays are
    written by then, and nothing reads its counts again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fit(spark: SparkSession, train: DataFrame, order: int = 2) -> Model:
    """Count a model of ``order`` (2 or more) on the texts of train (null:
    empty; every text ends with an end token) and write its arrays."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    with _dropping_shuffles(spark):
        return _fit(spark, _texts(train), order)


def _fit(spark: SparkSession, train: DataFrame, order: int) -> Model:
    folder = scratch_path(spark, "kneser-ney")
    # the vocabulary has about as many segments as a shuffle has partitions
    word_bits = int(np.ceil(np.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    m = Model(folder, order, (word_bits,), 0, 0, train.count(), (), BLOCK)
    words, n_tokens = _write_keys(_count_words(train, m), m, 1)
    m = replace(m, words=words, tokens=n_tokens, grams=(words + 1,))
    for n in range(2, order + 1):
        m = replace(m, bits=(*m.bits, _bits(n_tokens, 2_000_000)))
        m = replace(m, grams=(*m.grams, _write_keys(_count_grams(train, m, n), m, n)[0]))
    d, rest = [], 1.0
    for n in range(order, 1, -1):
        d.insert(0, discounts(_sums(_by_segment(spark, m, n, lambda _, keys, a: [batch(**_of_counts(a))], "n1 long, n2 long, n3 long, n4 long"), "n1", "n2", "n3", "n4")))
        *ns, more, pairs = _write_figures(spark, m, n)
    d.insert(0, discounts(ns))
    if pairs:
        rest = sum(x * k for x, k in zip(d[0], (ns[0], ns[1], more))) / pairs
    return replace(m, d=tuple(d), word_rest=rest)


class Scorer:
    """Probabilities by a model's memory-mapped arrays."""

    def __init__(self, m: Model):
        self.m, self.words, self.grams = m, Words(m), Grams(m, m.order)
        self.figures = {n: Figures(m, n) for n in range(1, m.order)}

    @staticmethod
    def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])

    def _followers(self, k: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the followers' counts, what is taken off them) by figures of level k."""
        d = self.m.d[k]
        return f[:, 1].astype(float), d[0] * f[:, 2] + d[1] * f[:, 3] + d[2] * f[:, 4]

    def batch(self, texts: pa.Array):
        """(tokens, known, base log10, model log10) of each text."""
        m = self.m
        w, cw, starts, n = self.words.sequence(texts)
        ids, back = np.unique(w, return_inverse=True)
        f = self.figures[1][ids]
        p = np.full(len(ids), m.word_rest / (m.words + 1))
        if m.grams[1]:
            p += np.maximum(f[:, 0] - self._discount(f[:, 0], m.d[0]), 0) / m.grams[1]
        p = p[back]
        place, (total, rest) = w, (x[back] for x in self._followers(1, f))
        first = [x[0] for x in self._followers(1, self.figures[1][np.array([m.words])])]
        for k in range(2, m.order + 1):
            here, back, at, count = self.grams.step(k, place, starts)
            total, rest = (_after(x, starts, y) for x, y in zip((total, rest), first))
            f = self.figures[k][at] if k < m.order else None
            a = count if f is None else np.where(f[:, 0] > 0, f[:, 0], count)
            seen = np.zeros(len(w))
            seen[here] = np.maximum(a - self._discount(a, m.d[k - 1]), 0)[back]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (seen + rest * p) / total, p)
            if f is not None:
                place, total, rest, first = np.full(len(w), -1, np.int64), np.zeros(len(w)), np.zeros(len(w)), (0.0, 0.0)
                place[here] = at[back]
                for x, y in zip((total, rest), self._followers(k, f)):
                    x[here] = y[back]
        score = np.log10(p)
        base = np.log10((cw + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        sums = [np.add.reduceat(x, starts) if len(n) else np.zeros(0) for x in ((cw > 0).astype(np.int64), base, score)]
        return n, *sums


SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known, base_score and score of every row; a null text is
    empty: its one token is the end."""

    def run(batches):
        scorer = Scorer(model)
        for part in slices(batches, "text", SLICE):
            n, known, base, own = scorer.batch(part.column("text"))
            yield batch(doc_id=part.column("doc_id"), n_tokens=n, n_known=known, base_score=base, score=own)

    return _texts(docs).mapInArrow(run, SCHEMA)


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with perplexity per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def language_model(docs: DataFrame, mod: int = 5, order: int = 2) -> DataFrame:
    """Train a model of ``order`` on the rows that are not held out (crc32(doc_id as text) mod
    ``mod`` is not 1) and score all.  An empty table gives no rows."""
    spark = docs.sparkSession
    model = fit(spark, docs.filter(~held_out(F.col("doc_id"), mod)), order)
    return perplexity(score(docs, model)).select(
        "doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
