"""Toxicity by multiple-instance learning.

A document is a bag of sentences, only the document has a label.  A sentence's
probability is the logistic of the weights of its words (whole words and their
first letters, so that inflected forms share evidence); a document's is the
noisy-or of its sentences: 1 - prod(1 - p).  Training needs document labels
only and, since one toxic sentence explains a toxic document, finds the
sentences at fault.

Feature statistics run over all labelled training rows in Spark; the weights
of the selected features are fitted on a bounded sample of them, each label
weighed by its rows in the full table; every text is then scored whole, map-only,
with the broadcast weights: at most ``max_features``, those whose presence tells
most about the label.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, only, slices
from tessera.session import scratch_path

_WORD = re.compile(r"[^\W\d_]+")
# a run of white space behind .!? or with a line's end in it; the search stops at white space alone
_BREAK = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\s*|[^\S\n]*\n\s*)")


@dataclass(frozen=True)
class Training:
    """``max_docs`` labelled rows per label bound the sample of the fit,
    ``max_features`` the classifier; 2 ** ``bitmap_bits`` bits tell the scans which
    documents may have a label, whatever the number of labels."""

    max_docs: int = 4000
    max_features: int = 4096
    bitmap_bits: int = 24
    min_docs: int = 4
    min_g: float = 10.83
    prefixes: tuple[int, ...] = (4, 5)
    rounds: int = 800
    rate: float = 0.1
    l2: float = 2e-5


@dataclass(frozen=True)
class Model:
    """Weights by feature; bias is the log-odds of a sentence without any."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    prefixes: tuple[int, ...] = (4, 5)


def word_features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return [word] + [f"{word[:n]}-" for n in prefixes if len(word) > n]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the non-blank sentences: they end behind .!? and white
    space, or with the line."""
    out, start = [], 0
    for m in _BREAK.finditer(text):
        end, after = m.span()
        if end > start:  # a break takes its white space whole, so what lies between two is not blank
            out.append((start, end))
        start = after
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def _sentence_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _words(docs: DataFrame) -> DataFrame:
    """docs with the distinct words of each text, joined by a space, in its
    place: all that the features need, and fewer bytes to shuffle."""

    def run(batches):
        for part in slices(batches, "text"):
            words = [" ".join(_sentence_words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.string())], ["doc_id", "words"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, words string")


def _feature_counts(labelled: DataFrame, prefixes: tuple[int, ...], limit: int = 500_000) -> DataFrame:
    """(feature, n0, n1): documents of either label that hold it, from their
    distinct ``words``."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
                ["feature", "n0", "n1"],
            )

        for part in slices(batches, "words"):
            for words, y in zip(part.column("words").to_pylist(), part.column("toxic").to_pylist()):
                found = {f for w in words.split() for f in word_features(w, prefixes)}
                for f in found:
                    counts.setdefault(f, [0, 0])[y] += 1
                if len(counts) > limit:
                    yield out()
                    counts.clear()
        yield out()

    return labelled.select("words", "toxic").mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )


def _bags(sample: DataFrame, index: dict[str, int], prefixes: tuple[int, ...]):
    """Sampled documents as (label, sentences, feature numbers by sentence)."""

    def run(batches):
        for part in slices(batches, "text"):
            n, sent, feat = [], [], []
            for text in part.column("text").to_pylist():
                spans = sentences(text)
                s, f = [], []
                for k, (a, b) in enumerate(spans):
                    here = [index[x] for w in _sentence_words(text[a:b]) for x in word_features(w, prefixes) if x in index]
                    s += [k] * len(here)
                    f += here
                n.append(len(spans))
                sent.append(s)
                feat.append(f)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(n, pa.int32()), pa.array(sent, ints), pa.array(feat, ints)], ["toxic", "n", "sent", "feat"]
            )

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, n int, sent array<int>, feat array<int>").toArrow()


def fit_noisy_or(y, n, sent, feat, n_features: int, t: Training, weight=None) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likeliest (gradient ascent with
    per-weight step sizes, ridge penalty on the weights).

    y: label of each bag; n: its sentences; sent, feat: for every bag, sentence
    number and feature of each occurrence; weight: rows that each bag stands
    for (1 by default).
    """
    y, n = np.asarray(y, float), np.asarray(n, np.int64)
    share = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    share = share / max(share.sum(), 1e-300)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    s = np.concatenate([np.asarray(a, np.int64) + o for a, o in zip(sent, starts)] + [np.zeros(0, np.int64)])
    f = np.concatenate([np.asarray(a, np.int64) for a in feat] + [np.zeros(0, np.int64)])
    # all sentences without a feature are alike: one entry with a count
    used, s = np.unique(s, return_inverse=True)
    bag = np.searchsorted(starts, used, side="right") - 1
    # bags without sentences share their start with the next: move to the one that holds the sentence
    bare = n - np.bincount(bag, minlength=len(n))
    w, b = np.zeros(n_features + 1), -3.0
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, t.rounds + 1):
        z = np.bincount(s, w[f], len(used)) + w[-1]
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-w[-1]))
        a = np.bincount(bag, np.logaddexp(0, z), len(n)) + bare * np.logaddexp(0, w[-1])
        # a = -log(prod(1 - p)); loss is a for label 0 and -log(1 - exp(-a)) for label 1
        d = np.where(y == 1, -1 / np.expm1(np.clip(a, 1e-9, 50)), 1.0) * share
        ds = d[bag] * p
        g = np.append(np.bincount(f, ds[s], n_features) + t.l2 * w[:-1], ds.sum() + (d * bare).sum() * p0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _possible(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """Rows of docs whose doc_id may be among those of ids: all that are, few
    others.  A bitmap of 2 ** bits hashed ids, as at most 2 ** (bits - 6) rows of
    64 bits, is sent to the scan."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << bits))
    place, bit = F.floor(slot / 64).cast("long"), F.expr("shiftleft(1L, cast(`__slot` % 64 AS int))")
    marks = ids.select(slot.alias("__slot")).select(F.floor(F.col("__slot") / 64).cast("long").alias("__place"), bit.alias("__bit"))
    marks = marks.groupBy("__place").agg(F.bit_or("__bit").alias("__bits"))
    names = docs.columns
    rows = docs.withColumn("__place", place).withColumn("__slot", slot).withColumn("__bit", bit)
    return rows.join(F.broadcast(marks), "__place").filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*names)


def _attach(docs: DataFrame, labels: DataFrame, bits: int) -> DataFrame:
    """docs joined to (doc_id, toxic).  Only rows that may have a label, by the
    bitmap, go into the join; whether that is a broadcast of few labels or a
    shuffle is Spark's choice by its size threshold."""
    return _possible(docs, labels, bits).join(labels, "doc_id")


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    """Model from the labelled documents that are not held out (crc32(doc_id as
    text) mod 3 is not 1).  Null texts, null labels and unlabelled rows are not
    used; with only one label present nothing is learnt and all scores are 0.
    """
    lab = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 3)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    # the copies' hashes alone decide which rows are examples: no text is shuffled for that
    named = _attach(only(docs, "doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h")), lab, t.bitmap_bits)
    # copies of a text are one example
    one = named.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("r")).select("r.doc_id", "r.toxic")
    one = _table(one, "toxicity-examples")
    texts = only(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    labelled = _words(_possible(texts, one, t.bitmap_bits)).join(one, "doc_id")
    totals = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(prefixes=t.prefixes)
    # likelihood ratio statistic of (has the feature) by (label), against min_g
    n0, n1, docs0, docs1 = F.col("n0"), F.col("n1"), totals[0], totals[1]
    total = docs0 + docs1

    def part(n, of_row, of_label):
        return F.when(n > 0, n * F.log(n * float(total) / (of_row * of_label))).otherwise(0.0)

    g = 2 * (part(n0, n0 + n1, docs0) + part(n1, n0 + n1, docs1)
             + part(docs0 - n0, total - n0 - n1, docs0) + part(docs1 - n1, total - n0 - n1, docs1))
    chosen = (
        _feature_counts(labelled, t.prefixes).filter((n0 + n1 >= t.min_docs) & (n0 + n1 < total)).withColumn("g", g)
        .filter(F.col("g") >= t.min_g).orderBy(F.desc("g"), "feature").limit(t.max_features).select("feature").collect()
    )
    index = {r["feature"]: i for i, r in enumerate(chosen)}
    mixed = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [one.filter(F.col("toxic") == y).orderBy(mixed, "doc_id").limit(t.max_docs) for y in (0, 1)]
    picked = _table(parts[0].unionByName(parts[1]), "toxicity-sample")  # 2 * max_docs rows at most
    sample = only(docs, "doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    bags = _bags(sample, index, t.prefixes).to_pydict()
    order = sorted(range(len(bags["n"])), key=lambda i: (bags["toxic"][i], bags["n"][i], bags["sent"][i], bags["feat"][i]))
    y, n, sent, feat = ([bags[c][i] for i in order if bags["n"][i]] for c in ("toxic", "n", "sent", "feat"))
    # the sample holds equally many of both labels where both are cut: each row stands for its label's share of the table
    stands = {k: total / min(total, t.max_docs) for k, total in totals.items()}
    w, bias = fit_noisy_or(y, n, sent, feat, len(index), t, [stands[k] for k in y])
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, bias, t.prefixes)


class Scorer:
    """Noisy-or of a model over whole texts."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.known = model, limit, {}
        starts = {f[:-1] for f in model.weights if f.endswith("-")}
        self.starts = [(n, {s for s in starts if len(s) == n}) for n in model.prefixes]

    def _learn(self, chunks: set[str]) -> None:
        """Notes which of the chunks hold a word that tells.  The words with a
        feature are found in all chunks at once; only chunks with one are weighed."""
        words = set(_WORD.findall(" ".join(chunks).lower()))
        found = words.intersection(self.model.weights)
        for n, some in self.starts:
            if not some.isdisjoint([w[:n] for w in words]):
                found.update(w for w in words if w[:n] in some)
        self.known.update(dict.fromkeys(chunks, False))
        if found:
            for c in chunks:
                here = _sentence_words(c)
                if not found.isdisjoint(here):
                    self.known[c] = any(map(self._word, here))

    def _word(self, word: str) -> float:
        return sum(self.model.weights.get(f, 0.0) for f in word_features(word, self.model.prefixes))

    def sentence(self, text: str) -> float:
        z = self.model.bias + sum(map(self._word, _sentence_words(text)))
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))

    def text(self, text: str, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and the sentences whose probability is at least ``least`` as
        (start, end, probability) in code points."""
        if len(self.known) > self.limit:
            self.known = {}
        known, quiet, at_fault = self.known, 0, []
        log_clean, bare = 0.0, -math.log1p(math.exp(self.model.bias))
        chunks = set(text.split())
        new = chunks.difference(known)
        if new:
            self._learn(new)
        telling = {c for c in chunks if known[c]}
        if not telling:
            quiet = len(sentences(text))
        else:
            for a, b in sentences(text):
                if telling.isdisjoint(text[a:b].split()):
                    quiet += 1
                    continue
                p = self.sentence(text[a:b])
                log_clean += math.log1p(-min(p, 1 - 1e-15))
                if p >= least:
                    at_fault.append((a, b, p))
        return min(max(-math.expm1(log_clean + quiet * bare), 0.0), 1.0), at_fault


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the sentences at fault of every row.  Null, empty and
    blank texts have no sentence and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            found = [scorer.text(t) for t in part.column("text").to_pylist()]
            spans = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x for x, _ in found], pa.float64()), pa.array(spans, pa.list_(span))],
                ["doc_id", "score", "at_fault"],
            )

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, at_fault array<struct<start:int,end:int,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, t: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted, at_fault of every row of docs."""
    return score(docs, train(docs, labels, t)).select(
        "doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "at_fault"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, t: Training = Training()) -> DataFrame:
    """The rows of docs that are not predicted toxic, all their columns as they
    are: each row is scored and decided where it is read.

    Null, empty and blank texts score 0 and stay; rows that share a doc_id are
    decided each by its own text, repeated rows alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, t))

    def run(batches):
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            clean = [scorer.text(x or "")[0] < threshold for x in part.column("text").to_pylist()]
            yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
