"""License scans by diagonal voting.

Every rolling k-gram of words of every text is hashed and joined to the places
of the same hash in the license templates, a table of fixed size that is
broadcast.  A match votes for the diagonal (place in the text minus place in
the template); votes are pre-aggregated per text, template and diagonal.
Neighbouring diagonals are merged, which bridges inserted or missing words,
and a span is verified by the share of the template's words that its matches
cover; the words that tell a license from its versions and kin (``DECIDING``)
must be among them, in one piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import only, slices

# Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of common notices, by label.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-line", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Words of a template that a span must hold as they stand.  Other
# words between them name another license (Lesser, NonCommercial, MIT-0).
DECIDING = {
    "gpl-3.0": ["gnu general public", "license version 3"],
    "gpl-2.0": ["gnu general public", "license version 2"],
    "gpl-notice": ["gnu general public"],
    "apache-2.0": ["version 2 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0"],
    "cc-by-4.0": ["cc by 4 0"],
    "cc-by-notice": ["attribution 4 0"],
    "mit-line": ["the mit license"],
    "mpl-2.0": ["mozilla public license", "v 2 0"],
}

K = 3
SLACK = 3
MIN_COVERED = 0.75

# bytes outside [0-9a-z] and non-ASCII part words
_BLANK = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PHRASE = re.compile(b"(?:^| )(" + b"|".join(re.escape(p.encode()) for p in PHRASES) + b")(?= |$)")


def license_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8."""
    return text.encode().lower().translate(_BLANK).split()


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of every place of a phrase.  No phrase begins with
    a word that ends another, so places never overlap."""
    line = b" ".join(words)
    if b"license" not in line and b"cc by" not in line:
        return []
    return [(line.count(b" ", 0, m.start(1)), PHRASES[m[1].decode()]) for m in _PHRASE.finditer(line)]


class Grams:
    """Hashes of rolling word k-grams; word hashes are kept up to ``limit``."""

    def __init__(self, k: int = K, limit: int = 300_000):
        self.k, self.limit, self.cache = k, limit, {}

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' k-gram hashes in a row, and the offsets of each text's."""
        if len(self.cache) > self.limit:
            self.cache = {}
        flat = [w for t in texts for w in t]
        cache = self.cache
        for w in set(flat).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
        n = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(n)
        g = np.zeros(max(len(h) - self.k + 1, 0), np.uint64)
        for j in range(self.k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(g)]
        g ^= g >> np.uint64(29)
        size = np.maximum(n - self.k + 1, 0)
        keep = np.ones(len(h), bool)
        for j in range(1, self.k):  # the last k - 1 places of a text begin no k-gram
            keep[(ends - j)[n >= j]] = False
        return g[keep[:len(g)]].view(np.int64), np.concatenate([[0], np.cumsum(size)])


def deciding_places(words: list[bytes], phrases: list[str], k: int = K) -> list[int]:
    """Places of the k-grams of a template that hold its deciding words."""
    out = set()
    for phrase in phrases:
        p = license_words(phrase)
        at = next((i for i in range(len(words)) if words[i:i + len(p)] == p), None)
        if at is None:
            raise ValueError(f"{phrase!r} is not in its template")
        # one k-gram around a phrase shorter than k, which may end the template
        out.update(min(i, max(len(words) - k, 0)) for i in range(at, at + max(len(p) - k, 0) + 1))
    return sorted(out)


def template_table(spark: SparkSession, templates=TEMPLATES, k: int = K, deciding=DECIDING) -> DataFrame:
    """(hash, template, t_pos, t_words, t_deciding): one row per template k-gram."""
    rows = []
    for label, text in templates:
        words = license_words(text)
        hashes, _ = Grams(k).of([words])
        must = deciding_places(words, deciding.get(label, []), k)
        rows += [(int(h), label, i, len(words), must) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "hash long, template string, t_pos int, t_words int, t_deciding array<int>")


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Words and phrase places of every row; key is a hash of the text."""

    def run(batches):
        for part in slices(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                words = license_words(text)
                places = phrase_places(words)
                rows.append((
                    xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63), len(words), len(places),
                    places[0][0] if places else None, places[-1][0] if places else None, sorted({x for _, x in places}),
                ))
            key, n, n_base, first, last, labels = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (key, n, n_base, first, last)), pa.array(labels, pa.list_(pa.string()))],
                ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "found"],
            )

    return _texts(docs).mapInArrow(
        run, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, found array<string>"
    )


def rolling_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, key, grams): all k-gram hashes of every row in order."""

    def run(batches):
        grams = Grams(k)
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            hashes, offsets = grams.of([license_words(t) for t in texts])
            keys = [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.int64()), lists], ["doc_id", "key", "grams"])

    return _texts(docs).mapInArrow(run, "doc_id long, key long, grams array<bigint>")


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, slack: int = SLACK, min_covered: float = MIN_COVERED,
                  deciding=DECIDING) -> DataFrame:
    """Verified spans: doc_id, key, template, first_word, last_word, covered."""
    table = template_table(docs.sparkSession, templates, k, deciding)
    votes = (
        rolling_grams(docs, k).select("doc_id", "key", F.posexplode("grams").alias("pos", "hash"))
        .join(F.broadcast(table), "hash")  # as many rows as the templates have words
        .groupBy("doc_id", "key", "template", "t_words", "t_deciding", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        # at most one element per word of the template
        .agg(F.collect_set("t_pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    order = W.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    runs = votes.withColumn("begins", F.when(F.coalesce(step > slack, F.lit(True)), 1).otherwise(0)).withColumn(
        "run", F.sum("begins").over(order)
    )
    merged = runs.groupBy("doc_id", "key", "template", "t_words", "t_deciding", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first_word"),
        (F.max("last") + k - 1).alias("last_word"),
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1))))
    told = F.size(F.array_except("t_deciding", "places")) == 0
    return merged.filter(told).withColumn("covered", F.size(words) / F.col("t_words")).filter(F.col("covered") >= min_covered).select(
        "doc_id", "key", "template", "first_word", "last_word", "covered"
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: phrase places, labels and score.

    Null and empty texts have no words, no labels and score 0.  The score is 1
    where a phrase stands, else the share covered of the best template found.
    """
    spans = license_spans(docs).groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key")).agg(
        F.collect_set("template").alias("more"), F.max("covered").alias("best")
    )
    b = base_counts(docs)
    out = b.join(spans, b["doc_id"].eqNullSafe(F.col("s_id")) & (b["key"] == F.col("s_key")), "left")
    labels = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("found", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
