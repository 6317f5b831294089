"""Token counts by the whole-token shortcut.

Offline, once per vocabulary: a vocabulary string counts as proved if the
library encodes it alone as that one token.  The proof's result has at most
one entry per vocabulary entry and is broadcast.  Pre-tokens found there count
one; only the others are merged, each once per worker and cache span.
"""

from __future__ import annotations

import gc
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices
from tessera.llm.word_bpe import bare, plain, pre_tokens, tokenizer

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _unicode_bytes() -> dict[str, int]:
    """The byte behind each character of byte-level vocabulary strings: the
    printable Latin-1 characters stand for themselves, the others in order for
    the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str | None = None) -> frozenset[str]:
    """Strings that are one pre-token and, alone, one token."""
    tok, back = tokenizer(path), _unicode_bytes()
    strings = []
    for s in tok.get_vocab(with_added_tokens=False):
        if s.endswith("</w>"):
            try:
                strings.append(bytes(back[c] for c in s[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character: never a pre-token
    found = tok.encode_batch_fast(strings, add_special_tokens=False)
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    return frozenset(
        s for s, e in zip(strings, found) if len(e.ids) == 1 and plain(s, special) and s == s.lower() and pre_tokens(s) == [s]
    )


class ChunkCounts:
    """Token counts of texts; chunks and pre-tokens outside ``whole`` are
    merged once and kept, up to ``limit`` entries."""

    def __init__(self, whole: frozenset[str], path: str | None = None, limit: int = 600_000):
        self.whole, self.limit = whole, limit
        self.tok, self.merges = tokenizer(path), bare(path)
        self.specials = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.cache: dict[str, int] = dict.fromkeys(whole, 1)

    def _learn(self, chunks: set[str]) -> None:
        parts = {c: pre_tokens(c) for c in chunks}
        merge = [p for p in set(chain.from_iterable(parts.values())) if p not in self.cache]
        for a in range(0, len(merge), 20_000):
            some = merge[a:a + 20_000]
            for p, e in zip(some, self.merges.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[p] = len(e.ids)
        get = self.cache.__getitem__
        self.cache.update({c: sum(map(get, ps)) for c, ps in parts.items() if len(ps) != 1})

    def texts(self, texts: list[str]) -> list[int]:
        chunks = [t.lower().split() if plain(t, self.specials) else None for t in texts]
        if len(self.cache) > self.limit:
            self.cache = dict.fromkeys(self.whole, 1)
        new = set()
        for c in chunks:
            if c is not None:
                new.update(c)
        self._learn(new.difference(self.cache))
        get = self.cache.__getitem__
        return [
            sum(map(get, c)) if c is not None else len(self.tok.encode(t, add_special_tokens=False).ids)
            for c, t in zip(chunks, texts)
        ]


_SHARED: dict[str | None, ChunkCounts] = {}


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null texts are empty."""
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches):
        if path not in _SHARED:
            gc.disable()  # the cache holds no cycles
            _SHARED[path] = ChunkCounts(proved.value, path)
        counts = _SHARED[path]
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            n = counts.texts(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, SCHEMA)
