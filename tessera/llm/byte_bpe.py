"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a pre-token has exactly one valid encoding.  Its last
token is the vocabulary suffix t of the prefix for which the token before it,
the last token of the shorter prefix, and t stay apart when their bytes are
merged together.  Storing that one token per prefix gives all encodings of all
prefixes: an append only adds entries, and after an edit the entries before it
stay, as do those behind it once as many entries as the longest token has bytes
agree again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import chain
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices

MODEL = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    lines = Path(path or public_tokenizers.path(MODEL)).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Ranks, and which tokens and pairs of tokens keep apart."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 2_000_000):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: the ends of tokens: a string that is none ends no token
        self.ends = {b[i:] for b in ranks for i in range(len(b))}
        self.limit = limit
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first: the definition, for short strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_whole(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = len(self.merged(self.bytes[token])) == 1
        return known

    def keep_apart(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            x, y = self.bytes[a], self.bytes[b]
            known = self.pairs[a, b] = self.is_whole(a) and self.merged(x + y) == [x, y]
        return known


    def last_token(self, data: bytes, last: list[int], i: int) -> int:
        """Last token of data[:i + 1], given those of the shorter prefixes."""
        ends, ranks, pairs, end = self.ends, self.ranks, self.pairs, i + 1
        start, found = i, []
        while start >= 0 and (part := data[start:end]) in ends:
            if part in ranks:
                found.append((start, ranks[part]))
            start -= 1
        while found:  # the longest first: mostly it is the one
            start, t = found.pop()
            if not start:
                if self.is_whole(t):
                    return t
            elif (known := pairs.get((last[start - 1], t))) or (known is None and self.keep_apart(last[start - 1], t)):
                return t
        raise ValueError(f"byte {data[i]} is not in the vocabulary")


class PrefixTable:
    """One pre-token's bytes; last[i] is the last token of its first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.replace(0, 0, data)

    def append(self, more: bytes) -> None:
        self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of data[start:end]; only entries that can
        differ are computed."""
        data, old = self.data[:start] + new + self.data[end:], self.last
        shift, last, same = len(new) - (end - start), old[:start], 0
        for i in range(start, len(data)):
            last.append(self.vocabulary.last_token(data, last, i))
            behind = i >= start + len(new)
            same = same + 1 if behind and last[i] == old[i - shift] else 0
            if same >= self.vocabulary.longest:
                last += old[i - shift + 1:]
                break
        self.data, self.last = data, last

    def ids(self, length: int | None = None) -> list[int]:
        """Ids of the first ``length`` bytes (all by default)."""
        i, out = len(self.data) if length is None else length, []
        while i:
            out.append(self.last[i - 1])
            i -= self.vocabulary.size[out[-1]]
        return out[::-1]


class Encoder:
    """Ids of texts; pre-tokens are encoded once, up to ``limit`` of them."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN, limit: int = 300_000):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.limit = limit
        self.cache: dict[str, list[int]] = {}
        self.joined: dict[str, str] = {}

    def _learn(self, new: set[str]) -> None:
        """Encode pieces in byte order: each goes on from the entries of the
        prefix it shares with the one before."""
        v, last, before = self.vocabulary, [], b""
        for data, piece in sorted((p.encode(), p) for p in new):
            k, top = 0, min(len(before), len(data))
            while k < top and before[k] == data[k]:
                k += 1
            del last[k:]
            for i in range(k, len(data)):
                last.append(v.last_token(data, last, i))
            ids, i = [], len(data)
            while i:
                t = last[i - 1]
                ids.append(t)
                i -= v.size[t]
            ids.reverse()
            self.cache[piece] = ids
            self.joined[piece] = " ".join(map(str, ids))
            before = data

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """Pieces of texts, all of them in the cache."""
        found = list(map(self.split, texts))
        if len(self.cache) > self.limit:
            self.cache, self.joined = {}, {}
        new = set()
        for f in found:
            new.update(f)
        self._learn(new.difference(self.cache))
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split_all([text])[0])))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


class EncodedText:
    """A text with its ids, kept exact under appends and edits.

    A pre-token can change through what follows it only if it is one of the
    last two before the change (an apostrophe and the letter of a contraction),
    so splitting starts anew three pre-tokens before it and ends where the old
    pre-tokens begin again.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.pieces = encoder.split(text)
        self.tables = [PrefixTable(encoder.vocabulary, p.encode()) for p in self.pieces]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> None:
        starts = [0]
        for p in self.pieces:
            starts.append(starts[-1] + len(p))
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first = max(0, next((k for k in range(len(self.pieces)) if starts[k + 1] >= start), len(self.pieces)) - 3)
        # old pre-tokens that start behind the edit, by their new place
        old = {s + shift: k for k, s in enumerate(starts[:-1]) if s >= end + 1}
        at, pieces, rest = starts[first], [], len(self.pieces)
        for m in self.encoder.pattern.finditer(text, at):
            if m.start() in old:
                rest = old[m.start()]
                break
            pieces.append(m.group())
        before = self.tables[first:rest]
        tables = []
        for k, p in enumerate(pieces):
            data = p.encode()
            table = before[k] if k < len(before) else PrefixTable(self.encoder.vocabulary)
            if table.data != data:  # keep what the old table shares with the new bytes
                a = 0
                while a < min(len(data), len(table.data)) and data[a] == table.data[a]:
                    a += 1
                table.replace(a, len(table.data), data[a:])
            tables.append(table)
        self.pieces[first:rest] = pieces
        self.tables[first:rest] = tables


_SHARED: dict[str | None, Encoder] = {}


def _shared(path: str | None) -> Encoder:
    if path not in _SHARED:
        gc.disable()  # the caches hold no cycles
        _SHARED[path] = Encoder(path)
    return _SHARED[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text is empty."""

    def run(batches):
        encoder = _shared(path)
        for part in slices(batches, "text"):
            ids = [list(chain.from_iterable(map(encoder.cache.__getitem__, f))) for f in encoder.split_all(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encode_documents' rows."""

    def run(batches):
        encoder = _shared(path)
        for batch in batches:
            texts = [encoder.decode(i or []).decode(errors="replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches):
        encoder = _shared(path)
        for part in slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for pieces in encoder.split_all(part.column("text").to_pylist()):
                ids = list(chain.from_iterable(map(encoder.cache.__getitem__, pieces)))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(encoder.joined.__getitem__, pieces)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha,
            })

    return _texts(docs).mapInArrow(run, SCHEMA)
