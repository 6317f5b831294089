"""Ids of the lower-casing word BPE, one white-space chunk at a time.

The tokenizer's own steps (NFC, lower case, split, merges) never look across
white space, so the ids of a text are the ids of its chunks in order.  For
texts made of characters on which Python and the library agree about letters,
lower case and white space, a chunk is encoded once and reused; any other text
(and one that holds a special token's string) goes to the library whole.
"""

from __future__ import annotations

import json
import re
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MODEL = "word_bpe_49k.json"

# ASCII without control characters but tab, line feed, vertical tab, form feed
# and return; Latin-1 and Latin Extended-A without the letters-like digits and
# signs, soft hyphen, no-break space and dotted capital I; general punctuation
# without spaces and format characters; the euro sign.
_UNSAFE = re.compile(
    "[^\x09-\x0d\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ňŊ-ž"
    "‐-‖‘-‧‰-‸€]"
)

_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def tokenizer(path: str | None = None) -> Tokenizer:
    return Tokenizer.from_file(path or public_tokenizers.path(MODEL))


def bare(path: str | None = None) -> Tokenizer:
    """The merges alone, for strings that are one pre-token each."""
    conf = json.loads(Path(path or public_tokenizers.path(MODEL)).read_text())
    split = {"type": "WhitespaceSplit"}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    conf |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}}
    return Tokenizer.from_str(json.dumps(conf))


def plain(text: str, specials: tuple[str, ...]) -> bool:
    """Whether the chunk-wise way is exact for this text."""
    return not (_UNSAFE.search(text) or any(s in text for s in specials))


def pre_tokens(chunk: str) -> list[str]:
    """Pre-tokens of a lower-case chunk without white space."""
    return [chunk] if chunk.isalpha() else _PRE.findall(chunk)


class ChunkIds:
    """Packed little-endian unsigned 32-bit ids of texts.

    Those of chunks are kept in two generations of up to ``limit`` entries: when
    the younger is full, the older goes, so memory is bounded whatever the
    vocabulary of the corpus, and what is in use stays.
    """

    def __init__(self, path: str | None = None, limit: int = 150_000):
        self.tok, self.merges = tokenizer(path), bare(path)
        self.specials = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.limit = limit
        vocab = self.merges.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def _pack(self, ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded together and cut where one ends."""
        found = self.merges.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(parts) or ends[-1] != 4 * len(ids):  # an end inside a pre-token: each by itself
            return [self._pack(e.ids) for e in self.merges.encode_batch_fast(parts, add_special_tokens=False)]
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that neither generation holds."""
        parts = [pre_tokens(c) for c in chunks]
        known: dict[str, bytes] = {"": b""}
        new = []
        for p in set(chain.from_iterable(parts)):
            ids = self.young.get(p) or self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        for a in range(0, len(new), 20_000):
            some = new[a:a + 20_000]
            known.update(zip(some, self._merged(some)))
        get = known.__getitem__
        return {c: get(c) if len(ps) == 1 and ps[0] == c else b"".join(map(get, ps)) for c, ps in zip(chunks, parts)}

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        young, old = self.young, self.old
        found = [young.get(c) for c in chunks]
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = old.get(chunks[i])
            if found[i] is None:
                new.append(i)
        learnt = self._learn([chunks[i] for i in new])
        for i in new:
            found[i] = learnt[chunks[i]]
        for a in range(0, len(missing), self.limit):
            if len(self.young) > self.limit:
                self.young, self.old = {}, self.young
            self.young.update((chunks[i], found[i]) for i in missing[a:a + self.limit])
        return found

    def texts(self, texts: list[str]) -> list[bytes]:
        fit = [plain(t, self.specials) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t, ok in zip(texts, fit) if ok], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        ids = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        start = np.cumsum(size) - size
        flat, which = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        ends = np.cumsum(size[which])
        # of each id of the texts, its place among those of the distinct chunks
        at = np.repeat(start[which] - ends + size[which], size[which])
        at += np.arange(len(at))
        data = flat[at].tobytes()
        bounds = 4 * np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        cuts = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        out = []
        for t, ok in zip(texts, fit):
            if ok:
                a, b = next(cuts)
                out.append(data[a:b])
            else:
                out.append(self._pack(self.tok.encode(t, add_special_tokens=False).ids))
        return out


_SHARED: dict[str | None, ChunkIds] = {}


def shared(path: str | None = None) -> ChunkIds:
    """The worker process's own encoder, loaded once.  A task calls ``clear`` at
    its end, so that an idle worker keeps the vocabulary only."""
    if path not in _SHARED:
        _SHARED[path] = ChunkIds(path)
    return _SHARED[path]
