"""Pieces against the library's ids, the level choice against its definition."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing as m
from tessera.llm.word_bpe import ChunkIds, _UNSAFE, tokenizer


@pytest.mark.parametrize("seed", range(4))
def test_choice_has_the_smallest_sum_of_squares(seed):
    r, levels = random.Random(seed), m.Levels(12)
    for _ in range(200):
        s = r.randint(1, 11)
        n = levels.count.copy()
        sums = {}
        for h in range(12 - s + 1):
            if h and not n[h]:
                continue
            after = n.copy()
            if h:
                after[h] -= 1
            if h + s < 12:
                after[h + s] += 1
            sums[h] = int((after[1:12] ** 2).sum())
        chosen = levels.choose(s)
        assert sums[chosen] == min(sums.values())
        levels.place(s, None)
        assert levels.count[12] == 0 and {h: len(w) for h, w in levels.open.items() if w} == {int(h): int(levels.count[h]) for h in np.flatnonzero(levels.count)}


def _check(windows, docs, size):
    got = defaultdict(list)
    for w in windows:
        n = sum(len(p[2]) // 4 for p in w)
        assert 0 < n <= size and all(p[2] for p in w)
        assert n == size or n & (n - 1) == 0  # nothing to pad
        for doc, start, ids, total in w:
            got[doc].append((start, ids, total))
    for doc, ids in docs:
        parts = sorted(got.pop(doc, []))
        assert b"".join(p[1] for p in parts) == ids and all(p[2] == len(ids) // 4 for p in parts)
        assert [p[0] for p in parts] == np.cumsum([0] + [len(p[1]) // 4 for p in parts[:-1]]).tolist()
    assert not got


@pytest.mark.parametrize("size", [1, 2, 7, 16, 64])
def test_every_id_lies_in_one_piece(size):
    r = random.Random(size)
    for n in (0, 1, 2, 30, 200):
        docs = [(i, struct.pack(f"<{k}I", *(r.getrandbits(32) for _ in range(k)))) for i in range(n) for k in [r.choice([1, 3, 9, size, 5 * size + 2])]]
        _check(list(m.pack(iter(docs), size)), docs, size)


def test_few_documents_are_cut():
    r = random.Random(5)
    docs = [(i, bytes(4 * max(1, int(r.expovariate(1 / 700))))) for i in range(4000)]
    short = {i for i, ids in docs if len(ids) <= 4 * 4096}
    parts = defaultdict(int)
    for w in m.pack(iter(docs), 4096):
        for p in w:
            parts[p[0]] += 1
    assert sum(parts[i] > 1 for i in short) < 0.05 * len(short)


def test_ids_equal_the_library():
    chunks, tok = ChunkIds(), tokenizer()
    r = random.Random(6)
    pool = [chr(i) for i in (*range(1, 0x250), *range(0x2000, 0x2070), 0x20AC, 0x301, 0x3A3)]
    safe = [c for c in pool if not _UNSAFE.search(c)]
    texts = ["".join(r.choices(p + [" "] * 40 + list("'sdtmrevl") * 5, k=40)) for p in (pool, safe) for _ in range(1500)]
    texts += ["", "it's WE'LL 'S", "<|endoftext|> x", "İ ΣΑΣ ²½", "...!!! a1b2 _x_ don’t", "\x1ca\x1d", "word " * 3]
    assert chunks.texts(texts) == [chunks._pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_do_not_depend_on_the_generations():
    """Generations far smaller than the vocabulary, slice after slice."""
    r, tok = random.Random(7), tokenizer()
    small, large = ChunkIds(limit=20), ChunkIds()
    for _ in range(30):
        words = ["".join(r.choices("abcdé.,'1_", k=r.randint(1, 6))) for _ in range(60)]
        texts = [" ".join(r.choices(words, k=r.randint(0, 80))) for _ in range(8)]
        want = [large._pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]
        assert small.texts(texts) == want == large.texts(texts)
        assert len(small.young) <= 40 + 60 and len(small.old) <= 40 + 60
    small.clear()
    assert small.texts([]) == [] and small.texts(["", " \n"]) == [b"", b""] and small.texts(texts) == want


def test_documents(spark, sf_dir):
    odd = [(None, "no id"), (-1, None), (-2, ""), (-3, "many words here " * 9000), (-4, "<|startoftext|>")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = m.pack_documents(docs.selectExpr("*", "1 AS length")).collect()
    tok = tokenizer()
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    again = m.pack_documents(docs.filter("doc_id = -2").union(docs.filter("doc_id = -2"))).collect()
    assert [(r.doc_id, r.length) for r in again] == [(-2, 1)] * 2
    assert m.pack_documents(docs.limit(0)).count() == 0
