"""Counts against the library; every proved string is one token."""

import random

from tessera.llm import token_counts as m
from tessera.llm.word_bpe import tokenizer


def test_proved_strings():
    tok, whole = tokenizer(), m.whole_tokens()
    assert len(whole) > 20_000 and {"the", "é"} <= whole
    some = random.Random(1).sample(sorted(whole), 3000)
    assert all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in some)
    # proved strings next to others stay one token each
    for s in some[:500]:
        assert len(tok.encode(f"{s} qzx {s}", add_special_tokens=False).ids) == 2 + len(tok.encode("qzx", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, sf_dir):
    odd = [(None, "no id"), (-1, None), (-2, ""), (-2, ""), (-3, "word " * 3000), (-4, "<|endoftext|> İ ²½ \x1c ΣΑΣ don't"), (-5, "日本 語\n"), (-6, "w" * 50000)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    tok = tokenizer()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = []
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    got = [tuple(r) for r in m.count_tokens(docs.selectExpr("*", "1 AS n_tokens")).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert m.count_tokens(docs.limit(0)).count() == 0


def test_cache_limit_keeps_counts_right():
    tok, counts = tokenizer(), m.ChunkCounts(m.whole_tokens(), limit=10)
    texts = [f"plainword{i} some x{i}!" for i in range(300)]
    assert [counts.texts([t])[0] for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
