"""Prefix tables against tiktoken, and exactness of appends and edits."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm.byte_bpe import EncodedText, Encoder, PrefixTable, decode_documents, encode_documents, read_ranks, round_trip


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


ODD = ["", " ", "\n\n  x", "it's we'll 'r 're x'", "<|endoftext|>", "日本 語", "a\x00b", "é", "👩‍👩‍👧 😀😀", "aaaaaaaaaaaaaaaaaaaa", "  \t \n", "²³½ Ⅷ"]


def _random(n, seed):
    r = random.Random(seed)
    pool = "abcdefgh eioun  '\n.,;!0123éßñ日😀" + "the and ing tion re's"
    return ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(encoder, library):
    for t in ODD + _random(1500, 1):
        assert encoder.encode(t) == library.encode_ordinary(t), t
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_every_prefix_has_its_encoding(encoder, library):
    data = " internationalisation"
    table = PrefixTable(encoder.vocabulary, data.encode())
    for n in range(1, len(data) + 1):
        assert table.ids(n) == library.encode_ordinary(data[:n])


def test_append_and_replace_are_exact(encoder, library):
    r = random.Random(2)
    for t, more in zip(_random(200, 3), _random(200, 4)):
        e = EncodedText(encoder, t)
        e.append(more)
        assert e.text == t + more and e.ids() == library.encode_ordinary(t + more)
        whole = t + more
        for _ in range(4):
            a, b = sorted((r.randint(0, len(whole)), r.randint(0, len(whole))))
            new = more[:r.randint(0, 5)]
            whole = whole[:a] + new + whole[b:]
            e.replace(a, b, new)
            assert e.text == whole and e.ids() == library.encode_ordinary(whole)


def test_table_edit_keeps_entries(encoder):
    data = bytes(random.Random(5).choices(b"abcdet in", k=600))
    table = PrefixTable(encoder.vocabulary, data)
    table.replace(100, 103, b"zq")
    assert table.last == PrefixTable(encoder.vocabulary, data[:100] + b"zq" + data[103:]).last


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, None, "x"), (3, "again " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        h = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i is None, i or 0, len(ids), h(" ".join(map(str, ids)).encode()), h((t or "").encode())))
    assert got == sorted(want)
    back = decode_documents(encode_documents(docs))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert round_trip(docs.limit(0)).count() == 0
