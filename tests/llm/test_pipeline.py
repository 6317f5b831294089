"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from tessera.llm import near_dedup, packing, quality_rules, toxicity
from tessera.llm.word_bpe import tokenizer
from tests.llm.test_near_dedup import _brute as near_brute
from tests.llm.test_quality_rules import _brute as quality_brute


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _stages(spark, docs, sf_dir, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def _check(spark, docs, sf_dir, folder):
    (d0, d1), (_, d2), (_, d3), (_, d4) = _stages(spark, docs, sf_dir, folder)
    for d in (d1, d2, d3):
        assert d.dtypes == d0.dtypes
    # quality rules
    rows = [(r.doc_id, r.text, r.source) for r in d0.collect()]
    kept = {r[0] for r in quality_brute(rows, quality_rules.Limits()) if r[7]}
    assert _rows(d1) == sorted((tuple(r) for r in d0.collect() if r.doc_id in kept), key=repr)
    # toxicity: documents with a score under the threshold stay
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.train(d1, labels))
    assert _rows(d2) == sorted((tuple(r) for r in d1.collect() if scorer.text(r.text or "")[0] < 0.7), key=repr)
    # near copies
    first = {r[0] for r in near_brute([(r.doc_id, r.text) for r in d2.collect()]) if r[3]}
    left = [r.doc_id for r in d3.collect()]
    assert sorted(left, key=repr) == sorted(first, key=repr)
    # packing: every id of every document, once
    tok = tokenizer()
    n = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in d3.collect()}
    got = Counter()
    for r in d4.collect():
        got[r.doc_id] += r.length
    assert got == n
    return [x.count() for x in (d0, d1, d2, d3)]


def test_fixture(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = _check(spark, docs, sf_dir, tmp_path)
    assert n[0] > n[1] >= n[2] > n[3] > 0


def test_odd_rows(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()
    rows = [tuple(r) for r in some]
    rows += [rows[3], rows[3], (None, "a long enough text of no id " * 3 + " ".join(f"w{i}" for i in range(60)), None, None, None), (None, None, None, None, None),
             (-1, "", "en", "src0", 0), (-2, " ".join(f"v{i}" for i in range(40000)), "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _check(spark, docs, sf_dir, tmp_path)


def test_empty_table(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [d.count() for _, d in _stages(spark, docs, sf_dir, tmp_path)] == [0] * 4


def test_run_is_the_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [f.split()[0] for f in packing.SCHEMA.split(", ")] and got.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "packing"]
    assert near_dedup.Params().percent == 80
