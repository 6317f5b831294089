"""Phrase places and diagonal voting against brute force."""

import re

from tessera.llm import licenses as m

MIT = dict(m.TEMPLATES)["mit-text"]
ROWS = [
    (1, "Intro words. Licensed under CC BY-NC 4.0. End", "a"),
    (2, "Nothing here but a license of no name and cc of byte", "a"),
    (3, "x " * 40 + MIT.replace("this software and", "this one software or") + " tail", "a"),
    (4, MIT[:90], "a"),
    (5, None, "a"),
    (6, "", None),
    (None, "MIT  License\n\nmit-license, Apache\tLICENSE é", "a"),
    (7, "gnu general public license " * 300, "a"),
    (7, "gnu general public license " * 300, "a"),
    (8, "lorem " * 30000 + "Released under the MIT License.", "a"),
]


def _places(text):
    """The definition: every word number where a phrase's words stand."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    out = []
    for i in range(len(words)):
        for p, label in m.PHRASES.items():
            w = p.split()
            if words[i:i + len(w)] == w:
                out.append((i, label))
    return len(words), out


def test_phrases_and_labels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, template string")
    got = m.scan_licenses(docs).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (doc, text, _) in zip(sorted(got, key=key), sorted(ROWS, key=key)):
        n, places = _places(text)
        assert (r.doc_id, r.n_words, r.n_base) == (doc, n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 if places else True)
    by = {r.doc_id: r.labels for r in got}
    assert by[1] == "cc-by,cc-by-nc-4.0"
    assert by[2] == "" and by[4] == "" and by[5] == "" and by[6] == ""
    assert by[3] == "mit-text"
    assert by[8] == "mit,mit-line"


def test_span_of_an_edited_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, template string")
    r = m.license_spans(docs).filter("doc_id = 3").collect()
    assert [(x.template, x.first_word) for x in r] == [("mit-text", 40)]
    # one word more and one in place of another: only the latter's place of the template is bare
    n = len(m.license_words(MIT))
    assert r[0].last_word == 40 + n and 0.9 < r[0].covered < 1


def test_empty_table(spark):
    assert m.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_grams_stay_inside_texts():
    texts = [t.encode().split() for t in ("a b c d", "a b", "", "b c d", "x y z a b c d")]
    hashes, offsets = m.Grams().of(texts)
    alone = [m.Grams().of([t])[0].tolist() for t in texts]
    assert [hashes[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == alone
    assert alone[3] == alone[0][1:] and alone[4][-2:] == alone[0]


def test_fixture_labels(spark, sf_dir):
    got = m.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert any(r.labels != r.base_labels for r in got)
    assert all(r.score == 0 for r in got if not r.labels)


def test_versions_and_kin_are_told_apart(spark):
    lines = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 1.", "gpl"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ""),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("Licensed under the Apache License, Version 1.1.", "apache"),
        ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 3.0.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-notice"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ""),
        ("Released under the MIT-0 License.", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        # words around the deciding ones may differ
        ("This work was licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        # both versions stand here
        ("This work is licensed under the GNU General Public License, version 2. " + "word " * 9
         + "This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-2.0,gpl-3.0"),
    ]
    docs = spark.createDataFrame([(i, f"some words before. {t} And some behind.") for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in m.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(lines))] == [want for _, want in lines]


def test_every_template_gives_its_label(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(m.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in m.scan_licenses(docs).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(m.TEMPLATES))
    assert set(m.DECIDING) <= {label for label, _ in m.TEMPLATES}
