"""Base counts and line frequency against brute force, and the SQL twin."""

import re
from collections import Counter, defaultdict

import duckdb

from tessera.llm import quality_rules as m
from tessera.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {p for i, g in enumerate(windows) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def _line_words(text):
    out = Counter()
    for x in (text or "").split("\n"):
        w = WORD.findall(x)
        if w:
            out[" ".join(w).lower()] += len(w)
    return out


def _brute(rows, limits):
    docs = {(d, s, t) for d, t, s in rows}
    host = Counter(s for _, _, s in rows)
    where = defaultdict(list)
    for d, s, t in docs:
        for x in _line_words(t):
            where[s, x].append((d is not None, d or 0, d, t))
    out = []
    for d, t, s in rows:
        removed = 0
        for x, n in _line_words(t).items():
            k = len(where[s, x])
            if k > limits.min_docs and (k > limits.max_docs or k > host[s] * limits.max_share):
                removed += n * (min(where[s, x], key=lambda y: y[:2])[2] != d)
        n, chars, symbols, dup, rep = _counts(t)
        failed = n < 50 or 100 * rep > 50 * n
        out.append((d, n, chars, symbols, dup, rep, failed, not failed and removed <= n * limits.max_removed, removed))
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_odd_rows(spark):
    many = "Same header for all\n" + "\n".join(f"common line number {i} of the page" for i in range(9))
    rows = [(i, f"{many}\nown words {i} " + "x y z " * (i % 3), "h") for i in range(30)]
    rows += [(i, " ".join(f"w{i}_{j}" for j in range(80)) + "\nsame HEADER  for all", "g") for i in range(40, 60)]
    rows += [(100, None, "h"), (101, "", "h"), (102, " \t\n\x0b ", None), (103, "a b c a b c a b c", None), (104, "a\nb\na\n a\n\n\n", None),
             (105, "é#ü* $%&|<> 日本 " * 40, "h"), (106, "one two three " * 9000, "h"), (107, "u\xa0v\x85w x\x1cy z", "h")]
    rows += [rows[45], rows[45], (None, many, "h")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    for limits in (m.Limits(), m.Limits(max_docs=25, min_docs=4, max_share=0.9, max_removed=0.2)):
        assert _sorted(m.quality_rules(docs, limits).collect()) == _sorted(_brute(rows, limits))
    assert m.quality_rules(docs.limit(0)).count() == 0


def test_sql_twin(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = queries.op1_quality_rules(spark, sf_dir)
    rel = con.sql(m.ORACLE_SQL)
    assert rel.columns == got.columns
    assert _sorted(got.collect()) == _sorted(rel.fetchall())


def test_lines_go_from_the_text(spark):
    rows = [(i, f"Boiler  plate\nown text {i}\n\nboiler plate", "h") for i in range(20)] + [(99, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.clean_text for r in m.remove_lines(docs).collect()}
    assert got[0] == rows[0][1] and got[7] == "own text 7\n" and got[99] is None


def test_native_plan(spark, sf_dir):
    plan = queries.op1_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
