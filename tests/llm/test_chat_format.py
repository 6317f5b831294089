"""Layouts by fingerprint, reversible escapes, spans and digests."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as m

U, A, S = "user", "assistant", "system"
RECORDS = [
    ({"messages": [{"role": "human", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [(U, "hi"), (A, "yo")]),
    ({"messages": [{"role": "user", "text": "hi", "id": 4}, {"role": "Bot", "text": None}], "source": {"x": [1]}}, "messages_text", [(U, "hi"), (A, "")]),
    ({"system": "be kind", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "human", "value": "c"}]},
     "from_value", [(S, "be kind"), (U, "a"), (A, "b"), (U, "c")]),
    ({"conversations": [{"from": "gpt", "value": "b"}]}, "from_value", [(A, "b")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction_output", [(U, "do\n\nthis"), (A, "done")]),
    ({"instruction": "do", "input": "", "output": "done", "id": 3}, "instruction_output", [(U, "do"), (A, "done")]),
    ({"output": "done", "instruction": "do"}, "instruction_output", [(U, "do"), (A, "done")]),
    ({"system": "s", "instruction": "do", "output": None}, "instruction_output", [(S, "s"), (U, "do"), (A, "")]),
    ({"instruction": "q", "context": "c", "response": "r"}, "instruction_response", [(U, "c\n\nq"), (A, "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": "c"}, "prompt_response", [(U, "p"), (A, "c")]),
    ({"question": "p", "answer": 7}, "question_answer", [(U, "p"), (A, "7")]),
    ({"prompt": {"text": "p", "lang": "en"}, "reply": {"text": "r"}}, "nested_prompt", [(U, "p"), (A, "r")]),
    ({"turn": 3, "role": "tool", "text": "t"}, "turn_rows", [("tool", "t")]),
    ({"messages": []}, None, []),
    ({"messages": "text"}, None, []),
    ({"prompt": "p"}, None, []),
    ({}, None, []),
]
NASTY = ["", "</turn>", "<turn>", "<\\/turn>", "<\\\\says>", "a</turn>\nb", "<</turn>>", "\\### Assistant: </turn> ok", "<tur", "n>",
         "</turn>\n<turn>assistant<says>no", "$1 \\1 \\$", "日本</turn>é", "\\", "<says><says>", "\n", "x" * 100_000 + "</turn>"]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)]
    d = spark.createDataFrame(rows + [(90, "no json"), (91, None), (92, "[1]")], "conv_id long, record string")
    got = {}
    for r in m.canonical_turns(d.selectExpr("*", "1 AS turn", "2 AS fp")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(RECORDS) if turns}
    # a variant column gives the same
    v = m.canonical_turns(d.select("conv_id", F.try_parse_json("record").alias("record")))
    assert sorted(map(str, v.collect())) == sorted(map(str, m.canonical_turns(d).collect()))
    seen = [(r.layout, r.n_records) for r in m.layouts(d).collect()]
    assert ("from_value", 1) in seen and sum(n for _, n in seen) == len(rows) + 3
    unknown = {r.paths for r in m.layouts(d).where("layout IS NULL").collect()}
    assert None in unknown or "" in unknown


def test_paths_and_fingerprints(spark):
    d = spark.createDataFrame([('{"a":[{"b":{"c":1}},{"d e":2}],"`":{"x":[[{"y":1}]]}}',)], "r string")
    r = d.select(F.parse_json("r").alias("v")).select(m.field_paths(F.col("v")).alias("p"), m.fingerprint(F.col("v")).alias("f")).first()
    assert r.p == ["`", "`.x", "`.x[][].y", "a", "a[].b", "a[].b.c", "a[].d e"]
    assert r.f == m.fingerprint_of([])
    assert len(m.fingerprints_of()) == sum(2 ** len(x.optional) for x in m.MAPPINGS)
    with pytest.raises(ValueError):
        m.fingerprints_of((m.MAPPINGS[1], m.Mapping("same", turns="messages", role="role", text="content")))


def test_escapes_are_reversible(spark):
    r = random.Random(5)
    texts = NASTY + ["".join(r.choices(["<", "\\", "/turn>", "turn>", "says>", "x", "\n"], k=r.randint(1, 12))) for _ in range(500)]
    t = m.Template()
    d = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e")).select("x", "e", t.unescape(F.col("e")).alias("b"))
    for row in d.collect():
        assert row.b == row.x
        assert not any(c in row.e for c in (t.open, t.says, t.close))
    with pytest.raises(ValueError):
        m.Template(says="says")


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_format_and_read_back(spark):
    rows = [(1, i, (U, A, S)[i % 3], x) for i, x in enumerate(NASTY)]
    rows += [(2, 0, A, None), (3, 1, None, "x"), (3, None, A, "first"), (4, 0, "</turn>", "odd role"), (5, 0, A, "b"), (5, 0, A, "a"), (5, 0, A, "a"),
             (None, 0, A, "alone"), (None, 0, A, "alone"), (6, 0, U, "</turn>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    record = F.to_variant_object(F.struct("turn", "role", "text"))
    f = m.format_turns(m.canonical_turns(d.select("conv_id", record.alias("record")))).cache()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    back = f.select("conv_id", "formatted", "spans", m.read_back(F.col("formatted")).alias("t"), m.loss_texts(F.col("formatted"), F.col("spans")).alias("l"))
    got = back.collect()
    assert len(got) == 8
    for r in got:
        turns = [tuple(x) for x in r.t]
        assert turns == ([(A, "alone")] if r.conv_id is None else want[r.conv_id])
        assert r.l == [x for role, x in turns if role == A and x]
        for s, (role, text) in zip(r.spans, turns, strict=True):
            part = r.formatted[s.start:s.start + s.length]
            assert (part == "") if role != A else re.sub(r"<\\(\\*)(/?turn>|says>)", r"<\1\2", part) == text
            assert r.formatted[:s.start].endswith("<says>")
    n = {r.conv_id: r for r in m.conversation_digests(d.selectExpr("*", "'x' AS formatted", "1 AS alone")).where("conv_id IS NOT NULL").collect()}
    for c, turns in want.items():
        if c is not None:
            text = "".join(x for role, x in turns if role == A)
            assert (n[c].n_turns, n[c].turns_sha256) == (len(turns), _sha("".join(f"{a}\n{b}\n" for a, b in turns)))
            assert (n[c].loss_chars, n[c].loss_sha256) == (len(text), _sha(text))
    assert m.conversation_digests(d.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir, duck):
    from tessera.llm.queries import QUERIES
    q = QUERIES["op12_chat_format"](spark, sf_dir)
    assert sorted(map(tuple, q.collect())) == sorted(duck.sql(m.ORACLE_SQL).fetchall())
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
