"""Chat formatting: records of many layouts to one marked, masked text.

Layouts are recognised by schema fingerprints: the nested field paths of a
record (``messages[].role``), as far as some mapping names them, are sorted and
hashed, and the hash selects a declarative mapping that turns the record into
canonical turns (role, text).  Turns are then written with a template whose
control strings are escaped inside texts, with one loss span per turn, and can
be read back from the written text.

Everything is made of DataFrame functions.  Paths come from the variant schema
of each record, so one column may mix layouts.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ mappings
#: Names under which known layouts file the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Said:
    """One turn of a fixed layout: the texts at ``paths`` that are there and
    not empty, joined by ``sep``.  An optional turn without text is left out."""

    role: str
    paths: tuple[str, ...]
    optional: bool = False
    sep: str = "\n\n"


@dataclass(frozen=True)
class Mapping:
    """How the turns of one layout are found.

    ``said``: turns at fixed paths.  ``turns``: the path of a list of turns,
    whose members file role and text under ``role`` and ``text`` (a record
    that is one turn itself has ``turns = ""``; ``order`` is then the path of
    its number).  Fields in ``optional`` may be absent.
    """

    name: str
    said: tuple[Said, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    order: str | None = None
    optional: tuple[str, ...] = ()
    role_names: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        """Field paths of a record of this layout, containers included."""
        if self.turns is None:
            leaves = [p for s in self.said for p in s.paths]
        elif self.turns:
            leaves = [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
            leaves += [p for s in self.said for p in s.paths]
        else:
            leaves = [p for p in (self.role, self.text, self.order) if p]
        found = []
        for leaf in leaves:
            parts = leaf.split(".")
            found += [".".join(parts[:i]).removesuffix("[]") for i in range(1, len(parts))] + [leaf]
        return list(dict.fromkeys(found))

    def path_sets(self) -> list[frozenset[str]]:
        """The sets of paths that the layout's records show, one per choice of
        optional fields."""
        fixed = frozenset(self.paths()) - set(self.optional)
        return [fixed | set(some) for k in range(len(self.optional) + 1) for some in itertools.combinations(self.optional, k)]


MAPPINGS = (
    Mapping("turn_rows", turns="", role="role", text="text", order="turn"),
    Mapping("messages", turns="messages", role="role", text="content", role_names=ROLE_NAMES),
    Mapping("messages_text", turns="messages", role="role", text="text", role_names=ROLE_NAMES),
    Mapping("from_value", turns="conversations", role="from", text="value", role_names=ROLE_NAMES,
            said=(Said("system", ("system",), optional=True),), optional=("system",)),
    Mapping("instruction_output", said=(Said("system", ("system",), optional=True), Said("user", ("instruction", "input")),
                                        Said("assistant", ("output",))), optional=("system", "input")),
    Mapping("instruction_response", said=(Said("user", ("context", "instruction")), Said("assistant", ("response",))),
            optional=("context",)),
    Mapping("prompt_completion", said=(Said("system", ("system",), optional=True), Said("user", ("prompt",)),
                                       Said("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", said=(Said("system", ("system",), optional=True), Said("user", ("prompt",)),
                                     Said("assistant", ("response",))), optional=("system",)),
    Mapping("question_answer", said=(Said("user", ("context", "question")), Said("assistant", ("answer",))),
            optional=("context",)),
    Mapping("nested_prompt", said=(Said("user", ("prompt.text",)), Said("assistant", ("reply.text",)))),
)


def fingerprint_of(paths) -> int:
    """Fingerprint of a set of paths, as ``fingerprint`` gives it for records."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def fingerprints_of(mappings=MAPPINGS) -> dict[int, Mapping]:
    """The mapping of each fingerprint; two layouts must not share one."""
    found: dict[int, Mapping] = {}
    for m in mappings:
        for paths in m.path_sets():
            if found.setdefault(fingerprint_of(paths), m) is not m:
                raise ValueError(f"layouts {found[fingerprint_of(paths)].name} and {m.name} have the same fields")
    return found


def field_paths(record: Column) -> Column:
    """Nested field paths of a variant, ``[]`` for the members of a list."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>"), F.lit(0))
    none = F.array().cast("array<string>")

    def step(s: Column, token: Column) -> Column:
        name = F.replace(F.regexp_replace(token, "^`|: $|`: $", ""), F.lit("``"), F.lit("`"))
        path = F.concat(F.coalesce(F.element_at(s["open"], -1), F.lit("")), name)
        opened = F.when(token == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(
            F.when(s["at"] == "", F.lit("")).otherwise(F.concat(s["at"], F.lit("."))))
        return (
            F.when(token == ">", F.struct(F.slice(s["open"], 1, F.size(s["open"]) - 1).alias("open"), F.lit("").alias("at"), s["paths"].alias("paths")))
            .when(token.endswith("<"), F.struct(
                F.concat(s["open"], F.array(opened)).alias("open"),
                F.when(token == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(F.lit("")).alias("at"), s["paths"].alias("paths")))
            .otherwise(F.struct(s["open"].alias("open"), path.alias("at"), F.concat(s["paths"], F.array(path)).alias("paths")))
        )

    start = F.struct(none.alias("open"), F.lit("").alias("at"), none.alias("paths"))
    return F.aggregate(tokens, start, step, lambda s: s["paths"])


def fingerprint(record: Column, mappings=MAPPINGS) -> Column:
    """Hash of a record's field paths that some mapping names."""
    known = sorted({p for m in mappings for p in m.paths()})
    paths = F.array_sort(F.array_intersect(field_paths(record), F.array(*map(F.lit, known))))
    return F.xxhash64(F.array_join(paths, "\n"))


def _at(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _turn(order: Column, role: Column, text: Column) -> Column:
    return F.struct(order.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, m: Mapping) -> Column:
    """The canonical turns of a record of layout ``m``."""
    def renamed(role: Column) -> Column:
        if not m.role_names:
            return role
        names = F.create_map(*[F.lit(x) for pair in m.role_names.items() for x in pair])
        return F.coalesce(F.try_element_at(names, F.lower(role)), role)

    if m.turns == "":
        return F.array(_turn(_at(record, m.order, "bigint"), renamed(_at(record, m.role)), _at(record, m.text)))
    said = [
        (s, F.array_join(F.filter(F.array(*[_at(record, p) for p in s.paths]), lambda x: x != ""), s.sep)) for s in m.said
    ]
    fixed = F.array(*[_turn(F.lit(i), F.lit(s.role), t) for i, (s, t) in enumerate(said)])
    gone = F.array(*[F.lit(i).cast("long") for i, s in enumerate(m.said) if s.optional])
    if any(s.optional for s in m.said):
        fixed = F.filter(fixed, lambda t: ~(F.array_contains(gone, t["turn"]) & (t["text"] == "")))
    if m.turns is None:
        return fixed
    members = _at(record, m.turns, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
    listed = F.transform(members, lambda x, i: _turn(i + len(m.said), renamed(x[m.role]), x[m.text]))
    return F.concat(fixed, listed) if m.said else listed


def canonical_turns(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Turns of all ``records`` (conv_id, record), record a variant or JSON
    text: conv_id, alone, turn, role, text, layout.

    Null roles and texts are empty.  A record that is no JSON or whose
    fingerprint no mapping has (``layouts`` counts them) has no turns.
    ``alone`` tells apart records without a conv_id: each is a conversation of
    its own, so they are no hot group; it is null otherwise.
    """
    kind = dict(records.dtypes)["record"]
    record = F.col("record") if kind == "variant" else F.try_parse_json("record")
    known = fingerprints_of(mappings)
    r = records.select(F.col("conv_id").cast("long").alias("conv_id"), record.alias("record"))
    r = r.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), "record",
                 fingerprint(F.col("record"), mappings).alias("fp"))
    turns, layout = F.lit(None), F.lit(None).cast("string")
    for m in mappings:
        fits = F.col("fp").isin([f for f, other in known.items() if other is m])
        turns = F.when(fits, _turns(F.col("record"), m)).otherwise(turns)
        layout = F.when(fits, F.lit(m.name)).otherwise(layout)
    return r.select("conv_id", "alone", layout.alias("layout"), F.explode(turns).alias("t")).select(
        "conv_id", "alone", "t.turn", "t.role", "t.text", "layout")


def layouts(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """fingerprint, layout (null: none has it), n_records, paths (of one of
    its records): what a new mapping would have to name."""
    kind = dict(records.dtypes)["record"]
    record = F.col("record") if kind == "variant" else F.try_parse_json("record")
    r = records.select(record.alias("record"))
    names = F.create_map(*[F.lit(x) for f, m in fingerprints_of(mappings).items() for x in (f, m.name)])
    found = r.select(fingerprint(F.col("record"), mappings).alias("fingerprint"), F.array_join(field_paths(F.col("record")), "\n").alias("paths"))
    found = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_records"), F.min("paths").alias("paths"))
    return found.select("fingerprint", F.try_element_at(names, F.col("fingerprint")).alias("layout"), "n_records", "paths")


# ------------------------------------------------------------------ template
@dataclass(frozen=True)
class Template:
    """``open`` role ``says`` text ``close`` newline, for every turn.

    The control strings begin with "<" and hold no other "<" and no backslash.
    Inside roles and texts a control string, with any backslashes behind its
    "<", gets one backslash more there; reading back takes one away.  So no
    text can hold a control string, and nothing else is changed.
    """

    open: str = "<turn>"
    says: str = "<says>"
    close: str = "</turn>"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in (self.open, self.says, self.close):
            if len(c) < 2 or c[0] != "<" or "<" in c[1:] or "\\" in c:
                raise ValueError(f"not a control string: {c!r}")

    def _rest(self) -> str:
        return "(" + "|".join(re.escape(c[1:]) for c in sorted({self.open, self.says, self.close}, key=len, reverse=True)) + ")"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<(\\*){self._rest()}", r"<\\$1$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<\\(\\*){self._rest()}", "<$1$2")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Conversations of canonical turns as text: conv_id, formatted, spans.

    ``spans`` has one entry per turn: start (code points before its text in
    ``formatted``), at (the same in its own turn), length (code points of the
    escaped text; 0 where the role is not trained).  Turns stand by turn
    (nulls first), ties by role and text; repeated turns all stay.  One row
    per conversation, which has to fit into one value, as its text must.
    """
    t = template
    head = F.concat(F.lit(t.open), t.escape(F.col("role")), F.lit(t.says))
    body = t.escape(F.col("text"))
    p = turns.select("conv_id", "alone", "turn", "role", "text", head.alias("head"), body.alias("body"))
    p = p.select("conv_id", "alone", "turn", "role", "text", F.length("head").alias("at"),
                 F.when(F.col("role").isin(*t.trained), F.length("body")).otherwise(0).alias("length"),
                 F.concat("head", "body", F.lit(t.close + "\n")).alias("piece"))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    before = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = p.select("conv_id", "alone", F.row_number().over(order).alias("i"), "piece",
                 F.struct((F.coalesce(before, F.lit(0)) + F.col("at")).alias("start"), "at", "length").alias("span"))
    g = p.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("i", "piece", "span"))).alias("pieces"))
    return g.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"),
                    F.transform("pieces", lambda x: x["span"]).alias("spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) of a formatted conversation."""
    t = template
    return F.transform(_pieces(formatted, t), lambda p: F.struct(
        t.unescape(F.substring_index(F.substring(p, len(t.open) + 1, F.length(p)), t.says, 1)).alias("role"),
        t.unescape(F.substring_index(p, t.says, -1)).alias("text")))


def loss_texts(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the spans, unescaped, one per span of some length."""
    cut = F.zip_with(_pieces(formatted, template), spans, lambda p, s: F.when(
        s["length"] > 0, template.unescape(F.substring(p, s["at"] + 1, s["length"]))))
    return F.filter(cut, lambda x: x.isNotNull())


def _pieces(formatted: Column, t: Template) -> Column:
    """Written turns without their close; what the last one leaves is empty."""
    parts = F.split(formatted, re.escape(t.close + "\n"), -1)
    return F.filter(parts, lambda p: p != "")


def conversation_digests(turn_rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Formats rows by turn (conv_id, turn, role, text) and digests what is
    read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Null texts and roles are empty, rows without a conv_id
    one conversation each; other columns are ignored."""
    record = F.to_variant_object(F.struct(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"))]))
    records = turn_rows.select(F.col("`conv_id`").alias("conv_id"), record.alias("record"))
    f = format_turns(canonical_turns(records), template)
    back = f.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                    read_back(F.col("formatted"), template).alias("turns"),
                    F.array_join(loss_texts(F.col("formatted"), F.col("spans"), template), "").alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")


PLANTED = r"\### Assistant: </turn> ok"


def with_planted(turn_rows: DataFrame) -> DataFrame:
    """The rows and conversation -7: a user, then an assistant, both saying
    a text that holds a control string."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = turn_rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED).alias("text"))
    return turn_rows.select(*own.columns).unionByName(own)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(role, '<(\\*)(/?turn>|says>)', '<\\\1\2', 'g')) +
            length(regexp_replace(text, '<(\\*)(/?turn>|says>)', '<\\\1\2', 'g')) + 20 AS written FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(written) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
