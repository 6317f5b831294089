"""Retrieval and text-scoring queries (R*, X19, X20, E*).

Question set = one query per embedding label: the label's centroid vector
(a bounded set, one row per label).  Corpus = every embedding; the text of a
retrieved vector is the document with doc_id = vec_id (whole text).
Answer pairs for scoring = each assistant turn of a conversation with the
latest preceding user turn of the same conversation.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as RT
from tessera.operators import textscore as TS
from tessera.operators import vector_index as VI
from tessera.plans.common import tables
from tessera.plans.registry import query

# Prompt templates (ours, written for these queries).
PROMPT = "Use the context to answer.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"
AUDIENCE_TEMPLATES = {
    "engineering": "You are briefing engineers. Be precise.\n\nContext:\n{context}\n\nQuestion: {question}",
    "marketing": "You are briefing marketers. Be brief.\n\nContext:\n{context}\n\nQuestion: {question}",
}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_CENTROIDS_SQL = """(SELECT label AS query_label, list(v ORDER BY pos) AS query_vec FROM (
  SELECT label, pos, avg(x) AS v FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)
  GROUP BY label)"""


def _topk_sql(k: int, threshold: float | None = None) -> str:
    thr = f" WHERE score >= {threshold}" if threshold is not None else ""
    return f"""(SELECT query_label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT c.query_label, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.query_vec), 4) AS score
    FROM embeddings e CROSS JOIN {_CENTROIDS_SQL} c){thr}) WHERE rank <= {k})"""


def _queries(t):
    return RT.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "query_label")


def _topk(spark, sf_dir, k, threshold=None):
    t = tables(spark, sf_dir)
    return RT.topk_similarity(t.embeddings, "vec_id", "embedding", _queries(t), "query_label", "query_vec", k,
                              threshold=threshold)


def _question(col="query_label"):
    return F.concat(F.lit("What is known about topic "), F.col(col).cast("string"), F.lit("?"))


_QUESTION_SQL = "'What is known about topic ' || CAST(query_label AS VARCHAR) || '?'"


# ------------------------------------------------------------------ chunking
@query(
    "chunk_fixed",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS split_id, CAST(st AS INTEGER) AS start,
       substring(text, st + 1, 256) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 240)) AS st,
             unnest(range(1, len(range(0, greatest(length(text), 1), 240)) + 1)) AS i FROM documents)
WHERE length(substring(text, st + 1, 256)) > 0""",
)
def chunk_fixed(spark, sf_dir):
    """256-character chunks with 16 characters of overlap, whole documents."""
    d = tables(spark, sf_dir).documents
    return RT.chunk_fixed(d, "text", 256, 16, keep=["doc_id"])


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    """Recursive-separator chunks (paragraph, line, word, character), size 256, overlap 16."""
    d = tables(spark, sf_dir).documents
    return RT.chunk_recursive(d, "doc_id", "text", 256, 16)


# ------------------------------------------------------------------ retrieval
@query("retrieve_topk", f"SELECT * FROM {_topk_sql(4)} t")
def retrieve_topk(spark, sf_dir):
    return _topk(spark, sf_dir, 4).select("query_label", "vec_id", "score", "rank")


@query("retrieve_threshold", f"SELECT * FROM {_topk_sql(4, 0.3)} t")
def retrieve_threshold(spark, sf_dir):
    return _topk(spark, sf_dir, 4, threshold=0.3).select("query_label", "vec_id", "score", "rank")


@query("retrieve_mmr")
def retrieve_mmr(spark, sf_dir):
    """MMR (lambda 0.5) over the top-20 candidates of each query, k = 6."""
    t = tables(spark, sf_dir)
    q = _queries(t)
    cands = RT.topk_similarity(t.embeddings, "vec_id", "embedding", q, "query_label", "query_vec", 20)
    full = cands.join(t.embeddings.select("vec_id", "embedding"), "vec_id").join(q, "query_label")
    return RT.mmr_rerank(full, "query_label", "vec_id", "embedding", "query_vec", 6, 0.5)


def _every_50th(t):
    """The stated query set: every vector whose id is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


_EVERY_50TH_SQL = """(SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]),
           CAST(q.embedding AS DOUBLE[])), 4) AS score
    FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0)) WHERE rank <= 10)"""


@query("retrieve_blocks", f"SELECT * FROM {_EVERY_50TH_SQL} t")
def retrieve_blocks(spark, sf_dir):
    """Exact top-10 of a query table against every vector, in blocks."""
    t = tables(spark, sf_dir)
    return VI.exact_topk(t.embeddings, "vec_id", "embedding", _every_50th(t), "query_id", "query_vec", 10).select(
        "query_id", "vec_id", "score", "rank")


def _indexed(spark, sf_dir):
    t = tables(spark, sf_dir)
    index = VI.build_index(t.embeddings, "vec_id", "embedding")
    q = _every_50th(t)
    probes = VI.probes_for(index, q, "query_id", "query_vec", 10, target=0.95)
    return VI.search(index, q, "query_id", "query_vec", 10, probes), q


@query("retrieve_index")
def retrieve_index(spark, sf_dir):
    """Top-10 of the same query table through the inverted file over all
    vectors, with as many probed cells as 0.95 of the neighbours need."""
    return _indexed(spark, sf_dir)[0].select("query_id", "vec_id", "score", "rank")


@query("retrieve_index_recall")
def retrieve_index_recall(spark, sf_dir):
    """Share of the exact top-10 that the index finds, per rank."""
    found, q = _indexed(spark, sf_dir)
    exact = VI.exact_topk(tables(spark, sf_dir).embeddings, "vec_id", "embedding", q, "query_id", "query_vec", 10)
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("rank").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))


def _context(spark, sf_dir, k=4):
    """Context per question; a retrieved vector without a document counts as
    an empty text and stays among the sources."""
    t = tables(spark, sf_dir)
    top = _topk(spark, sf_dir, k)
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    j = top.join(docs, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    ctx = RT.context_of(j, "query_label", "rank", "text")
    src = j.groupBy("query_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("sources"))
    return ctx.join(src, "query_label")


_CTX_SQL = f"""(SELECT t.query_label, string_agg(coalesce(d.text, ''), chr(10) || chr(10) ORDER BY t.rank) AS context,
  list(t.vec_id ORDER BY t.rank) AS sources FROM {_topk_sql(4)} t LEFT JOIN documents d ON d.doc_id = t.vec_id
  GROUP BY t.query_label)"""


@query("context_join", f"SELECT query_label, context FROM {_CTX_SQL} c")
def context_join(spark, sf_dir):
    return _context(spark, sf_dir).select("query_label", "context")


@query(
    "prompt_fill",
    f"SELECT query_label, replace(replace({_sql_str(PROMPT)}, '{{context}}', context), '{{question}}', "
    f"{_QUESTION_SQL}) AS prompt FROM {_CTX_SQL} c",
)
def prompt_fill(spark, sf_dir):
    c = _context(spark, sf_dir)
    return c.select("query_label", RT.fill(PROMPT, context=F.col("context"), question=_question()).alias("prompt"))


@query(
    "rag_prompts",
    f"SELECT query_label, {_QUESTION_SQL} AS question, replace(replace({_sql_str(PROMPT)}, '{{context}}', context), "
    f"'{{question}}', {_QUESTION_SQL}) AS prompt, sources FROM {_CTX_SQL} c",
)
def rag_prompts(spark, sf_dir):
    """Retrieve -> context -> prompt for every question, with provenance."""
    c = _context(spark, sf_dir)
    return c.select("query_label", _question().alias("question"),
                    RT.fill(PROMPT, context=F.col("context"), question=_question()).alias("prompt"), "sources")


@query(
    "prompts_by_audience",
    "SELECT c.query_label, a.audience, replace(replace(a.tpl, '{context}', c.context), '{question}', "
    + _QUESTION_SQL.replace("query_label", "c.query_label")
    + f") AS prompt FROM {_CTX_SQL} c CROSS JOIN (VALUES "
    + ", ".join(f"('{k}', {_sql_str(v)})" for k, v in AUDIENCE_TEMPLATES.items())
    + ") a(audience, tpl)",
)
def prompts_by_audience(spark, sf_dir):
    c = _context(spark, sf_dir)
    tpl = F.array(*[F.struct(F.lit(k).alias("audience"), F.lit(v).alias("tpl")) for k, v in AUDIENCE_TEMPLATES.items()])
    ex = c.select("query_label", "context", F.inline(tpl))
    return ex.select("query_label", "audience",
                     RT.fill(F.col("tpl"), context=F.col("context"), question=_question()).alias("prompt"))


_SWEEP_K = [2, 4, 6, 8, 10, 12]
_SWEEP_T = [-1.0, 0.36, 0.4]


@query(
    "retrieval_sweep",
    f"""SELECT cfg.k, cfg.threshold, count(*) FILTER (WHERE t.rank <= cfg.k AND t.score >= cfg.threshold) AS n_retrieved,
  round(sum(t.score) FILTER (WHERE t.rank <= cfg.k AND t.score >= cfg.threshold), 4) AS sum_score,
  round(avg(CAST(e.label = t.query_label AS DOUBLE)) FILTER (WHERE t.rank <= cfg.k AND t.score >= cfg.threshold), 6)
    AS precision
FROM {_topk_sql(12)} t JOIN embeddings e ON e.vec_id = t.vec_id
CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({k})' for k in _SWEEP_K)}) a(k)
            CROSS JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _SWEEP_T)}) b(threshold)) cfg
GROUP BY cfg.k, cfg.threshold""",
)
def retrieval_sweep(spark, sf_dir):
    """One result row per retriever configuration (k x score threshold), all
    from one cached top-12 retrieval."""
    t = tables(spark, sf_dir)
    top = _topk(spark, sf_dir, 12).join(t.embeddings.select("vec_id", "label"), "vec_id")
    cfg = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("threshold")) for k in _SWEEP_K for x in _SWEEP_T])
    ex = top.select("*", F.inline(cfg))
    ok = (F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("threshold"))
    return ex.groupBy("k", "threshold").agg(
        F.count_if(ok).alias("n_retrieved"),
        F.round(F.sum(F.when(ok, F.col("score"))), 4).alias("sum_score"),
        F.round(F.avg(F.when(ok, (F.col("label") == F.col("query_label")).cast("double"))), 6).alias("precision"))


# ------------------------------------------------------------------ text scoring
_PAIRS_SQL = """(SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'engineering' ELSE 'marketing' END AS audience,
  text AS prediction, reference FROM (
    SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference
    FROM conversations) WHERE role = 'assistant' AND reference IS NOT NULL)"""


def answer_pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = t.conversations.select(
        "*", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("reference"))
    return c.where((F.col("role") == "assistant") & F.col("reference").isNotNull()).select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "engineering").otherwise("marketing").alias("audience"),
        F.col("text").alias("prediction"), "reference")


_TOK = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _grams_sql(col: str) -> str:
    return f"""(SELECT conv_id, turn, n, array_to_string(tk[i:i + n - 1], ' ') AS gram, count(*) AS cnt
  FROM (SELECT conv_id, turn, {_TOK.format(c=col)} AS tk FROM p) q
  CROSS JOIN range(1, 5) r(n) CROSS JOIN LATERAL generate_series(1, len(tk) - n + 1) g(i) GROUP BY ALL)"""


_BLEU_SQL = f"""
WITH p AS {_PAIRS_SQL},
pg AS {_grams_sql('prediction')}, rg AS {_grams_sql('reference')},
clip AS (SELECT pg.conv_id, pg.turn, pg.n, sum(least(pg.cnt, coalesce(rg.cnt, 0))) AS m, sum(pg.cnt) AS total
         FROM pg LEFT JOIN rg ON pg.conv_id = rg.conv_id AND pg.turn = rg.turn AND pg.n = rg.n AND pg.gram = rg.gram
         GROUP BY ALL),
lp AS (SELECT conv_id, turn, sum(CASE WHEN m > 0 THEN ln(m / total) END) AS slog, count(*) FILTER (WHERE m > 0) AS n_pos
       FROM clip GROUP BY ALL),
lens AS (SELECT conv_id, turn, CAST(len({_TOK.format(c='prediction')}) AS INTEGER) AS pred_len,
                CAST(len({_TOK.format(c='reference')}) AS INTEGER) AS ref_len FROM p)
SELECT lens.conv_id, lens.turn, round(CASE WHEN pred_len = 0 OR coalesce(n_pos, 0) < 4 THEN 0.0
  ELSE (CASE WHEN pred_len > ref_len THEN 1.0 ELSE exp(1.0 - ref_len / pred_len) END) * exp(slog / 4) END, 6) AS bleu,
  pred_len, ref_len
FROM lens LEFT JOIN lp ON lens.conv_id = lp.conv_id AND lens.turn = lp.turn
"""


@query("bleu", _BLEU_SQL)
def bleu(spark, sf_dir):
    """Sentence BLEU of each assistant answer against the preceding user turn."""
    p = answer_pairs(tables(spark, sf_dir))
    b = TS.bleu(p, ["conv_id", "turn"], "prediction", "reference")
    return b.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"), "pred_len", "ref_len")


@query("rouge_lsum")
def rouge_lsum(spark, sf_dir):
    """ROUGE-Lsum F1 per answer pair (Arrow pandas UDF)."""
    p = answer_pairs(tables(spark, sf_dir))
    return p.select("conv_id", "turn", TS.rouge_lsum("prediction", "reference").alias("rouge_lsum"))


_GM_SQL = """
WITH e AS (SELECT vec_id, embedding, vec_id // 8 AS block FROM embeddings),
s AS (SELECT c.block AS pair_id, c.vec_id AS ct, r.vec_id AS rt,
             list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS s
      FROM e c JOIN e r ON r.block = c.block + 1),
p AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, ct, max(s) AS m FROM s GROUP BY ALL) GROUP BY ALL),
r AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, rt, max(s) AS m FROM s GROUP BY ALL) GROUP BY ALL)
SELECT p.pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p JOIN r ON p.pair_id = r.pair_id
"""


@query("greedy_match_f1", _GM_SQL)
def greedy_match_f1(spark, sf_dir):
    """Greedy cosine matching between two "texts" of token vectors: blocks of
    8 consecutive embeddings, each block (candidate) against the next one
    (reference); every block takes part, the work per pair is 8 x 8."""
    e = tables(spark, sf_dir).embeddings.select("vec_id", "embedding", F.floor(F.col("vec_id") / 8).alias("block"))
    cand = e.select("vec_id", "embedding", F.col("block").alias("pair_id"))
    ref = e.select("vec_id", "embedding", (F.col("block") - 1).alias("pair_id"))
    g = TS.greedy_match(cand, ref, "pair_id", "vec_id", "embedding")
    return g.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("evaluate_set")
def evaluate_set(spark, sf_dir):
    """Per conversation: BLEU, ROUGE-Lsum and token F1 for each audience,
    pivoted to eng_* / mk_* columns, plus the composite scores."""
    p = answer_pairs(tables(spark, sf_dir))
    b = TS.bleu(p, ["conv_id", "turn"], "prediction", "reference").select("conv_id", "turn", "bleu")
    scored = p.join(b, ["conv_id", "turn"]).select(
        "conv_id", "audience", "bleu", TS.rouge_lsum("prediction", "reference").alias("rouge"),
        TS.unigram_f1("prediction", "reference").alias("f1"))
    aud = {"engineering": "eng", "marketing": "mk"}
    aggs = []
    for a, pre in aud.items():
        for m in ("bleu", "rouge", "f1"):
            aggs.append(F.avg(F.when(F.col("audience") == a, F.col(m))).alias(f"{pre}_{m}"))
    per = scored.groupBy("conv_id").agg(*aggs)
    eng = TS.composite(F.col("eng_f1"), F.col("eng_rouge"), F.col("eng_bleu"))
    mk = TS.composite(F.col("mk_f1"), F.col("mk_rouge"), F.col("mk_bleu"))
    return per.select("*", eng.alias("composite_eng"), mk.alias("composite_mk"),
                      TS.composite_total(eng, mk).alias("composite_total"))


_COMP = "0.5 * l_discount + 0.3 * l_tax + 0.2 * (l_quantity / 50)"


@query(
    "composite_score",
    f"SELECT l_suppkey AS config, round(avg({_COMP}) FILTER (WHERE l_linestatus = 'O'), 9) AS composite_eng, "
    f"round(avg({_COMP}) FILTER (WHERE l_linestatus = 'F'), 9) AS composite_mk, "
    f"round(0.6 * avg({_COMP}) FILTER (WHERE l_linestatus = 'O') + 0.4 * avg({_COMP}) FILTER (WHERE l_linestatus = 'F'), 9)"
    f" AS composite_total FROM lineitem GROUP BY 1",
)
def composite_score(spark, sf_dir):
    """Composite 0.5 F1 + 0.3 ROUGE + 0.2 BLEU per row (F1 = discount, ROUGE =
    tax, BLEU = quantity/50), averaged per configuration (supplier) and
    audience (line status O = engineering, F = marketing), total 0.6/0.4."""
    li = tables(spark, sf_dir).lineitem
    c = TS.composite(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    eng = F.avg(F.when(F.col("l_linestatus") == "O", c))
    mk = F.avg(F.when(F.col("l_linestatus") == "F", c))
    return li.groupBy(F.col("l_suppkey").alias("config")).agg(
        F.round(eng, 9).alias("composite_eng"), F.round(mk, 9).alias("composite_mk"),
        F.round(TS.composite_total(eng, mk), 9).alias("composite_total"))


@query(
    "sweep_rank",
    f"SELECT l_suppkey AS config, round(avg({_COMP}), 9) AS mean_composite FROM lineitem GROUP BY 1 "
    f"ORDER BY mean_composite DESC, config",
)
def sweep_rank(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    c = TS.composite(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    return li.groupBy(F.col("l_suppkey").alias("config")).agg(F.round(F.avg(c), 9).alias("mean_composite")).orderBy(
        F.desc("mean_composite"), "config")
