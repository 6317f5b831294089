"""Scoring generated text against references (E*).

BLEU and the greedy embedding match are relational: n-grams / token vectors
are exploded, counted and joined on the pair key, so long texts cost linear
work and no row is processed quadratically.  ROUGE-Lsum needs a longest
common subsequence, which is an Arrow ``pandas_udf`` over pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.parallel import spread

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """Lower-case word tokens (letters/digits of any script)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda x: x != "")


def _ngram_structs(toks: Column, max_n: int) -> Column:
    """Array of (n, gram) for n = 1..max_n over a token array."""
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(max_n)),
        lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1))),
                                       lambda i: i <= F.size(toks) - n + 1),
                              lambda i: F.struct(n.alias("n"), F.array_join(F.slice(toks, i, n), " ").alias("gram")))))


def bleu(pairs: DataFrame, keys: str | list[str], pred: str, ref: str | list[str], max_n: int = 4) -> DataFrame:
    """Sentence BLEU (Papineni et al. 2002) per pair: clipped n-gram
    precisions 1..4, geometric mean, brevity penalty, no smoothing (a zero
    precision gives 0).  Returns (keys..., bleu, pred_len, ref_len).

    ``ref`` can name several reference columns: an n-gram's count is then
    clipped by the greatest of its counts in them, and ref_len is the length
    closest to the prediction's (the shorter of two equally close).

    The n-grams of all sides are exploded once into (keys, n, gram, side) and
    counted in a single aggregation, so the clipped counts need no join."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    refs = [ref] if isinstance(ref, str) else list(ref)
    sides = ["pt"] + [f"rt{k}" for k in range(len(refs))]
    t = spread(pairs.select(*keys, pred, *refs)).select(*keys, *[tokens(c).alias(s) for c, s in zip([pred, *refs], sides)])

    def side(k):
        return F.transform(_ngram_structs(F.col(sides[k]), max_n),
                           lambda s: F.struct(s["n"].alias("n"), s["gram"].alias("gram"), F.lit(k).alias("side")))

    grams = t.select(*keys, F.inline(F.concat(*[side(k) for k in range(len(sides))])))
    counts = [F.count_if(F.col("side") == k) for k in range(len(sides))]
    cnt = grams.groupBy(*keys, "n", "gram").agg(counts[0].alias("cp"), F.array_max(F.array(*counts[1:])).alias("cr"))
    clip = cnt.where(F.col("cp") > 0).groupBy(*keys, "n").agg(
        F.sum(F.least("cp", "cr")).alias("match"), F.sum("cp").alias("total"))
    logp = clip.groupBy(*keys).agg(
        F.sum(F.when(F.col("match") > 0, F.log(F.col("match") / F.col("total")))).alias("slog"),
        F.count_if(F.col("match") > 0).alias("n_pos"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.size(s) - F.size("pt")).alias("off"), F.size(s).alias("n")) for s in sides[1:]]))
    lens = t.select(*keys, F.size("pt").alias("pred_len"), near["n"].alias("ref_len"))
    j = lens.join(logp, keys, "left")
    bp = F.when(F.col("pred_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.col("ref_len") / F.col("pred_len")))
    score = F.when((F.col("pred_len") == 0) | (F.coalesce("n_pos", F.lit(0)) < max_n), F.lit(0.0)).otherwise(
        bp * F.exp(F.col("slog") / max_n))
    return j.select(*keys, score.alias("bleu"), "pred_len", "ref_len")


# ------------------------------------------------------------------ ROUGE-Lsum
def _lcs_rows(a: list[str], b: list[str]) -> list[int]:
    """Rows of the table of common-subsequence lengths as bit vectors: bit j
    of row i is set where the length of a[:i] and b[:j + 1] is one more than
    that of a[:i] and b[:j].  A row takes a few whole-word operations (Hyyro
    2004)."""
    places: dict[str, int] = {}
    for j, token in enumerate(b):
        places[token] = places.get(token, 0) | 1 << j
    whole = (1 << len(b)) - 1
    same, rows = whole, [0]
    for token in a:
        hit = same & places.get(token, 0)
        if hit:
            same = ((same + hit) | (same - hit)) & whole
        rows.append(whole ^ same)
    return rows


def _lcs_indices(a: list[str], b: list[str]) -> set[int]:
    """Indices into ``a`` of one longest common subsequence with ``b``: from
    the end, matches first, then the shorter ``a`` where it loses nothing."""
    rows = _lcs_rows(a, b)
    i, j, out = len(a), len(b), set()
    left = rows[i].bit_count()  # length for a[:i] and b[:j]
    while left:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j, left = i - 1, j - 1, left - 1
        elif rows[i] >> (j - 1) & 1 or (rows[i - 1] & ((1 << j) - 1)).bit_count() == left:
            i -= 1
            left = (rows[i] & ((1 << j) - 1)).bit_count()
        else:
            j -= 1
    return out


def _tok(s: str) -> list[str]:
    import regex

    return [x for x in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if x]


def rouge_lsum_py(pred: str | None, ref: str | None) -> float:
    """Summary-level union-LCS F1 over newline-separated sentences (Lin 2004):
    for each reference sentence the LCS token positions with every candidate
    sentence are united; hits are clipped by token counts on both sides."""
    if not pred or not ref:
        return 0.0
    rs = [_tok(s) for s in ref.split("\n")]
    cs = [_tok(s) for s in pred.split("\n")]
    rs = [s for s in rs if s]
    cs = [s for s in cs if s]
    r_len = sum(len(s) for s in rs)
    c_len = sum(len(s) for s in cs)
    if r_len == 0 or c_len == 0:
        return 0.0
    from collections import Counter

    r_cnt = Counter(t for s in rs for t in s)
    c_cnt = Counter(t for s in cs for t in s)
    hits = 0
    for r in rs:
        union: set[int] = set()
        for c in cs:
            union |= _lcs_indices(r, c)
        for idx in sorted(union):
            tok = r[idx]
            if r_cnt[tok] > 0 and c_cnt[tok] > 0:
                hits += 1
                r_cnt[tok] -= 1
                c_cnt[tok] -= 1
    p, rc = hits / c_len, hits / r_len
    return 0.0 if p + rc == 0 else 2 * p * rc / (p + rc)


@F.pandas_udf(T.DoubleType())
def rouge_lsum(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([rouge_lsum_py(a, b) for a, b in zip(pred, ref)], dtype="float64")


def unigram_f1(pred: str | Column, ref: str | Column) -> Column:
    """Overlap F1 of the distinct tokens, native array functions."""
    pt, rt = F.array_distinct(tokens(pred)), F.array_distinct(tokens(ref))
    common = F.size(F.array_intersect(pt, rt))
    p = common / F.size(pt)
    r = common / F.size(rt)
    return F.when((F.size(pt) == 0) | (F.size(rt) == 0) | (common == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


# ------------------------------------------------------------------ greedy embedding match
def cosine(a: str | Column, b: str | Column) -> Column:
    ac = F.col(a) if isinstance(a, str) else a
    bc = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(ac, bc, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, x: s + x)
    na = F.sqrt(F.aggregate(ac, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(bc, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (na * nb)


def greedy_match(cand: DataFrame, ref: DataFrame, key: str, tok: str, vec: str) -> DataFrame:
    """Precision/recall/F1 of greedy cosine matching between the token
    vectors of a candidate and of a reference text (Zhang et al. 2020):
    P = mean over candidate tokens of the best match in the reference, R the
    other way.  The join is on the pair key, so work is per pair."""
    c = cand.select(key, F.col(tok).alias("ct"), F.col(vec).alias("cv"))
    r = ref.select(key, F.col(tok).alias("rt"), F.col(vec).alias("rv"))
    sims = c.join(r, key).select(key, "ct", "rt", cosine("cv", "rv").alias("s"))
    p = sims.groupBy(key, "ct").agg(F.max("s").alias("m")).groupBy(key).agg(F.avg("m").alias("precision"))
    rc = sims.groupBy(key, "rt").agg(F.max("s").alias("m")).groupBy(key).agg(F.avg("m").alias("recall"))
    j = p.join(rc, key)
    return j.select(key, "precision", "recall",
                    (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1"))


# ------------------------------------------------------------------ composite
def composite(f1: Column, rouge: Column, bleu_: Column) -> Column:
    """0.5 F1 + 0.3 ROUGE + 0.2 BLEU."""
    return F.lit(0.5) * f1 + F.lit(0.3) * rouge + F.lit(0.2) * bleu_


def composite_total(eng: Column, mk: Column) -> Column:
    """0.6 engineering + 0.4 marketing."""
    return F.lit(0.6) * eng + F.lit(0.4) * mk
