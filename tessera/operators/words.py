"""Word-rack matching and scoring over a word table (K6, K7).

A word can be played from a rack with ``w`` wildcards when the letters it
needs beyond the rack's counts number at most ``w``.  This is independent of
the order in which letters are consumed, so it is a per-word expression of 26
letter counts: no Python loop, and the word table can be any size.
"""

from __future__ import annotations

import string
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import letter_count
from tessera.operators.parallel import spread

# Letter scores.
LETTER_VALUES = {
    "a": 1, "b": 3, "c": 3, "d": 2, "e": 1, "f": 4, "g": 2, "h": 4, "i": 1, "j": 8, "k": 5, "l": 1, "m": 3,
    "n": 1, "o": 1, "p": 3, "q": 10, "r": 1, "s": 1, "t": 1, "u": 1, "v": 4, "w": 4, "x": 8, "y": 4, "z": 10,
}


def ascii_words(df: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case words made only of the letters a-z."""
    toks = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word")
    return spread(df.select(text)).select(toks).where(F.col("word").rlike("^[a-z]+$")).distinct()


def _rack_counts(rack: str) -> Counter:
    r = Counter(c for c in rack.lower() if c in string.ascii_lowercase)
    return r


def playable(word: str | Column, rack: str, wildcards: int) -> Column:
    """Letters needed beyond the rack <= wildcards (and length pre-filter)."""
    w = F.col(word) if isinstance(word, str) else word
    rc = _rack_counts(rack)
    need = F.lit(0)
    for ch in string.ascii_lowercase:
        need = need + F.greatest(letter_count(w, ch) - F.lit(rc.get(ch, 0)), F.lit(0))
    return (F.length(w) <= F.lit(sum(rc.values()) + wildcards)) & (need <= F.lit(wildcards))


def wildcard_letters(word: str | Column, rack: str) -> Column:
    """Letters of the word covered by wildcards, in word order: an occurrence
    is a wildcard when earlier occurrences already used the rack's copies."""
    w = F.col(word) if isinstance(word, str) else word
    rc = _rack_counts(rack)
    rack_map = F.create_map(*[x for ch in string.ascii_lowercase for x in (F.lit(ch), F.lit(rc.get(ch, 0)))])

    def at(i):
        ch = F.substring(w, i, 1)
        prefix = F.substring(w, 1, i)
        seen = F.length(prefix) - F.length(F.replace(prefix, ch, F.lit("")))
        return F.when(seen > F.coalesce(F.try_element_at(rack_map, ch), F.lit(0)), ch).otherwise(F.lit(""))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), at), "")


def score(word: str | Column, rack: str, values: dict[str, int] = LETTER_VALUES) -> Column:
    """Sum over letters of min(count in word, count in rack) * value:
    wildcard-covered letters score 0."""
    w = F.col(word) if isinstance(word, str) else word
    rc = _rack_counts(rack)
    total = F.lit(0)
    for ch in string.ascii_lowercase:
        if rc.get(ch, 0):
            total = total + F.least(letter_count(w, ch), F.lit(rc[ch])) * F.lit(values[ch])
    return total
