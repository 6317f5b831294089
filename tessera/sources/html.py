"""HTML page to text (S11): keep the text inside selected elements, drop
navigation, scripts, styles and ad blocks.  Runs per partition with the
standard-library parser through ``mapInPandas``; fetching pages is out of
scope (pages arrive as a table)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators.parallel import spread

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Extractor(HTMLParser):
    def __init__(self, keep_tags: Sequence[str], keep_classes: Sequence[str], drop_tags: Sequence[str],
                 drop_classes: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.keep_tags, self.keep_classes = set(keep_tags), set(keep_classes)
        self.drop_tags, self.drop_classes = set(drop_tags), set(drop_classes)
        self.stack: list[tuple[str, bool, bool]] = []  # (tag, keeps, drops)
        self.keep_depth = 0
        self.drop_depth = 0
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = set()
        for k, v in attrs:
            if k == "class" and v:
                classes |= set(v.split())
        keeps = tag in self.keep_tags or bool(classes & self.keep_classes)
        drops = tag in self.drop_tags or bool(classes & self.drop_classes)
        self.stack.append((tag, keeps, drops))
        self.keep_depth += keeps
        self.drop_depth += drops

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        # pop to the matching tag (tolerates unclosed children)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for t, k, d in self.stack[i:]:
                    self.keep_depth -= k
                    self.drop_depth -= d
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.keep_depth > 0 and self.drop_depth == 0:
            self.out.append(data)


def extract_text(html: str | None, keep_tags=("article",), keep_classes=(), drop_tags=("nav", "script", "style"),
                 drop_classes=("ad",)) -> str:
    if not html:
        return ""
    p = _Extractor(keep_tags, keep_classes, drop_tags, drop_classes)
    p.feed(html)
    p.close()
    return re.sub(r"\s+", " ", " ".join(p.out)).strip()


def html_to_text(df: DataFrame, id_col: str, html_col: str, keep_cols: Sequence[str] = (), **kw) -> DataFrame:
    fields = [df.schema[id_col]] + [df.schema[c] for c in keep_cols] + [T.StructField("text", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[id_col, *keep_cols]].copy()
            out["text"] = [extract_text(h, **kw) for h in b[html_col]]
            yield out

    return spread(df.select(id_col, *keep_cols, html_col)).mapInPandas(run, schema)
