"""Highlighting of query terms in the fragments of a page of hits."""

from __future__ import annotations

import fnmatch
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+", re.UNICODE)


def fragments(text: str, terms: list[str], how: dict) -> list[str]:
    """Marked fragments of a text, in their order or by how many distinct terms they hold."""
    pre, post = (how.get("pre_tags") or ["<em>"])[0], (how.get("post_tags") or ["</em>"])[0]
    escape = html.escape if how.get("encoder") == "html" else lambda x: x
    exact, patterns = {t.lower() for t in terms if "*" not in t and "?" not in t}, [t.lower() for t in terms if "*" in t or "?" in t]
    spans = [(m.start(), m.end(), w) for m in _WORD.finditer(text) if (w := m[0].lower()) in exact or any(fnmatch.fnmatchcase(w, p) for p in patterns)]
    size, most = int(how.get("fragment_size", 100)), int(how.get("number_of_fragments", 5))
    if not spans:
        n = int(how.get("no_match_size", 0))
        return [escape(text[:n])] if n else []
    if most == 0:
        pieces = [(0, len(text))]
    elif how.get("type") == "plain" or how.get("boundary_scanner") in ("chars", "word"):
        pieces, at = [], 0
        for m in re.finditer(r"\S+\s*", text):
            if m.end() - at > size and m.start() > at:
                pieces.append((at, m.start()))
                at = m.start()
        pieces.append((at, len(text)))
    else:
        ends = [0, *[m.end() for m in re.finditer(r"[.!?]+\s+|\n+", text)], len(text)]
        pieces, at = [], 0
        for e in ends[1:]:
            if e - at >= size or e == len(text):
                pieces.append((at, e))
                at = e
    found = []
    for a, b in pieces:
        inside = [s for s in spans if a <= s[0] < b]
        if inside:
            out, at = "", a
            for s, e, _ in inside:
                out += escape(text[at:s]) + pre + escape(text[s:e]) + post
                at = e
            found.append((len({w for _, _, w in inside}), (out + escape(text[at:b])).strip()))
    if how.get("order") == "score":
        found.sort(key=lambda x: -x[0])
    return [x for _, x in found[: most or None]]


def highlighted(column: Column, terms: list[str], how: dict) -> Column:
    """Fragments of the column's text; a page of hits is small, so whole texts go to a vectorised UDF."""
    told = {k: v for k, v in how.items() if k != "fields" and k != "highlight_query"}

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fragments(str(t), terms, told))

    return of(column.cast("string"))
