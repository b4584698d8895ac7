"""Matched and unmatched parts of a snippet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,kind:string>>"


def needles(query: str) -> list[str]:
    """The phrase and its terms in lower case, longest in bytes first, each once."""
    phrase = query.strip().lower()
    found = dict.fromkeys([phrase, *phrase.split()]) if phrase else {}
    return sorted(found, key=lambda n: -len(n.encode()))


def segments(text: str, query: str) -> list[tuple[str, str]]:
    """(text, ``match`` or ``plain``) parts that join to the text; case is ignored, the longest needle wins.

    A character whose lower case is longer or shorter stays whole: a match begins and ends at characters of the text.
    """
    wanted = needles(query)
    if not wanted:
        return [(text, "plain")]
    low, begins = "", {}
    for i, c in enumerate(text):
        begins[len(low)] = i
        low += c.lower()
    begins[len(low)] = len(text)
    out: list[tuple[str, str]] = []
    done = 0
    at = 0
    while at < len(low):
        if at in begins:
            n = next((n for n in wanted if low.startswith(n, at) and at + len(n) in begins), None)
            if n is not None:
                start, end = begins[at], begins[at + len(n)]
                if done < start:
                    out.append((text[done:start], "plain"))
                out.append((text[start:end], "match"))
                done, at = end, at + len(n)
                continue
        at += 1
    if done < len(text):
        out.append((text[done:], "plain"))
    return out


def segments_column(text: Column, query: str) -> Column:
    """Segments of each text; Arrow batches, meant for the rows of a limited hit list. Null for null."""

    @F.pandas_udf(SEGMENTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": x, "kind": k} for x, k in segments(t, query)])

    return run(text)
