"""Fuzzy score: local alignment with affine gaps (Smith and Waterman 1981, Gotoh 1982)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The scorer's constants.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND, WORD_START, PREFIX, EXACT = 12, -6, -5, -1, 4, 12, 8


def scores(texts: list[str], query: str) -> np.ndarray:
    """Score of each text, case ignored; 0 where nothing aligns. All texts advance together, a column at a time."""
    q = [ord(c) for c in query.lower()]
    if not q or not texts:
        return np.zeros(len(texts), np.int32)
    low = [t.lower() for t in texts]
    width = max(map(len, low))
    codes = np.zeros((len(low), width + 1), np.int64)
    for i, t in enumerate(low):
        codes[i, 1 : len(t) + 1] = [ord(c) for c in t]
    word = np.zeros_like(codes, bool)
    kind = np.vectorize(lambda c: chr(c).isalnum() if c else False, otypes=[bool])(np.unique(codes))
    alnum = kind[np.searchsorted(np.unique(codes), codes)]
    word[:, 1:] = alnum[:, 1:] & ~alnum[:, :-1]
    m, rows = len(q), len(low)
    floor = -(10**6)
    best = np.zeros(rows, np.int32)
    h = np.zeros((rows, m + 1), np.int32)
    gap_text = np.full((rows, m + 1), floor, np.int32)
    query_codes = np.array(q)
    for j in range(1, width + 1):
        c = codes[:, j]
        same = c[:, None] == query_codes
        gain = np.where(same, MATCH, MISMATCH) + np.where(same & word[:, j : j + 1], WORD_START, 0)
        gain[:, 0] += np.where(same[:, 0] & (j == 1), PREFIX, 0)
        gap_text[:, 1:] = np.maximum(gap_text[:, 1:] + GAP_EXTEND, h[:, 1:] + GAP_OPEN)
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + gain, gap_text[:, 1:]), 0)
        run = np.full(rows, floor, np.int32)
        for i in range(1, m + 1):  # gaps in the query depend on the cell before
            run = np.maximum(run + GAP_EXTEND, new[:, i - 1] + GAP_OPEN)
            np.maximum(new[:, i], run, out=new[:, i])
        new[c == 0] = 0
        h = new
        np.maximum(best, h.max(axis=1), out=best)
    exact = np.array([t == query.lower() for t in low])
    return best + np.where(exact, EXACT, 0).astype(np.int32)


def score_column(text: Column, query: str) -> Column:
    """Score of each text in Arrow batches; 0 for null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scores([t or "" for t in texts], query))

    return run(text)
