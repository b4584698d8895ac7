"""Bigram statistics of chunks and the candidate predicates they give.

Which bigrams are tracked depends on how many chunks hold them; that table has at most two kinds of 69 * 69 keys,
whatever the corpus. A chunk's bigrams are never stored: a tracked pair is tested on the searchable text itself,
which stays inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..plans.grams import And, Any, Or, Pair, Probes, Query, pairs_of

# The density rules.
RARE, SKIP_PERCENT, UBIQUITOUS_TENTHS = 2, 12, 9


def frequencies(items: DataFrame, text: str = "text_norm_ascii") -> DataFrame:
    """(skip, key, df): in how many rows each pair of printable bytes stands, next to each other or one apart.

    Counted per Arrow batch before the shuffle, which then carries a few thousand rows a task. Rows without text
    hold no pair; rows must be distinct.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cp.slices(whole, text):
                codes, offsets = cp.to_codes(batch.column(text))
                low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.int64)
                printable = (codes >= 32) & (codes <= 126)
                row = cp.row_of(offsets)
                for skip in (False, True):
                    n = 1 + skip
                    both = printable[:-n] & printable[n:] & (row[:-n] == row[n:])
                    seen = np.unique((row[:-n] << 16 | low[:-n] << 8 | low[n:])[both])
                    key, df = np.unique(seen & 0xFFFF, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), skip)), pa.array(key.astype(np.int32)), pa.array(df)], ["skip", "key", "df"])

    return items.select(text).mapInArrow(run, "skip boolean, key int, df long").groupBy("skip", "key").agg(F.sum("df").alias("df"))


def sizes(items: DataFrame, text: str = "text_norm_ascii") -> DataFrame:
    """One row: all items, and those of two bytes and more."""
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.octet_length(text) >= 2).alias("populated"))


def tracked(df: DataFrame, size: DataFrame) -> DataFrame:
    """The pairs worth testing: neither rare nor in nearly all items."""
    rare = F.col("df") * 4 < F.ceil(F.col("items") / 64) * (4 * RARE)
    sparse = F.col("df") * 100 < F.col("populated") * SKIP_PERCENT
    everywhere = F.col("df") * 10 >= F.col("populated") * UBIQUITOUS_TENTHS
    return df.crossJoin(F.broadcast(size)).where(~everywhere & F.when(F.col("skip"), ~sparse).otherwise(~rare)).select("skip", "key", "df")


@dataclass(frozen=True)
class BigramIndex:
    """The tracked pairs, on the driver: at most 9,522 keys."""

    pairs: frozenset[Pair]

    @classmethod
    def build(cls, items: DataFrame, text: str = "text_norm_ascii") -> BigramIndex:
        """Index of distinct items (chunk_id and text)."""
        rows = tracked(frequencies(items, text), sizes(items, text)).collect()
        return cls(frozenset(Pair(r["key"] >> 8, r["key"] & 0xFF, r["skip"]) for r in rows))

    def knows(self, pair: Pair) -> bool:
        return pair in self.pairs


def has_pair(pair: Pair, text: Column) -> Column:
    """The text holds the pair."""
    a, b = chr(pair.a), chr(pair.b)
    return text.rlike(f"(?s){re.escape(a)}.{re.escape(b)}") if pair.skip else text.contains(a + b)


def literal_candidates(index: BigramIndex, needle: str, text: Column) -> Column | None:
    """Every tracked pair of the needle is there; None if none is tracked."""
    known = [p for p in pairs_of(needle) if index.knows(p)]
    out = None
    for p in known:
        out = has_pair(p, text) if out is None else out & has_pair(p, text)
    return out


def evaluate(index: BigramIndex, query: Query, text: Column) -> Column | None:
    """A bigram query as a predicate; None where the index says nothing."""
    if isinstance(query, Any):
        return None
    if isinstance(query, Pair):
        return has_pair(query, text) if index.knows(query) else None
    parts = [evaluate(index, q, text) for q in query.of]
    if isinstance(query, Or) and any(p is None for p in parts):
        return None
    known = [p for p in parts if p is not None]
    if not known:
        return None
    out = known[0]
    for p in known[1:]:
        out = out & p if isinstance(query, And) else out | p
    return out


def fuzzy_candidates(index: BigramIndex, probes: Probes | None, text: Column) -> Column | None:
    """Enough probes are there, where those that aren't tracked count as there; None if that holds for all texts."""
    if probes is None:
        return None
    known = [p for p in probes.keys if index.knows(p)]
    missing = len(probes.keys) - len(known)
    if missing >= probes.need:
        return None
    return sum((has_pair(p, text).cast("int") for p in known), F.lit(missing)) >= probes.need
