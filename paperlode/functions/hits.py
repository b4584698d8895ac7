"""Result rows: snippets around a match, the ranking text, and the order of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SNIPPET_BYTES
from .text import bytes_slice, display_column, snapped

#: Stands for "not in the snippet" where the earliest place counts.
NOWHERE = 2**31 - 1


def with_snippet(df: DataFrame, centre: Column, length: Column) -> DataFrame:
    """Adds ``snippet``: display form of 60 bytes on either side of a match at byte ``centre`` of text_utf8.

    Cut at whole characters. Built in steps, each a column of its own, so no expression is written out twice.
    """
    data = F.col("text_utf8").cast("binary")
    size = F.octet_length("text_utf8")
    return (
        df.withColumn("_c", F.least(centre, size))
        .withColumn("_c", snapped(data, F.col("_c")))
        .withColumns({"_l": F.greatest(F.col("_c") - SNIPPET_BYTES, F.lit(0)), "_r": F.least(F.least(F.col("_c") + length, size) + SNIPPET_BYTES, size)})
        .withColumns({"_l": snapped(data, F.col("_l")), "_r": snapped(data, F.col("_r"))})
        .withColumn("snippet", display_column(bytes_slice(data, F.col("_l"), F.col("_r"))))
        .drop("_c", "_l", "_r")
    )


def with_snippet_at_norm(df: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Snippet of a match at a byte of the searchable form, mapped to the text in proportion."""
    size, n = F.octet_length("text_utf8"), F.octet_length("text_norm_ascii")
    return with_snippet(df, F.when(n == 0, F.lit(0)).otherwise(F.round(size * (offset / n)).cast("int")), length)


def hit_columns(df: DataFrame, score: Column | None = None) -> DataFrame:
    """The result row of each item with a snippet, with what else ``df`` carries in columns that begin with ``_``."""
    kept = [c for c in df.columns if c.startswith("_")]
    score = F.lit(1.0).cast("float") if score is None else score.cast("float")
    return df.select("chunk_id", "doc_id", "path", "filename", "page_no", "chunk_ord", score.alias("score"), "snippet", *kept)


def rank_text(df: DataFrame) -> Column:
    """Filename, path, page and preview as one text for the fuzzy scorer; what is null counts as empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(part("filename"), F.lit(" "), part("path"), F.lit(" page "), part("page_no"), F.lit(" "), part("preview"))


def _place(text: Column, needle: str) -> Column:
    """Byte offset of the needle in the text, or null."""
    at = F.instr(text, F.lit(needle))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def rank_keys(shown: Column, query: str) -> list[Column]:
    """(phrase in the snippet, number of terms in it, earliest byte of the phrase or else of a term)."""
    phrase = query.strip()
    terms = phrase.split()
    low = F.lower(shown)
    whole = low.contains(phrase) if phrase else F.lit(False)
    count = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    places = [_place(low, t) for t in terms]
    nowhere = F.lit(NOWHERE)
    first = F.least(*places, nowhere) if len(places) > 1 else F.coalesce(places[0], nowhere) if places else nowhere
    return [whole, count, F.when(whole, F.coalesce(_place(low, phrase), nowhere)).otherwise(first) if phrase else nowhere]


def ranked(hits: DataFrame, query: str) -> DataFrame:
    """Hits in rank order, with ``_rank`` from 1: phrase, terms, earliest place, page, document, chunk. Only a limited
    list should come here: one task numbers it."""
    names = ("_whole", "_count", "_place")
    keyed = hits.withColumns(dict(zip(names, rank_keys(F.col("snippet"), query))))
    order = Window.orderBy(F.col("_whole").desc(), F.col("_count").desc(), "_place", "page_no", "doc_id", "chunk_id")
    return keyed.withColumn("_rank", F.row_number().over(order)).orderBy("_rank").drop(*names)
