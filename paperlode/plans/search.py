"""Literal, regular-expression and fuzzy search over base and overlay, as lazy plans.

A limit ends verification in base order before hits are ranked: sorting by that order with the limit is one
top-k per task, and only the limited rows reach the snippet and rank expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hits import hit_columns, rank_text, ranked, with_snippet, with_snippet_at_norm
from ..functions.score import score_column
from ..functions.text import filename_column, normalize_column, normalize_query
from ..operators import bigram_index as bi
from ..operators.overlay import Overlay, base_order
from ..schema import DEFAULT_LIMIT, FUZZY_PROBES, FUZZY_SCORED_LIMIT, HITS, ITEM_COLUMNS
from . import grams, pattern

MODES = ("literal", "regex", "fuzzy")


def items(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Searchable items: active chunks of documents with status ok, each once.

    The documents side carries four narrow columns; Spark chooses how to join by its size.
    """
    docs = documents.where("status = 'ok'").select("doc_id", F.col("path").alias("_path"), F.col("mtime_ns").alias("_mtime"))
    rows = chunks.where("active").select("chunk_id", "doc_id", "page_no", "chunk_ord", "text_utf8", "text_norm_ascii", "preview")
    joined = rows.join(docs, "doc_id").withColumns({"path": F.col("_path"), "filename": filename_column(F.col("_path")), "doc_mtime_ns": F.col("_mtime")})
    return joined.select(*ITEM_COLUMNS)


@dataclass(frozen=True)
class Snapshot:
    """What a search reads: items, their index (None: no prefilter), and changes. ``repeated``: the items may hold
    replayed rows, which are dropped after the predicate, where rows are few."""

    base: DataFrame
    overlay: Overlay | None = None
    index: bi.BigramIndex | None = None
    repeated: bool = False

    @cached_property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def live(self) -> DataFrame:
        """Visible items with their place in the order."""
        if self.overlay is not None:
            return self.overlay.live(self.base)
        return self.base.withColumn("_src", F.lit(0)).withColumn("_seq", F.lit(0).cast("long"))

    def once(self, rows: DataFrame) -> DataFrame:
        return rows.dropDuplicates(["_src", "chunk_id"]) if self.repeated else rows

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], HITS)


def _first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(*base_order()).limit(limit)


def literal_matches(snapshot: Snapshot, needle: str) -> DataFrame:
    """Live items that hold the normalised needle, with its byte offset ``_at``.

    No bigram test goes before: on a columnar scan one containment test costs less than several, and the result
    is the same. The searchable form is ASCII as a rule; the offset counts bytes in any case.
    """
    norm = F.col("text_norm_ascii")
    rows = snapshot.live().where(norm.contains(needle))
    return snapshot.once(rows).withColumn("_at", F.octet_length(F.substring(norm, F.lit(1), F.instr(norm, F.lit(needle)) - 1)))


def literal(snapshot: Snapshot, query: str, limit: int = DEFAULT_LIMIT, rank: bool = False) -> DataFrame:
    """Hits of a substring of the searchable text, in rank order; ``rank`` adds the place as a column."""
    needle = normalize_query(query)
    if not needle or limit <= 0:
        return snapshot.empty()
    rows = _first(literal_matches(snapshot, needle), limit)
    return ranked(hit_columns(with_snippet_at_norm(rows, F.col("_at"), F.lit(len(needle)))), needle).select(*HITS.names, *([F.col("_rank").alias("rank")] if rank else []))


def regex_matches(snapshot: Snapshot, query: str, prefilter: bool = False) -> DataFrame:
    """Live items whose text matches, with byte offset and length of the first match; errors rise here."""
    _, java = pattern.parse(query)
    text = F.col("text_utf8")
    rows = snapshot.live()
    if prefilter and snapshot.index is not None and (test := bi.evaluate(snapshot.index, grams.regex_query(query), F.col("text_norm_ascii"))) is not None:
        rows = rows.where((F.col("_src") == 1) | test)
    rows = snapshot.once(rows.where(text.rlike(java)))
    at = F.regexp_instr(text, F.lit(java))
    return rows.withColumn("_at", F.octet_length(F.substring(text, F.lit(1), at - 1))).withColumn("_length", F.octet_length(F.regexp_substr(text, F.lit(java))))


def regex(snapshot: Snapshot, query: str, limit: int = DEFAULT_LIMIT, prefilter: bool = False, rank: bool = False) -> DataFrame:
    """Hits of a pattern in the text itself, ranked by the raw pattern as phrase; ``rank`` adds the place as a column.

    Every live chunk is verified unless ``prefilter`` is set, whose test no match can fail.
    """
    if not query.strip() or limit <= 0:
        return snapshot.empty()
    rows = _first(regex_matches(snapshot, query, prefilter), limit)
    return ranked(hit_columns(with_snippet(rows, F.col("_at"), F.coalesce("_length", F.lit(0)))), query).select(*HITS.names, *([F.col("_rank").alias("rank")] if rank else []))


def filename_documents(snapshot: Snapshot, needle: str) -> DataFrame:
    """(doc_id, offsets, length): documents of the base whose normalised filename holds every term."""
    name = F.col("_name")
    terms = needle.split()
    docs = snapshot.base.select("doc_id", "filename").distinct().withColumn("_name", normalize_column(F.col("filename")))
    for t in terms:
        docs = docs.where(name.contains(t))
    places = sum((F.instr(name, F.lit(t)) - 1 for t in terms), F.lit(0))
    return docs.select("doc_id", places.alias("offsets"), F.octet_length(name).alias("length"))


def filename_band(snapshot: Snapshot, needle: str, limit: int) -> DataFrame:
    """One item per document with a matching name: its first live chunk; with ``_rank`` from 1."""
    docs = filename_documents(snapshot, needle)
    order = F.when(F.col("_src") == 0, F.struct(F.col("_src"), F.col("chunk_ord").alias("a"), F.col("chunk_id").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(
        F.struct(F.col("_src"), F.col("page_no").alias("a"), F.col("chunk_ord").cast("long").alias("b"), F.col("chunk_id").alias("c"))
    )
    live = snapshot.live().join(docs.select("doc_id"), "doc_id", "left_semi")
    firsts = live.groupBy("doc_id").agg(F.min_by(F.struct(*live.columns), order).alias("_i")).select("doc_id", F.struct(*(F.col(f"_i.{c}").alias(c) for c in live.columns)).alias("_i"))
    best = firsts.join(docs, "doc_id").orderBy("offsets", "length", "doc_id").limit(limit)
    numbered = best.withColumn("_rank", F.row_number().over(Window.orderBy("offsets", "length", "doc_id")))
    return numbered.select(*(F.col(f"_i.{c}").alias(c) for c in live.columns), "_rank")


def body_candidates(snapshot: Snapshot, needle: str) -> DataFrame:
    """Live items a fuzzy search looks at: probes for the base, all of the overflow, without name-matched documents."""
    rows = snapshot.live()
    if snapshot.index is not None:
        test = bi.fuzzy_candidates(snapshot.index, grams.fuzzy_probes(needle, FUZZY_PROBES), F.col("text_norm_ascii"))
        if test is not None:
            rows = rows.where((F.col("_src") == 1) | test)
    return snapshot.once(rows.join(filename_documents(snapshot, needle).select("doc_id"), "doc_id", "left_anti"))


def body_cheap(candidates: DataFrame, needle: str, limit: int) -> DataFrame:
    """Among many candidates: those that hold the needle, in base order, with ``_rank``."""
    norm = F.col("text_norm_ascii")
    rows = _first(candidates.where(norm.contains(needle)), limit)
    return rows.withColumn("_score", F.lit(1.0).cast("float")).withColumn("_rank", F.row_number().over(Window.orderBy(*base_order())))


def body_scored(candidates: DataFrame, needle: str, limit: int) -> DataFrame:
    """Among few candidates: by alignment score of the ranking text, ties in base order; none of score 0."""
    rows = candidates.withColumn("_score", score_column(rank_text(candidates), needle).cast("float")).where("_score > 0")
    order = [F.col("_score").desc(), *base_order()]
    return rows.orderBy(*order).limit(limit).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))


def fuzzy(snapshot: Snapshot, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Documents by filename first, then bodies; the order of the rows is the order of the hits.

    One bounded count decides how bodies are ranked: up to 2,048 candidates are scored.
    """
    needle = normalize_query(query)
    if not needle or limit <= 0:
        return snapshot.empty()
    names = filename_band(snapshot, needle, limit)
    candidates = body_candidates(snapshot, needle)
    many = candidates.select("chunk_id").limit(FUZZY_SCORED_LIMIT + 1).count() > FUZZY_SCORED_LIMIT
    body = (body_cheap if many else body_scored)(candidates, needle, limit)
    at = F.instr(F.col("text_norm_ascii"), F.lit(needle))
    found = body.withColumn("_at", F.when(at > 0, F.octet_length(F.substring("text_norm_ascii", F.lit(1), at - 1))).otherwise(0))
    top = names.withColumns({"_score": F.lit(1.0).cast("float"), "_at": F.lit(0), "_band": F.lit(0)})
    both = top.unionByName(found.withColumn("_band", F.lit(1))).orderBy("_band", "_rank").limit(limit)
    shown = with_snippet_at_norm(both, F.col("_at"), F.lit(len(needle)))
    return hit_columns(shown, F.col("_score")).orderBy("_band", "_rank").select(*HITS.names)


def search(snapshot: Snapshot, query: str, mode: str = "fuzzy", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Ranked hits of a query in one of the three modes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return {"literal": literal, "regex": regex, "fuzzy": fuzzy}[mode](snapshot, query, limit)


def candidate_test(snapshot: Snapshot, needle: str) -> Column | None:
    """The literal prefilter of a snapshot's index, for inspection."""
    return bi.literal_candidates(snapshot.index, needle, F.col("text_norm_ascii")) if snapshot.index else None
