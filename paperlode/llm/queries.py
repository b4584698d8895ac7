"""The queries of the text operators, by problem, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import leak, mojibake, neardup, ocr, packing, quality, spans, split, sql, unify


def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable chunk rows; replayed rows are dropped where a query's rows are narrow."""
    return table(spark, sf_dir, "chunks").where("active")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.same_look_pairs(active_chunks(spark, sf_dir))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active chunk with its text in the consistent form."""
    rows = active_chunks(spark, sf_dir).select("chunk_id", "doc_id", "text_utf8")
    return unify.unify(rows).select("chunk_id", "doc_id", "text_unified").dropDuplicates(["chunk_id"])


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: the smallest chunk_id that looks the same."""
    rows = unify.look_classes(active_chunks(spark, sf_dir))
    firsts = rows.groupBy("look").agg(F.min("chunk_id").alias("class_id"), F.count_distinct("form").alias("forms"))
    return rows.join(firsts, "look").select("chunk_id", "class_id", "forms")


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of equal texts among chunks with a look of several forms: what p1_found doesn't write out copy by copy."""
    rows = unify.look_members(written(unify.look_classes(active_chunks(spark, sf_dir))))
    return rows.select("chunk_id", "form_id", F.col("n").alias("copies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(active_chunks(spark, sf_dir))


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each chunk that stand verbatim in other documents."""
    return spans.shared_length(active_chunks(spark, sf_dir))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of equal texts: what p2_found doesn't write out pair by pair."""
    return spans.copies(active_chunks(spark, sf_dir)).where("lo <> hi").select("chunk_id", "class_id", "n")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(active_chunks(spark, sf_dir), neardup.STATED)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of equal sets, its group of near-identical documents, its links."""
    return neardup.near_groups(active_chunks(spark, sf_dir), neardup.STATED)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(active_chunks(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk as pieces within the limit."""
    return split.chunk_pieces(active_chunks(spark, sf_dir))


def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk put together again from its pieces, which were cut in ranges of 1,000 bytes and stitched."""
    spec = split.Split(range_bytes=1000)
    pieces = split.split_text(written(split.oversized(active_chunks(spark, sf_dir))), "chunk_id", "text_utf8", spec)
    return split.rejoined(pieces, "chunk_id").select("chunk_id", F.col("text").alias("text_utf8"))


def p6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, missing, chars, too_long, overlap_off): what is wrong with the pieces cut in ranges of 1,000 bytes: numbers
    left out, pieces over the limit, characters by which overlaps are off (all 0), and the characters they reach."""
    spec = split.Split(range_bytes=1000)
    pieces = split.split_text(written(split.oversized(active_chunks(spark, sf_dir))), "chunk_id", "text_utf8", spec)
    size = F.col("last_char") - F.col("first_char")
    return pieces.groupBy("chunk_id").agg((F.max("piece") + 1 - F.count(F.lit(1))).cast("int").alias("missing"), F.max("last_char").alias("chars"), F.count_if(size > spec.limit).alias("too_long"), (F.sum(size) - F.max("last_char") - spec.overlap * F.max("piece")).alias("overlap_off"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("run >= need").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of half an item with one word edited allowed: distance and longest exact run."""
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance): leaks of items in which a word of each half was replaced, so that no run of half the item
    stands anywhere unedited and the verified distance alone decides."""
    words = F.regexp_extract_all(F.lower("passage"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    n, half = F.size("w"), F.ceil(F.size("w") / 2)
    edited = F.transform("w", lambda x, i: F.when((i == half - 1) | (n % 2 == 0) & (i == n - 1), F.lit("zzqx")).otherwise(x))
    items = table(spark, sf_dir, "eval_items").select("item_id", words.alias("w")).select("item_id", F.array_join(edited, " ").alias("passage"))
    return leak.leaks(table(spark, sf_dir, "documents"), items).select("doc_id", "item_id", "distance")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "documents"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic of every document with its percentile and robust z-score within its language."""
    return quality.placed(written(quality.stats(table(spark, sf_dir, "documents"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(active_chunks(spark, sf_dir))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected chunks with text and preview restored where possible."""
    return mojibake.restored(active_chunks(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of 2,048 tokens."""
    return packing.assign(packing.sizes(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the share of their room that stays empty."""
    return packing.fill_report(p8_containers(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found(active_chunks(spark, sf_dir), table(spark, sf_dir, "documents"))


def p5_reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a scanned document as continuous paragraphs."""
    return ocr.reflow(active_chunks(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.statements()
