"""Queries on documents, pages, windows and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.diff import has_pdf_suffix
from ..session import table
from . import sqltext as sx
from .search import items


def active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable items, replays once."""
    return items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents")).dropDuplicates(["chunk_id"])


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.page_rows(table(spark, sf_dir, "documents"), ["doc_id"])


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.window_rows(page_split(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "page_no", "chunk_ord", "char_start", "char_end", "text_utf8")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_items(spark, sf_dir).select("chunk_id", tx.normalize_column(F.col("text_utf8")).alias("normalized"))


def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_items(spark, sf_dir).select("chunk_id", tx.display_column(F.col("text_utf8")).alias("shown"))


def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = active_items(spark, sf_dir).select("chunk_id", "text_utf8")
    return tx.with_preview(rows).select("chunk_id", "preview")


def active_chunks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_items(spark, sf_dir).select("chunk_id", "doc_id", "path", "filename", "page_no", "chunk_ord", "doc_mtime_ns")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "path", "size_bytes", "mtime_ns", "extractor", "extractor_version", "norm_version", "status")


def chunks_of(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    """Active chunks of one document in order, whatever its status; the filter reaches the scan."""
    rows = table(spark, sf_dir, "chunks").where(F.col("active") & (F.col("doc_id") == doc_id))
    return rows.dropDuplicates(["chunk_id"]).orderBy("chunk_ord", "chunk_id").select("chunk_id", "doc_id", "page_no", "chunk_ord", "char_start", "char_end")


def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active chunks of every document, whatever its status, with their place in its order.

    Replays go first, by aggregates on narrow rows; places are counted among a document's rows, which spill if many.
    """
    rows = table(spark, sf_dir, "chunks").where("active").select("chunk_id", "doc_id", "page_no", "chunk_ord", "char_start", "char_end").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_ord", "chunk_id")))


def document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document in base order: how many, the first and the last."""
    order = F.struct("chunk_ord", "chunk_id")
    return active_items(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min_by("chunk_id", order).alias("first_chunk"), F.max_by("chunk_id", order).alias("last_chunk"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def pdf_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct listed paths that are PDF files by name."""
    return table(spark, sf_dir, "listing").where(has_pdf_suffix(F.col("path"))).select("path").distinct()


def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_split(spark, sf_dir).where(tx.is_blank(F.col("page_text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blank_pages"))


def failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("status = 'error'").select("doc_id", "path", "error_text")


def filename_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("status = 'ok'")
    return docs.select("doc_id", tx.normalize_column(tx.filename_column(F.col("path"))).alias("filename_norm"))


SQL = {
    "page_split": f"WITH {sx.PAGES} SELECT * FROM pages",
    "chunk_windows": f"WITH {sx.WINDOWS} SELECT doc_id, page_no, chunk_ord, char_start, (char_start + strlen(text_utf8))::INTEGER AS char_end, text_utf8 FROM windows WHERE NOT {sx.is_blank('text_utf8')}",
    "normalize_text": f"WITH {sx.ITEMS} SELECT chunk_id, {sx.normalize('text_utf8')} AS normalized FROM items",
    "display_text": f"WITH {sx.ITEMS} SELECT chunk_id, {sx.display('text_utf8')} AS shown FROM items",
    "preview_text": f"WITH {sx.ITEMS} SELECT chunk_id, {sx.preview('text_utf8')} AS preview FROM items",
    "active_chunks_join": f"WITH {sx.ITEMS} SELECT chunk_id, doc_id, path, filename, page_no, chunk_ord, doc_mtime_ns FROM items",
    "document_rows": "SELECT doc_id, path, size_bytes, mtime_ns, extractor, extractor_version, norm_version, status FROM documents",
    "chunks_of_document": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_ord, chunk_id)::INTEGER AS place FROM (SELECT DISTINCT chunk_id, doc_id, page_no, chunk_ord, char_start, char_end FROM chunks WHERE active)",
    "document_ranges": f"WITH {sx.ITEMS} SELECT doc_id, count(*) AS chunks, min_by(chunk_id, (chunk_ord, chunk_id)) AS first_chunk, max_by(chunk_id, (chunk_ord, chunk_id)) AS last_chunk FROM items GROUP BY doc_id",
    "status_counts": "SELECT status, count(*) AS documents FROM documents GROUP BY status",
    "pdf_listing": "SELECT DISTINCT path FROM listing WHERE regexp_matches(lower(path), '[^/]\\.pdf$')",
    "blank_pages": f"WITH {sx.PAGES} SELECT doc_id, count(*) AS blank_pages FROM pages WHERE {sx.is_blank('page_text')} GROUP BY doc_id",
    "failed_documents": "SELECT doc_id, path, error_text FROM documents WHERE status = 'error'",
    "filename_norms": f"SELECT doc_id, {sx.normalize(sx.filename('path'))} AS filename_norm FROM documents WHERE status = 'ok'",
}
QUERIES = {
    f.__name__: f
    for f in (page_split, chunk_windows, normalize_text, display_text, preview_text, active_chunks_join, document_rows, chunks_of_document, document_ranges, status_counts, pdf_listing, blank_pages, failed_documents, filename_norms)
}
