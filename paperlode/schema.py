"""Table layouts and fixed values of the store."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructType

# Fixed values
STATUSES = ("ok", "empty", "error", "deleted")
NORM_VERSION = 1
WINDOW_CHARS, WINDOW_STEP = 1200, 1000
PREVIEW_BYTES, SNIPPET_BYTES = 200, 60
DEFAULT_LIMIT = 200
FUZZY_PROBES, FUZZY_SCORED_LIMIT = 6, 2048
OVERFLOW_LIMIT, TOMBSTONE_RATIO = 10_000, 0.10

DOCUMENTS = (
    StructType()
    .add("doc_id", LongType(), False).add("path", StringType(), False).add("size_bytes", LongType()).add("mtime_ns", LongType())
    .add("dev", LongType()).add("ino", LongType()).add("extractor", StringType()).add("extractor_version", StringType())
    .add("norm_version", LongType()).add("page_count", IntegerType()).add("status", StringType()).add("error_text", StringType())
    .add("indexed_at_ms", LongType()).add("deleted_at_ms", LongType())
)

CHUNK_PARTS = (
    StructType()
    .add("page_no", IntegerType()).add("chunk_ord", IntegerType()).add("char_start", IntegerType()).add("char_end", IntegerType())
    .add("text_utf8", StringType()).add("text_norm_ascii", StringType()).add("preview", StringType())
)

CHUNKS = StructType().add("chunk_id", LongType(), False).add("doc_id", LongType(), False)
for _f in CHUNK_PARTS:
    CHUNKS.add(_f)
CHUNKS.add("active", BooleanType())

#: An extracted document: its row without doc_id, with its chunks.
EXTRACTED = StructType([f for f in DOCUMENTS if f.name not in ("doc_id", "indexed_at_ms", "deleted_at_ms")]).add("chunks", ArrayType(CHUNK_PARTS))

#: What search reads: a chunk joined with its document.
ITEM_COLUMNS = ("chunk_id", "doc_id", "path", "filename", "page_no", "chunk_ord", "text_utf8", "text_norm_ascii", "preview", "doc_mtime_ns")

HITS = (
    StructType()
    .add("chunk_id", LongType()).add("doc_id", LongType()).add("path", StringType()).add("filename", StringType())
    .add("page_no", IntegerType()).add("chunk_ord", IntegerType()).add("score", FloatType()).add("snippet", StringType())
)
