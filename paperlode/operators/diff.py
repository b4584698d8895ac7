"""Listing against store: which paths must be extracted, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons, in the order in which they apply.
NEW, RETRY, MODIFIED, STALE, DELETED = "new", "retry_after_error", "modified", "stale_extractor", "deleted"


def is_pdf(path: Column) -> Column:
    """The name ends in ``.pdf`` in any case. Null for a null path."""
    return F.lower(path).endswith(".pdf")


def has_pdf_suffix(path: Column) -> Column:
    """As :func:`is_pdf`, but a file named just ``.pdf`` has no suffix."""
    return path.rlike(r"(?i)[^/]\.pdf$")


def latest(listing: DataFrame, keep: tuple[str, ...] = ("size_bytes", "mtime_ns")) -> DataFrame:
    """One row per path: the one with the greatest ``seen_at``, then ``listing_id``.

    Combines before the shuffle; replayed rows add nothing; rows without a path are left out.
    """
    newest = F.max(F.struct("seen_at", "listing_id", *keep)).alias("_last")
    return listing.where("path IS NOT NULL").groupBy("path").agg(newest).select("path", *(F.col(f"_last.{c}").alias(c) for c in keep))


def reasons(listed: DataFrame, documents: DataFrame, extractor: Column, extractor_version: Column, norm_version: Column, restored_is_new: bool = False) -> DataFrame:
    """(path, reason) of every path that isn't clean; one hash-partitioned full outer join on path.

    ``listed`` holds one row per path with size_bytes and mtime_ns, ``documents`` one row per path.
    Comparisons are null-safe. With ``restored_is_new`` a file that is back after deletion is new even if
    size and time agree.
    """
    here = listed.select("path", F.struct("size_bytes", "mtime_ns").alias("f"))
    stored = documents.where("path IS NOT NULL").select("path", F.struct("status", "size_bytes", "mtime_ns", "extractor", "extractor_version", "norm_version").alias("d"))
    same = lambda a, b: F.col(a).eqNullSafe(b if isinstance(b, Column) else F.col(b))
    reason = (
        F.when(F.col("d").isNull(), NEW)
        .when(F.col("f").isNull(), F.when(~same("d.status", F.lit("deleted")), DELETED))
        .when(F.lit(restored_is_new) & same("d.status", F.lit("deleted")), NEW)
        .when(same("d.status", F.lit("error")), RETRY)
        .when(~same("f.size_bytes", "d.size_bytes") | ~same("f.mtime_ns", "d.mtime_ns"), MODIFIED)
        .when(~same("d.extractor", extractor) | ~same("d.extractor_version", extractor_version) | ~same("d.norm_version", norm_version), STALE)
    )
    return here.join(stored, "path", "full_outer").select("path", reason.alias("reason")).where("reason IS NOT NULL")
