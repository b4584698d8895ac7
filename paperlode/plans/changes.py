"""Queries on changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, incremental, overlay
from ..session import fingerprint, shared_dir, table
from . import sqltext as sx
from .search import items


def run_changes(spark: SparkSession, sf_dir: str, lower: int, upper: int) -> DataFrame:
    """(path, reason) of what the scan run ``upper`` must do; of the listing only rows of runs in (lower, upper] are read.

    A complete listing stands for those of the failed runs before it; nothing for a run that isn't known.
    """
    run = table(spark, sf_dir, "scan_runs").where((F.col("run_id") == upper) & (F.col("run_id") > lower)).limit(1)
    now = run.select("extractor", "extractor_version", "norm_version").first()
    if now is None:
        return spark.createDataFrame([], CHANGES)
    listing = table(spark, sf_dir, "listing").where((F.col("run_id") > lower) & (F.col("run_id") == upper) & diff.is_pdf(F.col("path")))
    return diff.reasons(diff.latest(listing), table(spark, sf_dir, "documents"), *(F.lit(x) for x in now))


CHANGES = "path string, reason string"


def _limits(spark: SparkSession, sf_dir: str) -> tuple[int, int | None]:
    """The last run that ended well, and the pending one."""
    of = lambda outcome: F.max(F.when(F.col("outcome") == outcome, F.col("run_id").cast("long")))
    ok, pending = table(spark, sf_dir, "scan_runs").agg(of("ok"), of("pending")).first()
    return ok or 0, pending


def changes_log(spark: SparkSession, sf_dir: str, name: str = "changes") -> incremental.CommitLog:
    """The log of a store, which outlives the call. Its folder carries the state of the store's files: the tables here are
    replaced as a whole, and a new set is another store."""
    return incremental.CommitLog(spark, f"{shared_dir(spark)}/{name}-{fingerprint(spark, [f'{sf_dir}/{t}.parquet' for t in ('scan_runs', 'listing', 'documents')])}")


def process_pending(spark: SparkSession, sf_dir: str, log: incremental.CommitLog) -> incremental.Commit | None:
    """Process what lies between the log's watermark (at first the last run that ended well) and the pending run.

    A second call finds its upper limit reached and commits nothing.
    """
    first, pending = _limits(spark, sf_dir)
    return None if pending is None else incremental.run(log, lambda: pending, lambda lower, upper: run_changes(spark, sf_dir, lower, upper), first=first)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pending run must extract or delete, committed together with its number as watermark.

    The last run that ended well is the lower limit; a failed run moves no watermark, and what it stored
    shows in ``documents``, so it is neither skipped nor repeated. The log is kept: called again, the query commits
    nothing and returns what was committed.
    """
    log = changes_log(spark, sf_dir)
    process_pending(spark, sf_dir, log)
    return incremental.committed(log, CHANGES)


class Crash(RuntimeError):
    """Stands for a lost executor or driver."""


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, path, size_bytes, mtime_ns): states of files as the runs that reached their end saw them first, each once.

    All runs with a listing are processed in their order, every one called twice; those that failed die between writing
    and committing. What such a run read is in the range of the next one; what it wrote is never seen.
    """
    log = changes_log(spark, sf_dir, "runs")
    schema = "run_id int, path string, size_bytes long, mtime_ns long"

    def work(lower: int, upper: int) -> DataFrame:
        listing = table(spark, sf_dir, "listing").where((F.col("run_id") > lower) & (F.col("run_id") <= upper) & F.col("path").isNotNull())
        return diff.latest(listing).select(F.lit(upper).cast("int").alias("run_id"), "path", "size_bytes", "mtime_ns")

    def die(commit: incremental.Commit) -> None:
        raise Crash

    for run in table(spark, sf_dir, "scan_runs").orderBy("run_id").toLocalIterator():  # a run of the scanner each
        for _ in range(2):
            try:
                incremental.run(log, lambda run=run: run["run_id"], work, before_commit=die if run["outcome"] == "failed" else None)
            except Crash:
                pass
    return incremental.committed(log, schema)


P4_RUNS = """
WITH done AS (SELECT run_id AS upper, coalesce(lag(run_id) OVER (ORDER BY run_id), 0) AS lower FROM scan_runs WHERE outcome <> 'failed')
SELECT d.upper AS run_id, l.path, max_by(l.size_bytes, (l.seen_at, l.listing_id)) AS size_bytes, max_by(l.mtime_ns, (l.seen_at, l.listing_id)) AS mtime_ns
FROM done d JOIN listing l ON l.run_id > d.lower AND l.run_id <= d.upper WHERE l.path IS NOT NULL GROUP BY d.upper, l.path
"""


P4_FOUND = """
WITH run AS (SELECT * FROM scan_runs WHERE run_id = (SELECT max(run_id) FROM scan_runs WHERE outcome = 'pending')),
seen AS (
  SELECT path, max_by(size_bytes, (seen_at, listing_id)) AS size_bytes, max_by(mtime_ns, (seen_at, listing_id)) AS mtime_ns
  FROM listing WHERE run_id = (SELECT run_id FROM run) AND lower(path) LIKE '%.pdf' GROUP BY path)
SELECT coalesce(s.path, d.path) AS path,
  CASE WHEN d.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN d.status = 'error' THEN 'retry_after_error'
    WHEN s.size_bytes IS DISTINCT FROM d.size_bytes OR s.mtime_ns IS DISTINCT FROM d.mtime_ns THEN 'modified' ELSE 'stale_extractor' END AS reason
FROM seen s FULL OUTER JOIN documents d ON s.path = d.path CROSS JOIN run r
WHERE d.path IS NULL OR (s.path IS NULL AND d.status IS DISTINCT FROM 'deleted') OR (s.path IS NOT NULL AND (d.status = 'error'
  OR s.size_bytes IS DISTINCT FROM d.size_bytes OR s.mtime_ns IS DISTINCT FROM d.mtime_ns
  OR d.extractor IS DISTINCT FROM r.extractor OR d.extractor_version IS DISTINCT FROM r.extractor_version OR d.norm_version IS DISTINCT FROM r.norm_version))
"""


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_runs").where("outcome = 'pending'").agg(F.max_by(F.struct("run_id", "extractor", "extractor_version", "norm_version"), "run_id").alias("run")).select("run.*")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.broadcast(_pending(spark, sf_dir).select("run_id"))  # one row
    return diff.latest(table(spark, sf_dir, "listing").where(diff.has_pdf_suffix(F.col("path"))).join(run, "run_id"))


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full listing of the last run against the store, with a restored file as new."""
    now = _pending(spark, sf_dir).first()
    return diff.reasons(_listed(spark, sf_dir), table(spark, sf_dir, "documents"), *(F.lit(now[c]) for c in ("extractor", "extractor_version", "norm_version")), restored_is_new=True)


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files seen, to extract, and deleted."""
    seen = _listed(spark, sf_dir).agg(F.count(F.lit(1)).alias("seen"))
    found = scan_diff(spark, sf_dir).agg(F.count_if(F.col("reason") != diff.DELETED).alias("dirty"), F.count_if(F.col("reason") == diff.DELETED).alias("deleted"))
    return seen.crossJoin(found)  # one row each


def latest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every listed path over all runs."""
    return diff.latest(table(spark, sf_dir, "listing"), ("size_bytes", "mtime_ns", "run_id"))


def latest_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user: the later time, then the greater number, wins."""
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "e.event_id", "e.event_type", "e.value")


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, overlay.Overlay]:
    """A base, and an overlay in which documents divisible by 50 are gone and those by 40 have their first chunk only."""
    base = items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents")).dropDuplicates(["chunk_id"])
    ids = base.select("doc_id").distinct()
    gone, changed = ids.where("doc_id % 50 = 0"), ids.where("doc_id % 40 = 0 AND doc_id % 50 <> 0")
    first = base.join(changed, "doc_id", "left_semi").where("page_no = 1 AND chunk_ord = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000_000)
    return base, overlay.Overlay.empty(spark, base).tombstone(gone).modify(changed, first)


def overlay_modify_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search sees after deletions and changes."""
    base, changes = _changed(spark, sf_dir)
    return changes.live(base).select("chunk_id", "doc_id", "page_no", "chunk_ord", F.col("_src").alias("src"))


def overlay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = _changed(spark, sf_dir)
    return changes.stats(base)


_LISTED = f"""
run AS (SELECT * FROM scan_runs WHERE run_id = (SELECT max(run_id) FROM scan_runs WHERE outcome = 'pending')),
seen AS (
  SELECT path, max_by(size_bytes, (seen_at, listing_id)) AS size_bytes, max_by(mtime_ns, (seen_at, listing_id)) AS mtime_ns
  FROM listing WHERE run_id = (SELECT run_id FROM run) AND regexp_matches(lower(path), '[^/]\\.pdf$') GROUP BY path),
diff AS (
  SELECT coalesce(s.path, d.path) AS path,
    CASE WHEN d.path IS NULL OR (s.path IS NOT NULL AND d.status = 'deleted') THEN 'new' WHEN s.path IS NULL THEN CASE WHEN d.status IS DISTINCT FROM 'deleted' THEN 'deleted' END WHEN d.status = 'error' THEN 'retry_after_error'
      WHEN s.size_bytes IS DISTINCT FROM d.size_bytes OR s.mtime_ns IS DISTINCT FROM d.mtime_ns THEN 'modified'
      WHEN d.extractor IS DISTINCT FROM r.extractor OR d.extractor_version IS DISTINCT FROM r.extractor_version OR d.norm_version IS DISTINCT FROM r.norm_version THEN 'stale_extractor' END AS reason
  FROM seen s FULL OUTER JOIN documents d ON s.path = d.path CROSS JOIN run r)
"""
_OVERLAY = f"""
{sx.ITEMS}, changed AS (SELECT chunk_id + 1000000000 AS chunk_id, doc_id, page_no, chunk_ord FROM items WHERE doc_id % 40 = 0 AND doc_id % 50 <> 0 AND page_no = 1 AND chunk_ord = 0)
"""
SQL = {
    "p4_found": P4_FOUND,
    "p4_runs": P4_RUNS,
    "scan_diff": f"WITH {_LISTED} SELECT path, reason FROM diff WHERE reason IS NOT NULL",
    "scan_counters": f"WITH {_LISTED} SELECT (SELECT count(*) FROM seen) AS seen, count_if(reason <> 'deleted')::BIGINT AS dirty, count_if(reason = 'deleted')::BIGINT AS deleted FROM diff WHERE reason IS NOT NULL",
    "latest_listing": "SELECT path, max_by(size_bytes, (seen_at, listing_id)) AS size_bytes, max_by(mtime_ns, (seen_at, listing_id)) AS mtime_ns, max_by(run_id, (seen_at, listing_id)) AS run_id FROM listing WHERE path IS NOT NULL GROUP BY path",
    "latest_event_per_key": "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "overlay_modify_visible": f"WITH {_OVERLAY} SELECT chunk_id, doc_id, page_no, chunk_ord, 0 AS src FROM items WHERE doc_id % 50 <> 0 AND doc_id % 40 <> 0 UNION ALL SELECT chunk_id, doc_id, page_no, chunk_ord, 1 FROM changed",
    "overlay_stats": f"WITH {_OVERLAY}, s AS (SELECT (SELECT count(*) FROM items) AS base_chunks, (SELECT count(*) FROM items WHERE doc_id % 50 = 0 OR doc_id % 40 = 0) AS tombstones, (SELECT count(*) FROM changed) AS overflow) SELECT base_chunks, tombstones, overflow, 2 AS generation, tombstones / greatest(base_chunks, 1)::DOUBLE AS ratio, overflow >= 10000 OR tombstones / greatest(base_chunks, 1)::DOUBLE >= 0.1 AS needs_rebuild FROM s",
}
QUERIES = {f.__name__: f for f in (p4_found, p4_runs, scan_diff, scan_counters, latest_listing, latest_event_per_key, overlay_modify_visible, overlay_stats)}
