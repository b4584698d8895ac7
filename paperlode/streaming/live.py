"""Keeping an index live: a first scan, then micro-batches of file changes, with compaction and snapshot reads."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff
from ..operators.bigram_index import BigramIndex
from ..operators.extract import TOOL, Extractor, extract, run_tool
from ..operators.overlay import Overlay
from ..operators.store import Store
from ..plans.search import Snapshot, items, search
from ..schema import NORM_VERSION
from ..session import written
from ..sources.files import PdfFiles


@dataclass(frozen=True)
class Options:
    """Settings of a live index."""

    root: str
    store: str
    state: str
    respect_ignore: bool = False
    follow_links: bool = False
    debounce: str = "200 milliseconds"
    max_events: int = 0
    extractor: Extractor = run_tool
    extractor_name: str = TOOL
    extractor_version: str = "unknown"


@dataclass
class Progress:
    """Counts of this session's events."""

    seen: int = 0
    ok: int = 0
    empty: int = 0
    error: int = 0
    deleted: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, **counts: int) -> None:
        with self.lock:
            for k, n in counts.items():
                setattr(self, k, getattr(self, k) + n)


def with_content(files: DataFrame) -> DataFrame:
    """Adds the bytes of each file, read by the worker, or why it can't be read; a file that is gone by then is left out,
    as its removal is an event of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                data, failure = None, None
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                except OSError as e:
                    failure = str(e)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary()), pa.array([failure], pa.string())], [*row.schema.names, "content", "failure"])

    names = ["path", "size_bytes", "mtime_ns", "dev", "ino"]
    return files.select(*names).mapInArrow(run, "path string, size_bytes long, mtime_ns long, dev long, ino long, content binary, failure string")


class LiveIndex:
    """One writer, any number of readers: a search works on the snapshot that was current when it began."""

    def __init__(self, spark: SparkSession, options: Options) -> None:
        self.spark, self.options = spark, options
        spark.dataSource.register(PdfFiles)
        self.store = Store(spark, options.store)
        self.progress = Progress()
        self._swap = threading.Lock()
        self.rebuild()

    # -- readers

    @property
    def snapshot(self) -> Snapshot:
        with self._swap:
            return self._snapshot

    def search(self, query: str, mode: str = "fuzzy", limit: int = 200) -> DataFrame:
        return search(self.snapshot, query, mode, limit)

    # -- the writer

    def rebuild(self) -> None:
        """A new base from the store and an empty overlay, published at once."""
        base = written(items(self.store.chunks(), self.store.documents()))
        index = BigramIndex.build(base)
        with self._swap:
            self._snapshot = Snapshot(base, Overlay.empty(self.spark, base), index)

    def _listing(self) -> DataFrame:
        o = self.options
        return self.spark.read.format("pdf_files").option("respectIgnore", str(o.respect_ignore)).option("followLinks", str(o.follow_links)).load(o.root)

    def scan(self) -> None:
        """Bring the store to the folder's state: extract what is new or changed, delete what is gone."""
        listed = written(self._listing())
        o = self.options
        todo = written(diff.reasons(listed, self.store.documents(), F.lit(o.extractor_name), F.lit(o.extractor_version), F.lit(NORM_VERSION), restored_is_new=True))
        self.progress.add(seen=listed.count())
        self.apply(listed.join(todo.where(F.col("reason") != diff.DELETED), "path", "left_semi"), todo.where(F.col("reason") == diff.DELETED).select("path"))

    def apply(self, dirty: DataFrame, removed: DataFrame) -> None:
        """Store a batch of changes and show them; compacts when the overlay has grown."""
        o = self.options
        found = written(extract(with_content(dirty), o.extractor, o.extractor_name, o.extractor_version))
        with self._swap:
            old = self._snapshot
        overlay = old.overlay
        if not found.isEmpty():
            ids = written(self.store.upsert(found))
            self.progress.add(**{r["status"]: r["count"] for r in ids.groupBy("status").count().collect()})  # at most four rows
            fresh = items(self.store.newest_chunks(), self.store.documents())
            overlay = overlay.modify(ids, written(fresh))
        if not removed.isEmpty():
            gone = written(self.store.mark_deleted(removed))
            self.progress.add(deleted=gone.count())
            overlay = overlay.tombstone(gone)
        if overlay is old.overlay:
            return
        overlay = Overlay(written(overlay.tombstones), written(overlay.overflow), overlay.generation)
        if overlay.stats(old.base).first()["needs_rebuild"]:
            self.store.compact()
            self.rebuild()
            return
        with self._swap:
            self._snapshot = Snapshot(old.base, overlay, old.index)

    def on_batch(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch: the last event of a path counts. A repeated batch gives the same state."""
        held = written(events)
        dirty = held.where("kind = 'dirty'").drop("kind")
        known = self.store.documents().where("status = 'ok'").select("path", F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"))
        changed = dirty.join(known, "path", "left").where("_s IS NULL OR _s <> size_bytes OR _m <> mtime_ns").drop("_s", "_m")
        self.apply(changed, held.where("kind = 'removed'").select("path"))

    def watch(self, checkpoint: str) -> StreamingQuery:
        """Scan once, then follow changes until the query is stopped."""
        self.scan()
        o = self.options
        stream = (
            self.spark.readStream.format("pdf_files").option("state", o.state).option("respectIgnore", str(o.respect_ignore))
            .option("followLinks", str(o.follow_links)).option("maxEvents", str(o.max_events)).load(o.root)
        )
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=o.debounce).start()
