"""The durable store: documents and chunks as immutable Parquet commits, merged on read.

A commit adds a layer with the rows of one batch (upserts or deletions) or is a full snapshot (after compaction).
The current document of a path is the one of the latest layer since the last snapshot; it names the layer that holds
its chunks. Nothing is rewritten by an upsert or deletion, so a batch costs what the batch holds; compaction bounds
what a read merges.
Readers see the commits that were in the log when they began.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import CHUNKS, DOCUMENTS
from ..session import written
from .ids import numbered
from .incremental import Commit, CommitLog

SNAPSHOT, DELTA = 1, 0
#: A stored document row: with the layer of its chunks.
_STORED = StructType([*DOCUMENTS, StructField("layer", StringType())])


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass
class Store:
    """A store under ``root``, a folder all nodes reach. One writer at a time; a second one's commit fails."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.log = CommitLog(self.spark, self.root)

    def _layers(self) -> list[tuple[int, str]]:
        """(sequence, folder) of the commits a read merges: from the last snapshot on."""
        return [(c.sequence, c.output) for c in self.log.since(lambda c: c.upper == SNAPSHOT) if c.output]

    def _read(self, name: str, layers: list[tuple[int, str]]) -> DataFrame:
        """All rows of the layers, documents with ``_seq``, chunks with ``layer``."""
        schema = _STORED if name == "documents" else CHUNKS
        mark = (lambda seq, folder: ("_seq", F.lit(seq).cast("long"))) if name == "documents" else (lambda seq, folder: ("layer", F.lit(folder.rsplit("/", 1)[-1])))
        empty = self.spark.createDataFrame([], schema).withColumn(*mark(0, ""))
        parts = [self.spark.read.schema(schema).parquet(f"{folder}/{name}").withColumn(*mark(seq, folder)) for seq, folder in layers]
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def documents(self) -> DataFrame:
        """The current row of every path."""
        return self._documents(self._layers()).select(*DOCUMENTS.names)

    def _documents(self, layers: list[tuple[int, str]]) -> DataFrame:
        rows = self._read("documents", layers)
        if len(layers) > 1:
            rows = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "_seq").alias("d")).select("d.*")
        return rows.drop("_seq")

    def chunks(self) -> DataFrame:
        """All chunks of current documents; those of deleted ones are inactive."""
        layers = self._layers()
        docs = self._documents(layers).select("doc_id", "layer", F.col("status").alias("_status"))
        rows = self._read("chunks", layers).join(docs, ["doc_id", "layer"])
        return rows.withColumn("active", F.col("active") & (F.col("_status") != "deleted")).select(*CHUNKS.names)

    def newest_chunks(self) -> DataFrame:
        """The chunks of the last commit alone."""
        return self._read("chunks", self._layers()[-1:]).select(*CHUNKS.names)

    def _commit(self, documents: DataFrame, chunks: DataFrame | None, kind: int = DELTA) -> None:
        """Write a layer and publish it; rows without a layer of their own get this one."""
        last = self.log.last()
        layer = uuid.uuid4().hex
        folder = f"{self.root}/data/{layer}"
        own = F.coalesce(F.col("layer"), F.lit(layer)) if "layer" in documents.columns else F.lit(layer)
        documents.withColumn("layer", own).select(*_STORED.names).write.parquet(f"{folder}/documents")
        (self.spark.createDataFrame([], CHUNKS) if chunks is None else chunks.select(*CHUNKS.names)).write.parquet(f"{folder}/chunks")
        top = self._top(last)
        new = [(folder, "documents", "doc_id"), *([] if chunks is None else [(folder, "chunks", "chunk_id")])]
        for _, name, column in new:
            top[column] = max(top[column], self.spark.read.parquet(f"{folder}/{name}").agg(F.max(column)).first()[0] or 0)
        self.log.commit(last, kind, folder, note=top)

    def _top(self, last: Commit | None) -> dict[str, int]:
        """The greatest ids given out, as the last commit notes them; looked up where a commit has no note."""
        if last is None:
            return {"doc_id": 0, "chunk_id": 0}
        if last.note is None:
            return {c: self._read(t, self._layers()).agg(F.max(c)).first()[0] or 0 for t, c in (("documents", "doc_id"), ("chunks", "chunk_id"))}
        return dict(last.note)

    def upsert(self, extracted: DataFrame, at_ms: int | None = None) -> DataFrame:
        """Store a batch of extracted documents; the last row of a path wins. Returns (doc_id, path, status).

        A known path keeps its doc_id, new ones get the next numbers. Only documents with status ok bring chunks;
        chunk ids are always new. Null paths are left out.
        """
        at_ms = now_ms() if at_ms is None else at_ms
        batch = extracted.where("path IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
        batch = written(batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "_row").alias("d")).select("d.*").drop("_row"))
        known = self.documents().select("path", "doc_id")
        top = self._top(self.log.last())
        fresh = numbered(batch.select("path").join(known, "path", "left_anti"), ["path"], "doc_id", top["doc_id"] + 1)
        ids = known.join(batch.select("path"), "path", "left_semi").unionByName(fresh)
        rows = written(batch.join(ids, "path").withColumns({"indexed_at_ms": F.lit(at_ms).cast("long"), "deleted_at_ms": F.lit(None).cast("long")}))
        parts = rows.where("status = 'ok'").select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*").withColumn("active", F.lit(True))
        self._commit(rows, numbered(parts, ["doc_id", "page_no", "chunk_ord"], "chunk_id", top["chunk_id"] + 1))
        return rows.select("doc_id", "path", "status")

    def mark_deleted(self, paths: DataFrame, at_ms: int | None = None) -> DataFrame:
        """Soft delete: (path) rows become deleted, their chunks inactive. Returns (doc_id, path) of those found."""
        at_ms = now_ms() if at_ms is None else at_ms
        current = self._documents(self._layers()).where("status <> 'deleted'")
        found = written(current.join(paths.select("path").distinct(), "path", "left_semi"))
        self._commit(found.withColumns({"status": F.lit("deleted"), "deleted_at_ms": F.lit(at_ms).cast("long")}), None)
        return found.select("doc_id", "path")

    def compact(self) -> None:
        """Write the merged state as one snapshot; older commits stay for readers that began before."""
        self._commit(written(self.documents()), written(self.chunks()), SNAPSHOT)

    def set_meta(self, key: str, value: str) -> None:
        """Keep a value under a key; the last one wins."""
        folder = f"{self.root}/meta/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(key, value, time.time_ns())], "key string, value string, at long").write.parquet(folder)

    def meta(self) -> DataFrame:
        """(key, value)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/meta")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "key string, value string")
        rows = self.spark.read.option("recursiveFileLookup", "true").schema("key string, value string, at long").parquet(f"{self.root}/meta")
        return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
