"""Changes on top of an unchanging base: what search sees before the next rebuild."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OVERFLOW_LIMIT, TOMBSTONE_RATIO


@dataclass(frozen=True)
class Overlay:
    """``tombstones``: (doc_id) whose base chunks are gone. ``overflow``: new chunks with ``_seq``, the change that
    brought them. Values are never changed in place; a reader keeps what it captured."""

    tombstones: DataFrame
    overflow: DataFrame
    generation: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, items: DataFrame) -> Overlay:
        schema = items.schema
        return cls(spark.createDataFrame([], "doc_id long"), spark.createDataFrame([], schema).withColumn("_seq", F.lit(0).cast("long")))

    def modify(self, doc_ids: DataFrame, chunks: DataFrame) -> Overlay:
        """The documents' chunks, wherever they are, give way to ``chunks``; documents without new chunks are gone."""
        ids = doc_ids.select("doc_id").distinct()
        n = self.generation + 1
        kept = self.overflow.join(ids, "doc_id", "left_anti")
        return replace(self, tombstones=self.tombstones.unionByName(ids).distinct(), overflow=kept.unionByName(chunks.withColumn("_seq", F.lit(n).cast("long"))), generation=n)

    def tombstone(self, doc_ids: DataFrame) -> Overlay:
        """The documents are gone."""
        return self.modify(doc_ids, self.overflow.drop("_seq").limit(0))

    def add(self, chunks: DataFrame) -> Overlay:
        """New chunks of documents that have none in the base."""
        n = self.generation + 1
        return replace(self, overflow=self.overflow.unionByName(chunks.withColumn("_seq", F.lit(n).cast("long"))), generation=n)

    def live(self, base: DataFrame) -> DataFrame:
        """All visible chunks: base without tombstoned documents (``_src`` 0), then overflow (``_src`` 1)."""
        kept = base.join(self.tombstones, "doc_id", "left_anti").withColumn("_src", F.lit(0)).withColumn("_seq", F.lit(0).cast("long"))
        return kept.unionByName(self.overflow.withColumn("_src", F.lit(1)))

    def stats(self, base: DataFrame) -> DataFrame:
        """One row: tombstones (base chunks gone), overflow, generation, ratio, and whether a rebuild is due."""
        gone = base.join(self.tombstones.distinct(), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("tombstones"))
        total = base.agg(F.count(F.lit(1)).alias("base_chunks"))
        extra = self.overflow.agg(F.count(F.lit(1)).alias("overflow"))
        ratio = F.col("tombstones") / F.greatest(F.col("base_chunks"), F.lit(1))
        return (
            total.crossJoin(gone).crossJoin(extra)
            .withColumn("generation", F.lit(self.generation)).withColumn("ratio", ratio)
            .withColumn("needs_rebuild", (F.col("overflow") >= OVERFLOW_LIMIT) | (ratio >= TOMBSTONE_RATIO))
        )


def base_order() -> list:
    """Order in which chunks are looked at: the base by document, place in the page and id; then overflow as it came."""
    return [F.col("_src"), F.col("_seq"), F.col("doc_id"), F.col("chunk_ord"), F.col("chunk_id")]
