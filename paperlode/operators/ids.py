"""Consecutive numbers for rows without a single task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(df: DataFrame, order: list[str], to: str, start: int) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in ``to``, in ``order``.

    Rows are cut into ranges; each range numbers its own rows, on top of the counts of the ranges before it
    (one small row a range). The ranges are written once, as numbering must not see them change.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    mine = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(to, (F.lit(start - 1) + F.col("_before") + mine).cast("long")).drop("_part", "_before")
