"""Pairs of rows that share a key, safe for keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task compares with each other.
BLOCK = 1024


def key_pairs(rows: DataFrame, key: list[str], row_id: str, condition: Column | None = None, block: int = BLOCK) -> DataFrame:
    """All unordered pairs of rows with equal ``key``, as columns ``a`` and ``b`` (structs of the other columns).

    A key with more than ``block`` rows is cut into blocks; each pair of blocks is a cell of its own,
    so no task gets more than ``2 * block`` rows of a key at once and the cells of a hot key spread over
    the cluster. No pair is left out. In a pair, a.row_id < b.row_id; rows of a key with the same ``row_id`` aren't paired.
    Rows with a null in the key pair with nothing. ``condition`` may restrict the pairs, over ``a`` and ``b``.
    Keys are counted with map-side combining, and keys with one row are dropped before the pairing join; the join
    with the counts has one row a key on one side, so adaptive execution may split a hot key's rows among tasks.
    """
    rest = [c for c in rows.columns if c not in key]
    whole = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    several = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    placed = (
        whole.join(several, key)
        .withColumn("_blocks", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
        .withColumn("_mine", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            *key,
            F.least("_mine", "_other").alias("_lo"),
            F.greatest("_mine", "_other").alias("_hi"),
            "_mine",
            F.struct(*rest).alias("_row"),
        )
    )
    cell = [*key, "_lo", "_hi"]
    left = placed.select(*cell, F.col("_mine").alias("_a_block"), F.col("_row").alias("a"))
    right = placed.select(*cell, F.col("_mine").alias("_b_block"), F.col("_row").alias("b"))
    # within a cell of two blocks only pairs across them count; those inside a block have a cell of their own
    once = (F.col(f"a.{row_id}") < F.col(f"b.{row_id}")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_a_block") != F.col("_b_block")))
    joined = left.join(right, cell).where(once)
    if condition is not None:
        joined = joined.where(condition)
    return joined.select(*key, "a", "b")
