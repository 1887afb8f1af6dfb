"""Order-based operations on keys of any size.

A plain window puts all rows of its key in one task.  The functions here split the time line of a key into
blocks, work inside (key, block) groups, and pass between blocks only one row per block: how many rows came
before, or what the last row was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_block(epoch: Column, seconds: int) -> Column:
    """Number of the block an epoch second belongs to."""
    return F.floor(epoch / F.lit(seconds)).cast("bigint")


def row_number_in_blocks(df: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """``row_number`` over ``keys`` in the order (block, order), starting at 1."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn("_here", F.row_number().over(inside))
        .join(sizes, [*keys, block])
        .withColumn(name, F.col("_here") + F.col("_before"))
        .drop("_here", "_before")
    )


def with_neighbours(df: DataFrame, keys: list[str], block: str, order: list[str], carried: list[str]) -> DataFrame:
    """Add ``prev``, ``next`` (structs of ``order`` and ``carried``) of the rows before and after in each key.

    Both are null at the ends of the key.  Blocks without rows are skipped, however long.
    """
    fields = order + [c for c in carried if c not in order]
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(block)
    row = F.struct(*fields)
    borders = (
        df.groupBy(*keys, block)
        .agg(F.min(row).alias("_head"), F.max(row).alias("_tail"))
        .select(
            *keys,
            block,
            F.lag("_tail").over(across).alias("_from"),
            F.lead("_head").over(across).alias("_to"),
        )
    )
    return (
        df.withColumns({"_prev": F.lag(row).over(inside), "_next": F.lead(row).over(inside)})
        .join(borders, [*keys, block])
        .withColumns({"prev": F.coalesce("_prev", "_from"), "next": F.coalesce("_next", "_to")})
        .drop("_prev", "_next", "_from", "_to")
    )
