"""Shards that all hold the sources in the mixture of the whole, by proportional stratified interleaving.

The rows of each source are shuffled by a seeded digest and ranked.  Row number r of n gets the fractional rank
``(r + phase) / n``, where the phase is a fixed fraction per source, so that sources of one row spread as well.
Sorted by fractional rank, the sources interleave in proportion everywhere; the sorted line is cut into equal
pieces, so shard sizes in rows differ by one at most.

No source is ranked in one task: rows are counted per source and slice of the digest, only these counts are summed
along a source, and rows are numbered within a slice.  The sorted line is numbered the same way, by slices of the
fractional rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed

# Slices of the digest, per source, and of the fractional rank.  Three hexadecimal digits.
SLICES = 4096
SEED = "shards-1"


def _running(counts: DataFrame, order: str, *groups: str) -> DataFrame:
    """Counts with the number of rows before each slice and in all slices of the group."""
    along = Window.partitionBy(*groups).orderBy(order) if groups else Window.orderBy(order)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return counts.select(*groups, order, before.alias("_before"), F.sum("_n").over(whole).alias("_all"))


def interleave(rows: DataFrame, shards: int, source: Column, identity: Column, seed: str = SEED) -> DataFrame:
    """``rows`` with two more columns: ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in a shard).

    ``identity`` is a string that tells rows apart; rows that share it (repeated rows) are numbered in any order.
    A null source is a source of its own, and a null identity counts as the empty one.  ``rows`` may have any
    columns but ``shard``, ``slot`` and those that begin with an underscore.  Pass narrow rows and join wide
    columns later, or pass them along: they move twice.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(identity, F.lit(""))))
    own = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    shuffled = rows.withColumns({"_source": own, "_turn": digest}).withColumn(
        "_slice", F.conv(F.substring("_turn", 1, 3), 16, 10).cast("int")
    )
    sizes = shuffled.groupBy("_source", "_slice").agg(F.count("*").alias("_n"))
    within = Window.partitionBy("_source", "_slice").orderBy("_turn")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_source"))), 1, 4), 16, 10).cast("int") / 65536.0
    ranked = (
        shuffled.join(_running(sizes, "_slice", "_source"), ["_source", "_slice"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
        .withColumn("_part", (F.col("_rank") + phase) / F.col("_all"))
        .drop("_slice", "_turn", "_before", "_all")
        .withColumn("_slice", F.floor(F.col("_part") * SLICES))
    )
    ranked = checkpointed(ranked)
    sizes = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    # At most SLICES + 1 rows, whatever the input.
    line = F.broadcast(_running(sizes, "_slice"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy("_part", "_source", "_rank")) - 1
    placed = ranked.join(line, "_slice").withColumn("_place", place)
    exact = F.expr(f"(_place * {shards}) div _all")
    first = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_shard", exact)
        .withColumn("slot", F.col("_place") - first)
        .withColumn("shard", F.col("_shard").cast("int"))
        .select(*rows.columns, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
