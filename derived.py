"""Pings, ways and nodes computed from the star-schema test tables, row by row.

Some ways have an outdated version of another class; some have names; directions differ.  Every sixth user drives on
without a stop, to and fro, for longer than a time block of the decoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.operators.blocks import row_number_in_blocks

COLUMNS = 40

# Class of a way, by its first node number modulo the list length.
CLASS_CYCLE = (
    "motorway",
    "trunk",
    "primary",
    "secondary",
    "tertiary",
    "unclassified",
    "residential",
    "residential",
    "service",
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A lattice of nodes, 40 per row, one per part."""
    k = F.col("p_partkey")
    return _table(spark, folder, "part").select(
        F.concat(F.lit("N"), k.cast("string")).alias("id"),
        F.lit(0).cast("bigint").alias("userid"),
        F.lit("2018-01-01T00:00:00Z").alias("timestamp"),
        F.lit(False).alias("isvisible"),
        F.lit(1).alias("version"),
        F.lit(0).cast("bigint").alias("changesetid"),
        F.create_map().cast("map<string,string>").alias("tags"),
        (F.lit(45.44) + F.lit(0.0005) * F.floor(k / COLUMNS)).alias("latitude"),
        (F.lit(9.14) + F.lit(0.0007) * (k % COLUMNS)).alias("longitude"),
    )


def derived_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Ways of three nodes along the rows (WH...) and columns (WV...) of the lattice, with their versions."""
    part = _table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey")
    i, j = k % COLUMNS, F.floor(k / COLUMNS)
    top = part.select(F.max("p_partkey")).scalar()
    even = i % 2 == 0
    along = F.struct(F.lit("WH").alias("kind"), F.lit(1).alias("step"))
    across = F.struct(F.lit("WV").alias("kind"), F.lit(COLUMNS).alias("step"))
    shapes = F.array_compact(
        F.array(F.when(even & (i <= 37), along), F.when(even & (j % 2 == 0) & (k + 2 * COLUMNS <= top), across))
    )
    classes = F.array(*[F.lit(c) for c in CLASS_CYCLE])
    step = F.col("shape.step")
    refs = [F.concat(F.lit("N"), (k + n * step).cast("string")) for n in range(3)]
    usual = F.get(classes, (k % len(CLASS_CYCLE)).cast("int"))
    versions = F.array_compact(
        F.array(
            F.when(k % 45 == 1, F.struct(F.lit(1).alias("number"), F.lit("residential").alias("class"))),
            F.when(k % 35 == 2, F.struct(F.lit(1).alias("number"), F.lit("service").alias("class"))),
            F.struct(F.lit(2).alias("number"), F.when(k % 45 == 1, F.lit("service")).otherwise(usual).alias("class")),
        )
    )
    own = part.select(k, F.explode(shapes).alias("shape")).select("*", F.explode(versions).alias("v"))
    return own.select(
        F.concat("shape.kind", k.cast("string")).alias("id"),
        F.lit(0).cast("bigint").alias("userid"),
        F.lit("2018-01-01T00:00:00Z").alias("timestamp"),
        F.lit(False).alias("isvisible"),
        F.col("v.number").alias("version"),
        F.lit(0).cast("bigint").alias("changesetid"),
        F.map_filter(
            F.create_map(
                F.lit("highway"), F.col("v.class"),
                F.lit("oneway"), F.when(k % 3 == 0, F.lit("no")).otherwise(F.lit("yes")),
                F.lit("name"), F.when(k % 4 == 0, F.concat(F.lit("Via "), k.cast("string"))),
            ),
            lambda _, value: value.isNotNull(),
        ).alias("tags"),
        F.array(*refs).alias("nodes"),
    )


def derived_pings(spark: SparkSession, folder: str) -> DataFrame:
    """One ping per event: users drive along the rows of the lattice, with gaps, copies and outliers."""
    rows = _table(spark, folder, "part").select(F.floor(F.max("p_partkey") / COLUMNS) + 1).scalar()
    events = _table(spark, folder, "events").select(
        "user_id", "event_id", "ts", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")
    )
    ranked = row_number_in_blocks(events, ["user_id"], "day", ["ts", "event_id"], "n")
    e, k = F.col("event_id"), F.col("n") - 1
    onward = F.col("user_id") % 6 == 0
    repeated = ((e % 50 == 0) & (k > 0)).cast("int")
    jump = (e % 37 == 0).cast("int")
    return ranked.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("customid"),
        (
            F.lit(1504300000)
            + F.when(onward, 10 * (k - repeated)).otherwise(5 * (k - repeated) + 3600 * F.floor(k / COLUMNS))
        ).cast("int").alias("timestamp"),
        (
            F.lit(45.44) + F.lit(0.0005) * (F.col("user_id") % rows) + F.lit(0.00002) * (e % 7 - 3)
            + jump * F.lit(0.003)
        ).alias("latitude"),
        (
            F.lit(9.1402)
            + F.when(onward, F.lit(0.001) * F.least(k % 48, 48 - k % 48)).otherwise(F.lit(0.0006) * (k % COLUMNS))
            + F.lit(0.00002) * (e % 5 - 2)
        ).alias("longitude"),
        (e % 110).cast("int").alias("accuracy"),
    )
