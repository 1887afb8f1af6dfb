"""Writers of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the output columns.
MATCH_COLUMNS = ["customid", "trajid", "timest", "roadID", "seq"]
SEGMENT_COLUMNS = [
    "customid", "timest", "latitude", "longitude", "accuracy", "timediff", "spacediff", "speed", "speeddiff",
    "trajid", "rnd", "weekday", "dayhour", "geojson", "status",
]


def write_matches(routes: DataFrame, table: str) -> None:
    """Replace ``table`` by the driven roads."""
    routes.select(*MATCH_COLUMNS).write.mode("overwrite").saveAsTable(table)


def write_segments(points: DataFrame, table: str) -> None:
    """Replace ``table`` by the segmented points."""
    points.select(*SEGMENT_COLUMNS).write.mode("overwrite").saveAsTable(table)


# Buckets of a table by day.  A table keeps the number it was made with.
BUCKETS = 64
TRAJECTORY = ["customid", "trajid"]


def write_daily(rows: DataFrame, table: str, columns: list[str], buckets: int = BUCKETS) -> None:
    """Put ``rows`` into ``table`` by the UTC day of ``timest``, in place of what it held of these days.

    Days that are not in ``rows`` stay, so one day can be computed again; a trajectory that runs over midnight lies in
    both days.  Inside a day, rows are bucketed by trajectory and sorted by time: aggregates and joins by trajectory read
    the table without a shuffle, and a filter on ``day`` reads that day's files only.  A (day, bucket) is written by one
    task as one file, row by row, so a trajectory of any length takes a task per day.  The table is made if there is none;
    rows without a time form a day of their own.
    """
    spark = rows.sparkSession
    day = F.date_from_unix_date(F.floor(F.col("timest") / 86400).cast("int"))
    placed = rows.select(*columns, day.alias("day"))
    if not spark.catalog.tableExists(table):
        empty = placed.limit(0).write.partitionBy("day").bucketBy(buckets, *TRAJECTORY).sortBy(*TRAJECTORY, "timest")
        empty.saveAsTable(table)
    own = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    bucket = F.pmod(F.hash(*TRAJECTORY), F.lit(int(own["data_type"])))
    dealt = placed.repartition(F.col("day"), bucket)
    # An insert into a table takes this from the session and from nowhere else.
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def write_matches_daily(routes: DataFrame, table: str) -> None:
    """The driven roads, by day; see ``write_daily``."""
    write_daily(routes, table, MATCH_COLUMNS)


def write_segments_daily(points: DataFrame, table: str) -> None:
    """The segmented points, by day; see ``write_daily``."""
    write_daily(points, table, SEGMENT_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files with a header; nested columns are written as JSON."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)
