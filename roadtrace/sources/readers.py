"""Readers of the four input tables, from a table, Parquet files or a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and types of the input columns.
WAY_SCHEMA = (
    "id string, userid bigint, timestamp string, isvisible boolean, version int, changesetid bigint, "
    "tags map<string,string>, nodes array<string>"
)
NODE_SCHEMA = (
    "id string, userid bigint, timestamp string, isvisible boolean, version int, changesetid bigint, "
    "tags map<string,string>, latitude double, longitude double"
)
TRAJECTORY_SCHEMA = (
    "customid string, trajid int, timest int, latitude double, longitude double, timediff int, "
    "spacediff double, speed double, geojson string"
)
PING_SCHEMA = "customid string, timestamp int, latitude double, longitude double, accuracy int"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.replace("map<string,string>", "map").split(",")]


def _read(spark: SparkSession, source: DataFrame | str, columns: list[str]) -> DataFrame:
    """A DataFrame as it is; a name with a slash as Parquet files; any other name as a table."""
    if isinstance(source, DataFrame):
        df = source
    elif "/" in source:
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    return df.select(*columns)


def read_ways(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return _read(spark, source, _names(WAY_SCHEMA))


def read_nodes(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return _read(spark, source, _names(NODE_SCHEMA))


def read_trajectories(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return _read(spark, source, _names(TRAJECTORY_SCHEMA))


def read_pings(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return _read(spark, source, _names(PING_SCHEMA))
