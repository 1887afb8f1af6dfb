"""Driven roads from matched points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routes(decoded: DataFrame, paths: DataFrame) -> DataFrame:
    """Roads in driving order: customid, trajid, timest, roadID, seq.

    Where the matched road changes, the connecting path without its last road is driven from the earlier
    point on; where it stays, nothing is added.  The last point of a trajectory, if matched, adds its own road.
    ``seq`` numbers the roads of one point from 0, so (timest, seq) orders the route.
    """
    c = F.col
    # Changes of road are few compared with points, and the key pairs are those of the path table.
    changes = decoded.where(c("prev_id").isNotNull() & (c("prev_id") != c("road_id"))).select(
        "customid", "trajid", c("prev_timest").alias("timest"), c("prev_id").alias("start_id"), c("road_id").alias("end_id")
    )
    links = paths.select("start_id", "end_id", F.slice("path.road", F.lit(1), F.size("path") - 1).alias("driven"))
    filled = changes.join(links, ["start_id", "end_id"]).select(
        "customid", "trajid", "timest", F.posexplode("driven").alias("seq", "roadID")
    )
    final = decoded.where("is_last").select(
        "customid", "trajid", "timest", F.lit(0).alias("seq"), c("road_id").alias("roadID")
    )
    return filled.unionByName(final).select("customid", "trajid", "timest", "roadID", "seq")
