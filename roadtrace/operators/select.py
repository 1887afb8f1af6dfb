"""Choice of the trajectories worth matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.params import CENTRE_LAT, CENTRE_LON, MIN_MEAN_SPACING, MIN_MEAN_SPEED, MIN_POINTS_ABOVE, TOP_K

TRAJECTORY = ["customid", "trajid"]


def moving_points(points: DataFrame) -> DataFrame:
    """Points with a positive speed, nine columns."""
    return points.select(
        "customid", "trajid", "timest", "latitude", "longitude", "timediff", "spacediff", "speed", "geojson"
    ).where(F.col("speed") > 0)


def quality_trajectories(points: DataFrame) -> DataFrame:
    """Moving points of trajectories that are fast, spread out and long enough.

    The three limits come from one aggregate per trajectory (merged before the shuffle); the points are then
    semi-joined, so no trajectory has to fit in a task.
    """
    moving = moving_points(points)
    good = (
        moving.groupBy(*TRAJECTORY)
        .agg(F.avg("spacediff").alias("spacing"), F.avg("speed").alias("pace"), F.count(F.lit(1)).alias("n"))
        .where(
            (F.col("spacing") > MIN_MEAN_SPACING)
            & (F.col("pace") > MIN_MEAN_SPEED)
            & (F.col("n") > MIN_POINTS_ABOVE)
        )
    )
    return moving.join(good, TRAJECTORY, "left_semi")


def centre_counts(points: DataFrame) -> DataFrame:
    """Complete rows inside the centre box per trajectory."""
    inside = points.where(F.col("latitude").between(*CENTRE_LAT) & F.col("longitude").between(*CENTRE_LON))
    return inside.groupBy(*TRAJECTORY).agg(F.count_if(_complete(points)).alias("n_inside"))


def _complete(points: DataFrame):
    whole = F.lit(True)
    for name in points.columns:
        whole = whole & F.col(name).isNotNull()
    return whole


def top_trajectories(points: DataFrame, k: int = TOP_K) -> DataFrame:
    """All points of the ``k`` trajectories with most points in the centre box; ties go to the smaller ids.

    The chosen ids are ``k`` rows, so sending them to every task is safe at any data size.
    """
    top = centre_counts(points).orderBy(F.desc("n_inside"), *TRAJECTORY).limit(k).select(*TRAJECTORY)
    return points.join(F.broadcast(top), TRAJECTORY, "left_semi")
