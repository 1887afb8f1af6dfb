"""Raw pings to cleaned trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.functions.geo import floor_to, haversine_m, local_time, point_geojson
from roadtrace.operators.blocks import time_block
from roadtrace.params import SegmentParams

# Metres per second to km/h; outlier limit = speed / 3 + walking speed.
KMH = 3.6
OUTLIER_SHARE = 3
WALKING_KMH = 2


def valid_pings(pings: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Pings with all five values, inside the time range and the box, and accurate enough."""
    columns = ["customid", "timestamp", "latitude", "longitude", "accuracy"]
    keep = F.lit(True)
    for name in columns:
        keep = keep & F.col(name).isNotNull()
    return pings.select(*columns).where(
        keep
        & F.col("timestamp").between(*p.time_range)
        & F.col("latitude").between(*p.lat_range)
        & F.col("longitude").between(*p.lon_range)
        & (F.col("accuracy") < p.max_accuracy)
    )


def best_per_second(pings: DataFrame) -> DataFrame:
    """One row per user and second: the most accurate ping, and how many there were.

    A plain aggregate, so copies of a ping are merged before the shuffle.
    """
    return (
        pings.groupBy("customid", F.col("timestamp").alias("timest"))
        .agg(
            F.min(F.struct("accuracy", "latitude", "longitude")).alias("best"),
            F.count(F.lit(1)).alias("copies"),
        )
    )


def clean_pings(pings: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Valid pings of users with more than ``min_pings`` of them, one per second.

    The user's total reaches the pings over (user, block), never over the user alone.
    """
    block = time_block(F.col("timest"), p.block_seconds)
    seconds = best_per_second(valid_pings(pings, p)).withColumn("block", block)
    users = (
        seconds.groupBy("customid", "block")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("total", F.sum("copies").over(Window.partitionBy("customid")))
        .where(F.col("total") > p.min_pings)
        .select("customid", "block")
    )
    return seconds.join(users, ["customid", "block"], "left_semi").select(
        "customid", "timest", "best.latitude", "best.longitude", "best.accuracy"
    )


def is_outlier(speed: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """True where a speed is far from the mean of the two speeds before and of the two after it."""
    limit = speed / OUTLIER_SHARE + WALKING_KMH
    far_before = F.abs(speed - (before[0] + before[1]) / 2) > limit
    far_after = F.abs(speed - (after[0] + after[1]) / 2) > limit
    return far_before & far_after


def _with_halo(seconds: DataFrame, p: SegmentParams) -> DataFrame:
    """Copy each row to its own block and, near a border, to the block that looks back or ahead at it.

    A kept point depends on the three points before and the two after it, all less than ``max_gap`` apart.
    """
    home = time_block(F.col("timest"), p.block_seconds)
    offset = F.pmod(F.col("timest"), F.lit(p.block_seconds))
    look_back, look_ahead = 3 * (p.max_gap - 1), 2 * (p.max_gap - 1)
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= p.block_seconds - look_back, home + 1),
            F.when(offset < look_ahead, home - 1),
        )
    )
    return seconds.withColumn("block", F.explode(copies)).withColumn("own", F.col("block") == home)


def _motion(seconds: DataFrame, p: SegmentParams) -> DataFrame:
    """Deltas to the previous ping, and whether the ping continues its trajectory."""
    inside = Window.partitionBy("customid", "block").orderBy("timest")
    c = F.col
    return (
        _with_halo(seconds, p)
        .withColumns({"before": F.lag("best").over(inside), "timediff": c("timest") - F.lag("timest").over(inside)})
        .withColumn(
            "spacediff",
            haversine_m(c("best.latitude"), c("best.longitude"), c("before.latitude"), c("before.longitude")),
        )
        .withColumns(
            {
                "speed": c("spacediff") / c("timediff") * KMH,
                "goes_on": F.coalesce(c("timediff") < p.max_gap, F.lit(False)),
            }
        )
        # The last two conditions always hold; asking keeps both readers of this frame on the same columns, so
        # that they share one shuffle.
        .withColumn(
            "starts", (c("own") & ~c("goes_on") & c("best").isNotNull() & (c("copies") > 0)).cast("int")
        )
    )


def _user_blocks(motion: DataFrame, p: SegmentParams) -> DataFrame:
    """Per (user, block): trajectories started in earlier blocks.  Only users with enough pings remain.

    The windows see one row per block, at most (time range / block_seconds) rows per user.
    """
    user = Window.partitionBy("customid")
    earlier = user.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        motion.groupBy("customid", "block")
        .agg(F.sum("starts").alias("starts"), F.sum(F.when(F.col("own"), F.col("copies"))).alias("copies"))
        .select(
            "customid",
            "block",
            F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("started"),
            F.sum("copies").over(user).alias("total"),
        )
        .where(F.col("total") > p.min_pings)
        .drop("total")
    )


def _tag(user: Column, second: Column) -> Column:
    """A number from 0 up to 1 that depends on user and time alone: the first five hexadecimal digits of a digest."""
    digest = F.md5(F.concat_ws("|", user, second.cast("string")))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / float(16**5)


def segment(pings: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Raw pings to trajectories with speed, spacing, calendar and outlier columns.

    A gap of ``max_gap`` seconds starts a new trajectory.  Of each trajectory the first three and the last two
    points are dropped, and so are speed outliers.
    """
    c = F.col
    motion = _motion(best_per_second(valid_pings(pings, p)), p)
    inside = Window.partitionBy("customid", "block").orderBy("timest")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    def lag(name: str, n: int) -> Column:
        return F.lag(name, n).over(inside) if n > 0 else F.lead(name, -n).over(inside)

    around = motion.withColumns(
        {
            "begun": F.sum("starts").over(so_far),
            "v1": lag("speed", 1),
            "v2": lag("speed", 2),
            "w1": lag("speed", -1),
            "w2": lag("speed", -2),
            "framed": c("goes_on") & lag("goes_on", 1) & lag("goes_on", 2) & lag("goes_on", -1) & lag("goes_on", -2),
        }
    ).where(c("own") & c("framed"))
    kept = around.where(~is_outlier(c("speed"), (c("v1"), c("v2")), (c("w1"), c("w2"))))
    clock = local_time(c("timest"), p.zone)
    lat, lon = c("best.latitude"), c("best.longitude")
    return kept.join(_user_blocks(motion, p), ["customid", "block"]).select(
        "customid",
        "timest",
        floor_to(lat, p.digits).alias("latitude"),
        floor_to(lon, p.digits).alias("longitude"),
        c("best.accuracy").alias("accuracy"),
        "timediff",
        floor_to(c("spacediff"), p.digits).alias("spacediff"),
        floor_to(c("speed"), p.digits).alias("speed"),
        floor_to(c("speed") - c("v1"), p.digits).alias("speeddiff"),
        (c("started") + c("begun") - 1).cast("int").alias("trajid"),
        _tag(c("customid"), c("timest")).alias("rnd"),
        F.dayofweek(clock).alias("weekday"),
        F.hour(clock).alias("dayhour"),
        point_geojson(lat, lon, p.digits).alias("geojson"),
        F.lit("in").alias("status"),
    )
