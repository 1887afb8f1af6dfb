"""Moves between candidates of consecutive points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.geo import fixed, haversine_m
from roadtrace.operators.blocks import with_neighbours
from roadtrace.operators.candidates import BLOCK
from roadtrace.params import MatchParams

# Log probabilities are added as whole numbers of this resolution: the same sums whatever the grouping.
LOG_SCALE = 1e9

KEYS = ["customid", "trajid"]
ORDER = ["timest", "latitude", "longitude"]


def linked_points(points: DataFrame) -> DataFrame:
    """Points with ``prev`` and ``next`` matched point of their trajectory.

    The keys are never null here.  Saying so gives both readers of the layout the same plan, so they share it.
    """
    named = points
    for key in BLOCK:
        named = named.where(F.col(key).isNotNull())
    return with_neighbours(named.repartition(*BLOCK), KEYS, "tblock", ORDER, ["cands"])


def transition_pairs(linked: DataFrame) -> DataFrame:
    """Every candidate of a point with every candidate of the next one; the last point has no successor."""
    own = F.explode("cands").alias("one")
    return (
        linked.select(*KEYS, *ORDER, own, F.col("next.cands.road_id").alias("succ"))
        .select(*KEYS, *ORDER, "one.road_id", "one.prob", F.explode_outer("succ").alias("succ_id"))
    )


def pairs_with_paths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """Pairs with the connecting path, null where there is none."""
    links = paths.select(F.col("start_id").alias("road_id"), F.col("end_id").alias("succ_id"), "path")
    return pairs.join(links, ["road_id", "succ_id"], "left")


def _with_facts(linked: DataFrame, facts: DataFrame) -> DataFrame:
    """Points with ``moves``: structs of candidate ``i`` here, candidate ``k`` of the point before, ``fact`` of their path.

    Only the different road pairs of a block travel to the path table; what is known of them comes back as one map
    per block, from start to end to fact, in which the points look up their moves.  Points stay where their block is.
    A block has at most one point per second and thus a bounded number of pairs; a point reads the map of its block and
    takes over its own facts only.
    """
    c = F.col
    fact = [name for name in facts.columns if name not in ("start_id", "end_id")]
    asked = (
        linked.select(*BLOCK, c("prev.cands.road_id").alias("starts"), F.explode("cands.road_id").alias("end_id"))
        .select(*BLOCK, "end_id", F.explode("starts").alias("start_id"))
        .dropDuplicates([*BLOCK, "start_id", "end_id"])
    )
    known = (
        asked.join(facts, ["start_id", "end_id"])
        .select(*BLOCK, "start_id", F.struct("end_id", F.struct(*fact).alias("fact")).alias("to"))
        .repartition(*BLOCK)
        .groupBy(*BLOCK, "start_id")
        .agg(F.map_from_entries(F.collect_list("to")).alias("ends"))
        .groupBy(*BLOCK)
        .agg(F.map_from_entries(F.collect_list(F.struct("start_id", "ends"))).alias("known"))
    )
    # Where nothing comes before, there is one move without origin per candidate.
    before = F.coalesce("prev.cands", F.array(F.lit(None)))
    moves = F.flatten(
        F.transform(
            "cands",
            lambda i: F.transform(
                before,
                lambda k: F.struct(
                    i.alias("i"), k.alias("k"), c("known")[k["road_id"]][i["road_id"]].alias("fact")
                ),
            ),
        )
    )
    return linked.join(known, BLOCK, "left").withColumn("moves", moves).drop("known")


def _chord_route() -> Column:
    """Route length where feet lie on chords of roads, or nowhere."""
    c = F.col
    a, b = c("k.foot_lat").isNotNull(), c("i.foot_lat").isNotNull()
    one_road = (
        F.when(a & b, haversine_m(c("k.foot_lat"), c("k.foot_lon"), c("i.foot_lat"), c("i.foot_lon")))
        .when(a, F.when(c("i.near0"), c("k.to0")).otherwise(c("k.to1")))
        .otherwise(F.when(c("k.near0"), c("i.to0")).otherwise(c("i.to1")))
    )
    head = F.when(a, F.when(c("first_at0"), c("k.to0")).otherwise(c("k.to1"))).otherwise(c("first_length"))
    tail = F.when(b, F.when(c("last_at0"), c("i.to0")).otherwise(c("i.to1"))).otherwise(c("last_length"))
    return (
        F.when(~a & ~b, c("whole")).when(c("roads") == 1, one_road).otherwise(head + c("inner") + tail)
    )


def _measured_route() -> Column:
    """Route length where every point has a place on its road."""
    c = F.col
    head, tail = F.abs(c("exit_at") - c("k.to0")), F.abs(c("i.to0") - c("enter_at"))
    return F.when(c("roads") == 1, F.abs(c("i.to0") - c("k.to0"))).otherwise(head + c("inner") + tail)


def transitions(linked: DataFrame, facts: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Every move into a point: candidate k of the point before, candidate i of this one, log probability.

    The route length is the path length with the first and last road cut at the feet of the two points, with
    ``full_length`` as differences of places on the roads (``facts`` are those of ``measured_facts``).  The
    log probability compares it with the distance of the points; it is null where no path connects the roads.
    The first point of a trajectory has one row per candidate with no ``k``.
    """
    c = F.col
    joined = (
        _with_facts(linked, facts)
        .withColumn("gap", haversine_m(c("latitude"), c("longitude"), c("prev.latitude"), c("prev.longitude")))
        .select(
            *BLOCK,
            *ORDER,
            c("next").isNull().alias("is_last"),
            c("prev.timest").alias("prev_timest"),
            "gap",
            F.explode("moves").alias("m"),
        )
        .select(
            *BLOCK,
            *ORDER,
            "is_last",
            "prev_timest",
            "gap",
            "m.i",
            "m.k",
            c("m.k.road_id").alias("start_id"),
            c("m.i.road_id").alias("end_id"),
            "m.fact.*",
        )
    )
    route = _measured_route() if p.full_length else _chord_route()
    return (
        joined.withColumn("route", F.when(c("roads").isNotNull(), route))
        .withColumn("log_move", -F.abs(c("gap") - c("route")) / p.beta - F.lit(math.log(p.beta)))
        .select(
            *BLOCK,
            *ORDER,
            "is_last",
            "prev_timest",
            "gap",
            c("i.rank").alias("i"),
            c("end_id").alias("road_id"),
            c("i.prob").alias("prob"),
            c("i.log_prob").alias("log_prob"),
            c("k.rank").alias("k"),
            c("start_id").alias("prev_id"),
            c("k.log_prob").alias("prev_log_prob"),
            "route",
            "log_move",
        )
    )


def scored(moves: DataFrame) -> DataFrame:
    """Whole-number log scores: ``emit`` of the candidate, ``prev_emit`` of the one before, ``move`` between them.

    The same initial probability for every road would not change any comparison and is left out.
    """
    return moves.withColumns(
        {
            "emit": fixed(F.col("log_prob"), LOG_SCALE),
            # Only the first point of a trajectory has none before it.
            "prev_emit": F.when(F.col("k").isNull(), F.lit(0)).otherwise(fixed(F.col("prev_log_prob"), LOG_SCALE)),
            "move": F.when(F.col("k").isNull(), F.lit(0)).otherwise(fixed(F.col("log_move"), LOG_SCALE)),
        }
    )
