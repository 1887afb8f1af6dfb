"""Queries over the test tables, and their SQL equivalents.

Pings, ways and nodes are derived from the whole test tables (see FIXTURES.md); every query runs over all of them.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers started from here find the package as well; on a cluster it is shipped with --py-files.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

import derived  # noqa: E402
import oracles  # noqa: E402
from roadtrace.functions.geo import (  # noqa: E402
    flat_km,
    gaussian_emission,
    haversine_km,
    haversine_m,
    parse_line,
    parse_point,
    project,
    snap,
    unproject,
)
from roadtrace.operators.candidates import candidate_points, candidate_roads  # noqa: E402
from roadtrace.operators.decode import decode  # noqa: E402
from roadtrace.operators.paths import neighbor_paths  # noqa: E402
from roadtrace.operators.roads import adjacency, build_roads, neighbour_lists, road_features  # noqa: E402
from roadtrace.operators.segment import clean_pings, segment  # noqa: E402
from roadtrace.operators.select import quality_trajectories, top_trajectories  # noqa: E402
from roadtrace.operators.transitions import (  # noqa: E402
    linked_points,
    pairs_with_paths,
    transition_pairs,
)
from roadtrace.params import MatchParams  # noqa: E402
from roadtrace.plans.match import (  # noqa: E402
    candidate_paths,
    found_candidates,
    match,
    matched_candidates,
    network,
    path_starts,
    scored_moves,
)
from roadtrace.sources.readers import read_nodes, read_pings, read_trajectories, read_ways  # noqa: E402
from roadtrace.sources.sinks import write_csv, write_matches, write_segments, write_segments_daily  # noqa: E402
from roadtrace.sources.text import parse_text, write_checked_text  # noqa: E402
from roadtrace.staging import shared_folder  # noqa: E402

corpus_pipeline = llm = None
# Only where the subpackage is absent; an error inside it is not hidden.
if find_spec("roadtrace.llm") and find_spec("corpus_pipeline"):
    import corpus_pipeline
    from roadtrace.llm import queries as llm

P = MatchParams.from_args(["alpha=4", "beta=10", "tau=100", "theta=4", "gamma=200"])
GAUSSIAN = MatchParams(tau=500, emission="gaussian")
# Every point is a block of its own.
LONG = replace(P, block_seconds=1)
RESTART = replace(P, restart=True)
# Nearly every cell is dealt into several parts.
CROWDED = replace(P, part_points=8, part_edges=8)
POLYLINE = replace(P, full_length=True)
SMOKE_DIR = "/root/testdata/sf0.001"


def derived_ways(spark: SparkSession, sf: str) -> DataFrame:
    return read_ways(spark, derived.derived_ways(spark, sf))


def derived_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return read_nodes(spark, derived.derived_nodes(spark, sf))


def derived_pings(spark: SparkSession, sf: str) -> DataFrame:
    return read_pings(spark, derived.derived_pings(spark, sf))


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    return build_roads(derived_ways(spark, sf), derived_nodes(spark, sf))


def _network(spark: SparkSession, sf: str):
    return network(derived_ways(spark, sf), derived_nodes(spark, sf), P)


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return segment(derived_pings(spark, sf))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return quality_trajectories(_segments(spark, sf))


def _candidates(spark: SparkSession, sf: str, p: MatchParams = P) -> DataFrame:
    return found_candidates(_points(spark, sf), _network(spark, sf), p)


def _points_of(spark: SparkSession, sf: str):
    """Network and candidate points."""
    net = _network(spark, sf)
    return net, matched_candidates(_points(spark, sf), net, P)


def _moves(spark: SparkSession, sf: str, p: MatchParams = P) -> DataFrame:
    net = _network(spark, sf)
    points = matched_candidates(_points(spark, sf), net, p)
    return scored_moves(points, candidate_paths(points, net, p), net, p)


def _polyline_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Moves along bent roads, measured along their pieces."""
    k = F.substring("id", 2, 20).cast("bigint")
    nodes = derived_nodes(spark, sf).withColumn("latitude", F.col("latitude") + F.lit(0.00011) * (k % 3))
    net = network(derived_ways(spark, sf), nodes, POLYLINE)
    points = matched_candidates(_points(spark, sf), net, POLYLINE)
    return scored_moves(points, candidate_paths(points, net, POLYLINE), net, POLYLINE)


def pings_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pings(derived_pings(spark, sf))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).drop("rnd", "weekday", "dayhour", "geojson")


def segment_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("customid", "timest", "weekday", "dayhour", "geojson")


def segment_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("customid", "timest", "rnd")


def quality(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).drop("geojson")


def top(spark: SparkSession, sf: str) -> DataFrame:
    return top_trajectories(_points(spark, sf)).drop("geojson")


def roads(spark: SparkSession, sf: str) -> DataFrame:
    def whole(x):
        return F.floor(x * 1e7 + 0.5).cast("string")

    return _roads(spark, sf).select(
        "road_id",
        F.col("tags")["highway"].alias("highway"),
        F.size("coordinates").alias("n_points"),
        "lat0",
        "lon0",
        "lat1",
        "lon1",
        F.array_join(
            F.transform("coordinates", lambda n: F.concat_ws(" ", whole(n["lon"]), whole(n["lat"]))), ","
        ).alias("shape"),
        snap(F.col("length"), 3).alias("length"),
    )


def adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return adjacency(_roads(spark, sf)).select(
        "road_id",
        "neighbour_id",
        snap(F.col("length"), 3).alias("length"),
        snap(F.col("neighbour_length"), 3).alias("neighbour_length"),
    )


def lists(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_lists(adjacency(_roads(spark, sf))).select(
        "road_id",
        snap(F.col("length"), 3).alias("length"),
        F.size("neighbours").alias("n"),
        F.array_join("neighbours.neighbour_id", ",").alias("neighbours"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    parsed = road_features(_roads(spark, sf)).withColumn("f", parse_line(F.col("json")))
    line = F.col("f.geometry.coordinates")
    return parsed.select(
        F.col("f.id").alias("road_id"),
        F.col("roadName").alias("name"),
        F.col("f.properties.highway").alias("highway"),
        F.col("f.properties.oneway").alias("oneway"),
        F.size(line).alias("n_points"),
        snap(F.col("f.properties.lenght"), 3).alias("length"),
        line[0][0].alias("first_lon"),
        line[0][1].alias("first_lat"),
    )


def projected(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = parse_point(F.col("geojson"))
    parsed = _points(spark, sf).select("customid", "trajid", "timest", lat.alias("lat"), lon.alias("lon"))
    x, y = project(F.col("lat"), F.col("lon"))
    sx, sy = project(F.col("lat"), F.col("lon"), "swapped")
    placed = parsed.withColumns({"x": x, "y": y, "sx": sx, "sy": sy})
    back_lat, back_lon = unproject(F.col("x"), F.col("y"))
    return placed.select(
        "customid",
        "trajid",
        "timest",
        snap(F.col("x"), 3).alias("x"),
        snap(F.col("y"), 3).alias("y"),
        snap(F.col("sx"), 3).alias("swapped_x"),
        snap(F.col("sy"), 3).alias("swapped_y"),
        snap(back_lat, 6).alias("back_lat"),
        snap(back_lon, 6).alias("back_lon"),
    )


def feet(spark: SparkSession, sf: str) -> DataFrame:
    one = candidate_points(_candidates(spark, sf), P).select(
        "customid", "trajid", "timest", F.explode("cands").alias("c")
    )
    return one.select(
        "customid",
        "trajid",
        "timest",
        "c.road_id",
        snap(F.col("c.foot_lat"), 7).alias("foot_lat"),
        snap(F.col("c.foot_lon"), 7).alias("foot_lon"),
        snap(F.col("c.to0"), 3).alias("to0"),
        snap(F.col("c.to1"), 3).alias("to1"),
        "c.near0",
    )


def distances(spark: SparkSession, sf: str) -> DataFrame:
    here = F.col("latitude"), F.col("longitude")
    end0, end1 = (F.col("lat0"), F.col("lon0")), (F.col("lat1"), F.col("lon1"))
    return _candidates(spark, sf).select(
        "customid",
        "trajid",
        "timest",
        "road_id",
        snap(haversine_m(*here, *end0), 3).alias("metres"),
        snap(haversine_km(*here, *end0), 6).alias("kilometres"),
        snap(flat_km(*here, *end0), 6).alias("flat"),
        snap(haversine_m(*end0, *end1), 3).alias("chord"),
    )


def candidate_rows(spark: SparkSession, sf: str, p: MatchParams = P) -> DataFrame:
    return _candidates(spark, sf, p).select(
        F.col("road_id").alias("roadID"),
        "customid",
        "trajid",
        "timest",
        "latitude",
        "longitude",
        "rank",
        snap(F.col("distance"), 3).alias("distance"),
        snap(F.col("prob"), 9).alias("prob"),
        snap(gaussian_emission(F.col("distance")), 9).alias("gaussian"),
    )


def candidates_crowded(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_rows(spark, sf, CROWDED)


def candidate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    net, points = _points_of(spark, sf)
    return net.pairs.join(candidate_roads(points), "road_id", "left_semi").select(
        "road_id", "neighbour_id", snap(F.col("neighbour_length"), 3).alias("neighbour_length")
    )


def _path_rows(paths: DataFrame) -> DataFrame:
    return paths.select("start_id", "end_id", F.array_join("path.road", ">").alias("path"), "cost", "roads")


def paths_of_candidates(spark: SparkSession, sf: str) -> DataFrame:
    net, points = _points_of(spark, sf)
    return _path_rows(neighbor_paths(net.pairs, path_starts(points, net), P))


def paths_dead_ends_dropped(spark: SparkSession, sf: str) -> DataFrame:
    net = _network(spark, sf)
    return _path_rows(neighbor_paths(net.pairs, net.roads, MatchParams(gamma=400.0, keep_dead_ends=False)))


def paths_of_six_hops(spark: SparkSession, sf: str) -> DataFrame:
    net, points = _points_of(spark, sf)
    return _path_rows(neighbor_paths(net.pairs, path_starts(points, net), MatchParams(theta=6, gamma=600.0)))


def paths_of_all_roads(spark: SparkSession, sf: str) -> DataFrame:
    net = _network(spark, sf)
    return _path_rows(neighbor_paths(net.pairs, net.roads, MatchParams(gamma=400.0)))


def paths_across_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of ``neighbor_paths_deep`` with every node of more than two roads taken as a hub."""
    net = _network(spark, sf)
    pairs, hubs = net.parts(hub_roads=2)
    return _path_rows(neighbor_paths(pairs, net.roads, MatchParams(gamma=400.0), hubs))


def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    net, points = _points_of(spark, sf)
    paths = candidate_paths(points, net, P)
    return pairs_with_paths(transition_pairs(linked_points(points)), paths).select(
        "customid",
        "trajid",
        "timest",
        "latitude",
        "longitude",
        F.col("road_id").alias("roadID"),
        snap(F.col("prob"), 9).alias("prob"),
        F.col("succ_id").alias("succID"),
        F.array_join("path.road", ">").alias("path"),
    )


def _move_rows(moves: DataFrame) -> DataFrame:
    return moves.where(F.col("k").isNotNull()).select(
        "customid",
        "trajid",
        "prev_timest",
        "timest",
        "prev_id",
        "road_id",
        snap(F.col("route"), 3).alias("route"),
        snap(F.coalesce(F.exp("log_move"), F.lit(0.0)), 6).alias("prob"),
    )


def transition_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _move_rows(_moves(spark, sf))


def transitions_polyline(spark: SparkSession, sf: str) -> DataFrame:
    return _move_rows(_polyline_moves(spark, sf))


def decoded_polyline(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_polyline_moves(spark, sf), POLYLINE)


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_moves(spark, sf), P)


def decoded_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_moves(spark, sf, GAUSSIAN), GAUSSIAN)


def decoded_long(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_moves(spark, sf, LONG), LONG)


def decoded_restart(spark: SparkSession, sf: str) -> DataFrame:
    return decode(_moves(spark, sf, RESTART), RESTART)


def routes_restart(spark: SparkSession, sf: str) -> DataFrame:
    return match(_segments(spark, sf), derived_ways(spark, sf), derived_nodes(spark, sf), RESTART)


def routes(spark: SparkSession, sf: str) -> DataFrame:
    return match(_segments(spark, sf), derived_ways(spark, sf), derived_nodes(spark, sf), P)


def _head(df: DataFrame) -> list:
    return [F.col(n).cast("string") for n in ("id", "userid", "timestamp", "isvisible", "version", "changesetid")]


def load_ways(spark: SparkSession, sf: str) -> DataFrame:
    ways = derived_ways(spark, sf)
    lines = ways.select(F.concat_ws(",", *_head(ways), F.to_json("tags"), F.to_json("nodes")).alias("value"))
    return parse_text(lines, "ways").select(
        "id",
        "version",
        F.col("tags")["highway"].alias("highway"),
        F.col("tags")["oneway"].alias("oneway"),
        F.array_join("nodes", ",").alias("nodes"),
    )


def load_damaged_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The ways as text, some lines cut short or with a field that does not parse: good rows, and rejects with faults."""
    ways = derived_ways(spark, sf)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    head = _head(ways)
    version = F.when(k % 11 == 4, F.lit("two")).otherwise(F.col("version").cast("string"))
    tags = F.when(k % 13 == 5, F.lit("{")).otherwise(F.to_json("tags"))
    line = F.concat_ws(",", *head[:4], version, head[5], tags, F.to_json("nodes"))
    lines = ways.select(F.when(k % 17 == 6, F.concat_ws(",", *head[:2])).otherwise(line).alias("value"))
    write_checked_text(lines, "ways", "roadtrace_checked_ways")
    good = spark.table("roadtrace_checked_ways").select("id", F.lit(None).cast("string").alias("faults"))
    bad = spark.table("roadtrace_checked_ways_rejects").select(
        F.substring_index("value", ",", 1).alias("id"), F.array_join("faults", ",").alias("faults")
    )
    return good.unionByName(bad)


def load_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = derived_nodes(spark, sf)
    lines = nodes.select(
        F.concat_ws(
            ",", *_head(nodes), F.to_json("tags"), F.col("latitude").cast("string"), F.col("longitude").cast("string")
        ).alias("value")
    )
    return parse_text(lines, "nodes").select(
        "id", "version", F.size("tags").alias("n_tags"), "latitude", "longitude"
    )


def load_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    lines = points.select(F.concat_ws(",", *[F.col(n).cast("string") for n in points.columns]).alias("value"))
    loaded = read_trajectories(spark, parse_text(lines, "trajectories"))
    lat, lon = parse_point(F.col("geojson"))
    return loaded.withColumns({"json_lon": lon, "json_lat": lat}).drop("geojson")


def sink_matches(spark: SparkSession, sf: str) -> DataFrame:
    write_matches(routes(spark, sf), "roadtrace_matches")
    return spark.table("roadtrace_matches")


def sink_segments(spark: SparkSession, sf: str) -> DataFrame:
    write_segments(_segments(spark, sf), "roadtrace_segments")
    return spark.table("roadtrace_segments").drop("rnd", "weekday", "dayhour", "geojson")


def sink_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of three days, the second one wrong at first and written again; good trajectories of the table."""
    table = "roadtrace_daily_segments"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # All pings are of one evening: every third user drives a day later, every third two days.
    turn = F.substring("customid", 2, 20).cast("int") % 3
    points = _segments(spark, sf).withColumn("timest", (F.col("timest") + 86400 * turn).cast("int"))
    second = turn == 1
    write_segments_daily(points.withColumn("speed", F.when(second, F.lit(0.0)).otherwise(F.col("speed"))), table)
    write_segments_daily(points.where(second), table)
    return quality_trajectories(spark.table(table)).drop("geojson")


def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Roads with their nodes as JSON in comma-separated text, read back."""
    path = f"{shared_folder(spark)}/roads-csv-{uuid.uuid4().hex}"
    write_csv(_roads(spark, sf).select("road_id", "nodes", F.col("tags")["highway"].alias("highway")), path)
    back = spark.read.schema("road_id string, nodes string, highway string").option("header", True).option("escape", "\\")
    return back.csv(path).select(
        "road_id", F.array_join(F.from_json("nodes", "array<string>"), ",").alias("nodes"), "highway"
    )


def entry(spark: SparkSession) -> DataFrame:
    """Driven roads of every trajectory in the smallest test tables."""
    return routes(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_own_queries(),
        **({} if llm is None else {**llm.queries(), "pipeline": corpus_pipeline.run}),
    }


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pings_clean": pings_clean,
        "segments": segments,
        "segment_calendar": segment_calendar,
        "segment_tag": segment_tag,
        "quality_trajectories": quality,
        "top_trajectories": top,
        "roads": roads,
        "adjacency": adjacent,
        "neighbour_lists": lists,
        "road_features": features,
        "projected_points": projected,
        "projection_feet": feet,
        "distances": distances,
        "candidates": candidate_rows,
        "candidates_crowded": candidates_crowded,
        "candidate_roads": candidate_neighbours,
        "neighbor_paths": paths_of_candidates,
        "neighbor_paths_deep": paths_of_all_roads,
        "neighbor_paths_hubs": paths_across_hubs,
        "neighbor_paths_six_hops": paths_of_six_hops,
        "neighbor_paths_no_dead_ends": paths_dead_ends_dropped,
        "transition_pairs": pair_rows,
        "transitions": transition_rows,
        "transitions_polyline": transitions_polyline,
        "decoded": decoded,
        "decoded_polyline": decoded_polyline,
        "decoded_gaussian": decoded_gaussian,
        "decoded_long": decoded_long,
        "decoded_restart": decoded_restart,
        "routes": routes,
        "routes_restart": routes_restart,
        "load_ways": load_ways,
        "load_damaged_ways": load_damaged_ways,
        "load_nodes": load_nodes,
        "load_trajectories": load_trajectories,
        "sink_matches": sink_matches,
        "sink_segments": sink_segments,
        "sink_daily": sink_daily,
        "sink_csv": sink_csv,
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.all_statements(), **({} if llm is None else llm.oracle_sql())}
