"""Road network from ways and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.geo import haversine_m
from roadtrace.params import ROAD_CLASSES


def road_ways(ways: DataFrame) -> DataFrame:
    """Ways whose latest version is of a drivable class; that version of each."""
    record = F.struct("timestamp", "version", "changesetid", "tags", "nodes")
    newest = F.struct("version", "timestamp", "changesetid")
    return (
        ways.groupBy(F.col("id").alias("road_id"))
        .agg(F.max_by(record, newest).alias("w"))
        .where(F.col("w.tags")["highway"].isin(*ROAD_CLASSES))
        .select("road_id", "w.*")
    )


def build_roads(ways: DataFrame, nodes: DataFrame, full_length: bool = False) -> DataFrame:
    """One row per road: attributes, ordered coordinates, length in metres and both ends.

    References to absent nodes vanish; a road needs two nodes that are present.  The length is measured from
    the first to the last node (a loop has length 0), or along all pieces with ``full_length``.  Then there also is
    ``marks``: each node (``node_id``) with its metres along the road (``at``), in the order of the coordinates.
    """
    selected = road_ways(ways)
    refs = selected.select("road_id", F.posexplode("nodes").alias("pos", "node_id"))
    placed = refs.join(
        nodes.select(F.col("id").alias("node_id"), "latitude", "longitude"), "node_id"
    )
    lines = placed.groupBy("road_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "node_id"))
        ).alias("placed")
    )
    shaped = lines.where(F.size("placed") >= 2).select(
        "road_id",
        F.transform("placed", lambda n: F.struct(n["lon"].alias("lon"), n["lat"].alias("lat"))).alias("coordinates"),
        *([_marks("placed").alias("marks")] if full_length else []),
    )
    first, last = F.col("coordinates")[0], F.element_at("coordinates", -1)
    ended = shaped.select(
        "*",
        first["lat"].alias("lat0"),
        first["lon"].alias("lon0"),
        last["lat"].alias("lat1"),
        last["lon"].alias("lon1"),
    )
    c = F.col
    chord = haversine_m(c("lat0"), c("lon0"), c("lat1"), c("lon1"))
    length = F.element_at("marks", -1)["at"] if full_length else chord
    return ended.withColumn("length", length).join(selected, "road_id").select(
        "road_id",
        "timestamp",
        "version",
        "changesetid",
        "coordinates",
        "tags",
        "length",
        "nodes",
        "lat0",
        "lon0",
        "lat1",
        "lon1",
        *(["marks"] if full_length else []),
    )


def _marks(placed: str) -> Column:
    """Nodes of a line with the metres from its first node, along the line."""

    def longer(marks: Column, n: Column) -> Column:
        last = F.element_at(marks, -1)
        step = haversine_m(last["lat"], last["lon"], n["lat"], n["lon"])
        return F.concat(marks, F.array(mark(n, last["at"] + step)))

    def mark(n: Column, at: Column) -> Column:
        return F.struct(n["node_id"].alias("node_id"), at.alias("at"), n["lat"].alias("lat"), n["lon"].alias("lon"))

    rest = F.slice(placed, F.lit(2), F.size(placed))
    marks = F.aggregate(rest, F.array(mark(F.col(placed)[0], F.lit(0.0))), longer)
    return F.transform(marks, lambda m: F.struct(m["node_id"].alias("node_id"), m["at"].alias("at")))


# Roads of one node beyond which pairs are not formed for the search of paths; see ``adjacency_parts``.
HUB_ROADS = 64


def _stops(roads: DataFrame) -> DataFrame:
    """Nodes of each road, once each, with the road's length and ends ``e0``, ``e1``."""
    ends = [F.struct("lat0", "lon0").alias("e0"), F.struct("lat1", "lon1").alias("e1")]
    return roads.select("road_id", "length", *ends, F.explode("nodes").alias("node_id")).dropDuplicates(
        ["road_id", "node_id"]
    )


def touches(own_end: Column, e0: Column, e1: Column) -> Column:
    """Whether an end of a road is also an end of another road, as coordinates."""
    return (own_end == e0) | (own_end == e1)


def _pairs_at_nodes(stops: DataFrame) -> DataFrame:
    c = F.col
    near = stops.select(
        "node_id",
        c("road_id").alias("neighbour_id"),
        c("length").alias("neighbour_length"),
        c("e0").alias("n0"),
        c("e1").alias("n1"),
    )
    return (
        stops.join(near, "node_id")
        .where(c("road_id") != c("neighbour_id"))
        .select(
            "road_id",
            "length",
            "neighbour_id",
            "neighbour_length",
            touches(c("e0"), c("n0"), c("n1")).alias("at0"),
            touches(c("n0"), c("e0"), c("e1")).alias("neighbour_at0"),
        )
        .dropDuplicates(["road_id", "neighbour_id"])
    )


def adjacency(roads: DataFrame) -> DataFrame:
    """Pairs of different roads that share a node, with both lengths: one row per ordered pair.

    ``at0`` (``neighbour_at0``) tells whether the road (the neighbour) touches the other one with its first end; ends
    are compared as coordinates.  Direction of travel is not looked at.  Repeated nodes of a road are merged before
    the join.
    """
    return _pairs_at_nodes(_stops(roads))


def adjacency_parts(roads: DataFrame, hub_roads: int = HUB_ROADS) -> tuple[DataFrame, DataFrame]:
    """The same network without the n² pairs of crowded nodes: pairs, and stops of roads at hubs.

    A node with more than ``hub_roads`` roads is a hub; its roads are listed (road_id, node_id, length, e0, e1) and
    not paired.  The other nodes are paired as in ``adjacency``, at most ``hub_roads`` rows a stop.  Together both hold
    each adjacency at least once; two roads may meet at a hub and at another node.  Counts are merged before the shuffle.
    """
    stops = _stops(roads)
    crowded = stops.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_roads)
    pairs = _pairs_at_nodes(stops.join(crowded, "node_id", "left_anti"))
    return pairs, stops.join(crowded, "node_id", "left_semi")


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    """Per road: its neighbours and their lengths, ordered by id."""
    return pairs.groupBy("road_id", "length").agg(
        F.array_sort(F.collect_list(F.struct("neighbour_id", "neighbour_length"))).alias("neighbours")
    )


def connected_roads(roads: DataFrame) -> DataFrame:
    """Roads that share a node with another road; the others are never candidates.

    A node is shared if it has two different roads: smallest and largest id differ.  No pairs are formed.
    """
    stops = roads.select("road_id", F.explode("nodes").alias("node_id"))
    shared = (
        stops.groupBy("node_id")
        .agg(F.min("road_id").alias("low"), F.max("road_id").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("node_id")
    )
    linked = stops.join(shared, "node_id", "left_semi").select("road_id").distinct()
    return roads.join(linked, "road_id", "left_semi")


def road_features(roads: DataFrame) -> DataFrame:
    """Each road with neighbours as a GeoJSON line feature; missing names become ``noName``."""
    tag = F.col("tags")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("road_id").alias("id"),
        F.struct(
            "timestamp",
            "version",
            F.col("changesetid").alias("changeset"),
            F.col("length").alias("lenght"),
            tag["highway"].alias("highway"),
            tag["loc_ref"].alias("loc_ref"),
            tag["name"].alias("name"),
            tag["oneway"].alias("oneway"),
            tag["surface"].alias("surface"),
        ).alias("properties"),
        F.struct(
            F.lit("LineString").alias("type"),
            F.transform("coordinates", lambda n: F.array(n["lon"], n["lat"])).alias("coordinates"),
        ).alias("geometry"),
    )
    return connected_roads(roads).select(
        F.col("road_id").alias("roadID"),
        F.coalesce(tag["name"], F.lit("noName")).alias("roadName"),
        F.col("length").alias("lenght"),
        F.to_json(feature).alias("json"),
    )
