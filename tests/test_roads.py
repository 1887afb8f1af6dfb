import json

import pytest

from roadtrace.functions.geo import parse_line
from roadtrace.operators.roads import (
    adjacency,
    build_roads,
    connected_roads,
    neighbour_lists,
    road_features,
    road_ways,
)
from roadtrace.sources.readers import NODE_SCHEMA, WAY_SCHEMA


def ways(spark, rows):
    full = [
        (i, 0, rest[0] if rest else "2018", False, rest[1] if len(rest) > 1 else 1, 0, tags, nodes)
        for i, tags, nodes, *rest in rows
    ]
    return spark.createDataFrame(full, WAY_SCHEMA)


def nodes(spark, places):
    rows = [(i, 0, "2018", False, 1, 0, {}, lat, lon) for i, (lat, lon) in places.items()]
    return spark.createDataFrame(rows, NODE_SCHEMA)


PLACES = {f"N{k}": (45.44 + 0.001 * k, 9.14) for k in range(8)}
ROAD = {"highway": "residential"}


def test_road_classes(spark):
    classes = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential"]
    others = ["service", "living_street", "secondary_link", None]
    rows = [(str(c), {"highway": c} if c else {}, ["N0", "N1"]) for c in classes + others]
    assert {r.road_id for r in road_ways(ways(spark, rows)).collect()} == set(classes)


def test_class_of_the_latest_version_counts(spark):
    rows = [
        ("a", ROAD, ["N0", "N1"], "2018", 1), ("a", {"highway": "service"}, ["N0", "N1"], "2018", 2),
        ("b", {"highway": "service"}, ["N0", "N1"], "2018", 1), ("b", ROAD, ["N0", "N1"], "2018", 2),
    ]
    assert [(r.road_id, r.version) for r in road_ways(ways(spark, rows)).collect()] == [("b", 2)]


def test_latest_version_of_a_way(spark):
    rows = [("A", ROAD, ["N0", "N1"], "2017", 1), ("A", ROAD, ["N0", "N1", "N2"], "2018", 2)]
    got = build_roads(ways(spark, rows), nodes(spark, PLACES)).collect()
    assert len(got) == 1 and got[0].version == 2 and len(got[0].coordinates) == 3


def test_order_length_and_missing_nodes(spark):
    rows = [
        ("A", ROAD, ["N3", "NX", "N1", "N2"]),
        ("loop", ROAD, ["N0", "N1", "N0"]),
        ("one", ROAD, ["N0", "NX"]),
    ]
    got = {r.road_id: r for r in build_roads(ways(spark, rows), nodes(spark, PLACES)).collect()}
    assert set(got) == {"A", "loop"}
    assert [round(c.lat, 3) for c in got["A"].coordinates] == [45.443, 45.441, 45.442]
    assert got["A"].length == pytest.approx(111.195, abs=0.001)
    assert got["loop"].length == 0
    full = {r.road_id: r for r in build_roads(ways(spark, rows), nodes(spark, PLACES), True).collect()}
    assert full["A"].length == pytest.approx(3 * 111.195, abs=0.001)
    assert full["loop"].length == pytest.approx(2 * 111.195, abs=0.001)


def test_adjacency_by_any_shared_node_once_per_pair(spark):
    rows = [
        ("A", ROAD, ["N0", "N1", "N2"]),
        ("B", ROAD, ["N3", "N1", "N2"]),
        ("C", ROAD, ["N3", "N4"]),
        ("alone", ROAD, ["N6", "N7"]),
    ]
    roads = build_roads(ways(spark, rows), nodes(spark, PLACES))
    pairs = adjacency(roads)
    assert sorted((r.road_id, r.neighbour_id) for r in pairs.collect()) == [
        ("A", "B"),
        ("B", "A"),
        ("B", "C"),
        ("C", "B"),
    ]
    touching = {(r.road_id, r.neighbour_id): (r.at0, r.neighbour_at0) for r in pairs.collect()}
    assert touching["A", "B"] == (False, False) and touching["B", "C"] == (True, True)
    lists = {r.road_id: [n.neighbour_id for n in r.neighbours] for r in neighbour_lists(pairs).collect()}
    assert lists == {"A": ["B"], "B": ["A", "C"], "C": ["B"]}
    assert {r.road_id for r in connected_roads(roads).collect()} == {"A", "B", "C"}


def test_feature_text(spark):
    rows = [
        ("A", {"highway": "primary", "name": "Via Roma", "oneway": "yes", "surface": "asphalt"}, ["N0", "N1"]),
        ("B", {"highway": "trunk"}, ["N1", "N2"]),
    ]
    df = road_features(build_roads(ways(spark, rows), nodes(spark, PLACES)))
    got = {r.roadID: r for r in df.collect()}
    assert (got["A"].roadName, got["B"].roadName) == ("Via Roma", "noName")
    feature = json.loads(got["A"].json)
    assert feature["type"] == "Feature" and feature["id"] == "A"
    assert feature["geometry"]["type"] == "LineString"
    assert feature["geometry"]["coordinates"][0] == [9.14, 45.44]
    assert feature["properties"]["surface"] == "asphalt" and feature["properties"]["changeset"] == 0
    line = {r.id: r for r in df.select(parse_line(df.json).alias("f")).select("f.*").collect()}
    assert line["A"].geometry.coordinates == feature["geometry"]["coordinates"]
