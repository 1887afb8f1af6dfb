"""The whole way from tables to routes, on a small town."""

import pytest

from roadtrace.jobs import run_match, run_segment
from roadtrace.operators.roads import adjacency, build_roads
from roadtrace.operators.segment import segment
from roadtrace.params import MatchParams, SegmentParams
from roadtrace.plans.match import match
from roadtrace.sources.readers import NODE_SCHEMA, WAY_SCHEMA

SIDE = 12
T0 = 1504300000


@pytest.fixture(scope="module")
def town(spark):
    """A square grid of streets, one way per block side, about 78 m each."""
    nodes = [
        (f"N{i}_{j}", 0, "2018", False, 1, 0, {}, 45.45 + 0.0007 * j, 9.15 + 0.001 * i)
        for i in range(SIDE)
        for j in range(SIDE)
    ]
    ways = []
    for i in range(SIDE):
        for j in range(SIDE):
            for name, di, dj in (("E", 1, 0), ("N", 0, 1)):
                if i + di < SIDE and j + dj < SIDE:
                    ways.append(
                        (f"{name}{i}_{j}", 0, "2018", False, 1, 0, {"highway": "residential"},
                         [f"N{i}_{j}", f"N{i + di}_{j + dj}"])
                    )
    return spark.createDataFrame(ways, WAY_SCHEMA), spark.createDataFrame(nodes, NODE_SCHEMA)


@pytest.fixture(scope="module")
def pings(spark):
    """One car along the fourth street eastwards, then north; 8 m beside the road; a point every 4 seconds."""
    rows = []
    for k in range(70):
        along = 0.0004 * k
        if along <= 0.008:
            lat, lon = 45.45 + 0.0007 * 3 + 0.00007, 9.1503 + along
        else:
            lat, lon = 45.45 + 0.0007 * 3 + 0.7 * (along - 0.008), 9.158 + 0.0001
        if lat < 45.457:
            rows.append(("car", T0 + 4 * k, lat, lon, 5))
    return spark.createDataFrame(
        rows, "customid string, timestamp int, latitude double, longitude double, accuracy int"
    )


@pytest.fixture(scope="module")
def trajectories(pings):
    return segment(pings, SegmentParams(min_pings=10))


def rows(df):
    return sorted((r.customid, r.trajid, r.timest, r.seq, r.roadID) for r in df.collect())


def test_routes_follow_the_car(spark, town, trajectories):
    got = rows(match(trajectories, *town))
    driven = [r[4] for r in got]
    assert {"E3_3", "E4_3", "E5_3", "E6_3"} <= set(driven)
    assert {"N8_4", "N8_5", "N8_6"} <= set(driven)
    near = {(r.road_id, r.neighbour_id) for r in adjacency(build_roads(*town)).collect()}
    for a, b in zip(driven, driven[1:]):
        assert a == b or (a, b) in near


def test_same_without_any_broadcast(spark, town, trajectories):
    usual = rows(match(trajectories, *town))
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        assert rows(match(trajectories, *town)) == usual
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


@pytest.mark.parametrize("block", [10, 60])
def test_block_length_does_not_matter(town, trajectories, block):
    assert rows(match(trajectories, *town, MatchParams(block_seconds=block))) == rows(match(trajectories, *town))


def test_top_k_keeps_a_centre_trajectory(town, trajectories):
    assert rows(match(trajectories, *town, MatchParams(top_k=1))) == rows(match(trajectories, *town))


def test_swapped_frame_and_polyline_length_run(town, trajectories):
    p = MatchParams(frame="swapped", full_length=True, keep_dead_ends=False)
    assert len(rows(match(trajectories, *town, p))) > 10


def test_arguments():
    args = ["alpha=3", "beta=12", "tau=80", "theta=3", "gamma=150"]
    assert MatchParams.from_args(args) == MatchParams(3, 12, 80, 3, 150.0)
    assert MatchParams.from_args([*args, "yes"]).top_k == 50
    with pytest.raises(ValueError):
        MatchParams.from_args(args[:4])
    for bad in ({"theta": 1}, {"alpha": 0}, {"emission": "none"}, {"block_seconds": 0}, {"block_seconds": 10**7, "beta": 1}):
        with pytest.raises(ValueError):
            MatchParams(**bad)


def test_jobs_on_tables(spark, town, trajectories, pings):
    ways, nodes = town
    ways.createOrReplaceTempView("osmwaysmilan")
    nodes.createOrReplaceTempView("osmnodesmilan")
    trajectories.createOrReplaceTempView("trajectories")
    run_match(spark, ["alpha=4", "beta=10", "tau=100", "theta=4", "gamma=200"])
    assert rows(spark.table("MapMatchedTrajectories")) == rows(match(trajectories, *town))
    pings.createOrReplaceTempView("raw_pings")
    run_segment(spark, ["raw_pings", "segmented"])
    assert len(spark.table("segmented").columns) == 15
