import math
import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators.candidates import (
    candidate_points,
    candidate_roads,
    candidates,
    crowded_cells,
    dealt,
    near_roads,
    placed_points,
    road_cells,
)
from roadtrace.params import MatchParams

R = 6378137.0


def lonlat(x, y):
    return math.degrees(x / R), math.degrees(2 * math.atan(math.exp(y / R)) - math.pi / 2)


def roads(spark, lines):
    """Roads from projected coordinates."""
    rows = []
    for name, points in lines.items():
        c = [lonlat(x, y) for x, y in points]
        rows.append((name, c, c[0][1], c[0][0], c[-1][1], c[-1][0]))
    return spark.createDataFrame(
        rows,
        "road_id string, coordinates array<struct<lon:double,lat:double>>, lat0 double, lon0 double, lat1 double, "
        "lon1 double",
    )


def points(spark, places):
    rows = []
    for n, (x, y) in enumerate(places):
        lon, lat = lonlat(x, y)
        rows.append(("u", 0, n, lat, lon))
    return spark.createDataFrame(rows, "customid string, trajid int, timest int, latitude double, longitude double")


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    sq = dx * dx + dy * dy
    u = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / sq)) if sq else 0
    return math.hypot(p[0] - a[0] - u * dx, p[1] - a[1] - u * dy)


def find(spark, lines, places, p):
    return candidates(points(spark, places), road_cells(roads(spark, lines), p), p)


LINES = {"at2": [(2, -50), (2, 50)], "at10": [(-10, -50), (-10, 50)], "at20": [(20, -50), (20, 50)]}


def test_emission_with_distance_floor(spark):
    got = {r.road_id: r.prob for r in find(spark, LINES, [(0, 0)], MatchParams()).collect()}
    total = 1 / 5 + 1 / 10 + 1 / 20
    assert got == pytest.approx({"at2": 1 / 5 / total, "at10": 1 / 10 / total, "at20": 1 / 20 / total}, abs=1e-6)


def test_alpha_cut_does_not_rescale(spark):
    got = find(spark, LINES, [(0, 0)], MatchParams(alpha=1)).collect()
    assert [r.road_id for r in got] == ["at2"] and got[0].prob == pytest.approx(4 / 7, abs=1e-6)


def test_gaussian_emission(spark):
    got = {r.road_id: r.prob for r in find(spark, LINES, [(0, 0)], MatchParams(emission="gaussian")).collect()}
    assert got["at10"] == pytest.approx(math.exp(-0.5) / (math.sqrt(2 * math.pi) * 10), rel=1e-6)


def test_ties_go_to_the_smaller_id(spark):
    lines = {"b": [(1, -5), (1, 5)], "a": [(-2, -5), (-2, 5)], "c": [(0, -5), (0, 5)]}
    got = find(spark, lines, [(0, 0)], MatchParams(alpha=2)).collect()
    assert sorted(r.road_id for r in got) == ["a", "b"]


def test_points_without_roads_vanish(spark):
    assert find(spark, LINES, [(5000, 0)], MatchParams()).count() == 0


@pytest.mark.parametrize("tau", [30, 100])
def test_same_as_all_pairs(spark, tau):
    rng = random.Random(tau)
    lines = {}
    for n in range(60):
        x, y = rng.uniform(-1500, 1500), rng.uniform(-1500, 1500)
        reach = rng.choice([10, 80, 400, 3000])
        lines[f"r{n:02}"] = [
            (x, y)] + [(x + rng.uniform(-reach, reach), y + rng.uniform(-reach, reach)) for _ in range(rng.choice([1, 1, 3]))
        ]
    lines["dot"] = [(7, 7), (7, 7)]
    places = [(rng.uniform(-1500, 1500), rng.uniform(-1500, 1500)) for _ in range(300)] + [(0, 0), (7, 7)]
    p = MatchParams(tau=tau)
    got = {
        (r.timest, r.road_id): r.distance
        for r in near_roads(points(spark, places), road_cells(roads(spark, lines), p), p).collect()
    }
    expected = {}
    for n, place in enumerate(places):
        for name, line in lines.items():
            d = min(distance(place, a, b) for a, b in zip(line, line[1:]))
            if d <= tau:
                expected[n, name] = max(d, 5)
    assert len(expected) > 30
    assert got.keys() == expected.keys()
    assert got == pytest.approx(expected, abs=1e-4)


def test_far_road_keeps_a_finite_emission(spark):
    """The density itself is 0 at 450 units; its logarithm still tells near from far."""
    rows = find(spark, {"near": LINES["at2"], "far": [(450, -50), (450, 50)]}, [(0, 0)], MatchParams(tau=500, emission="gaussian")).collect()
    got = {r.road_id: r for r in rows}
    assert got["far"].prob == 0.0 and got["far"].log_prob == pytest.approx(-0.5 * 45**2 - math.log(10 * math.sqrt(2 * math.pi)), rel=1e-3)
    assert got["near"].log_prob > got["far"].log_prob


def test_shuffled_and_broadcast_cells_agree(spark):
    p = MatchParams()
    cells = road_cells(roads(spark, LINES), p)
    pts = points(spark, [(0, 0), (30, 10), (-15, -40)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = sorted(map(tuple, candidates(pts, cells, p).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == sorted(map(tuple, candidates(pts, F.broadcast(cells), p).collect()))


def test_crowded_cell_is_dealt_into_small_parts(spark):
    """One place holds a third of all points, one cell a third of all edges: no part of it is large, no pair is lost."""
    rng = random.Random(5)
    p, even = MatchParams(part_points=50, part_edges=20), MatchParams()
    lines = {f"c{n:03}": [(rng.uniform(0, 190), rng.uniform(0, 190)) for _ in range(2)] for n in range(200)}
    for n in range(400):
        x, y = rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)
        lines[f"r{n:03}"] = [(x, y), (x + rng.uniform(-60, 60), y + rng.uniform(-60, 60))]
    places = [(90.0, 90.0)] * 1000 + [(rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for _ in range(2000)]
    pts, cells = points(spark, places), road_cells(roads(spark, lines), p)
    placed = placed_points(pts, p)
    crowded = crowded_cells(placed, cells, p).cache()
    own, near = dealt(placed, cells, crowded)
    key = ["cx", "cy", "pp", "ep"]
    largest = [df.groupBy(*key).count().agg(F.max("count")).first()[0] for df in (own, near)]
    assert largest[0] <= 2 * p.part_points and largest[1] <= 2 * p.part_edges
    # Every pair of a cell meets exactly once.
    met = own.join(near, key).select("timest", "road_id", "x1", "y1")
    assert met.exceptAll(met.distinct()).count() == 0 and met.count() == placed.join(cells, ["cx", "cy"]).count()
    got = [sorted(map(tuple, near_roads(pts, cells, q).collect())) for q in (p, even)]
    assert len(got[0]) > 100_000 and got[0] == got[1]


def test_empty_tables(spark):
    none = points(spark, [(0, 0)]).limit(0)
    assert near_roads(none, road_cells(roads(spark, LINES))).count() == 0
    assert near_roads(points(spark, [(0, 0)]), road_cells(roads(spark, LINES).limit(0))).count() == 0


def test_candidate_points_carry_feet_in_rank_order(spark):
    got = candidate_points(find(spark, LINES, [(0, 10), (0, 70)], MatchParams(tau=90)), MatchParams())
    rows = {r.timest: r.cands for r in got.collect()}
    assert [c.road_id for c in rows[0]] == ["at2", "at10", "at20"]
    assert all(c.foot_lat is not None and c.to0 > c.to1 and not c.near0 for c in rows[0])
    assert all(c.foot_lat is None and c.to0 is None for c in rows[1])
    assert {r.road_id for r in candidate_roads(got).collect()} == set(LINES)
