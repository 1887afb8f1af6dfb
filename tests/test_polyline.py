"""Roads measured along their pieces: feet, meeting places and routes of hand-made curved roads."""

import math

import pytest

from roadtrace.operators.candidates import candidate_points, candidates, road_cells
from roadtrace.operators.paths import measured_facts, neighbor_paths
from roadtrace.operators.roads import adjacency, build_roads
from roadtrace.operators.transitions import linked_points, transitions
from roadtrace.params import MatchParams

P = MatchParams(full_length=True, tau=30, gamma=5000.0)
STEP = 0.001
WAY = "id string, timestamp string, version int, changesetid bigint, tags map<string,string>, nodes array<string>"
# Nodes by column and row of a grid.
GRID = {f"{x}{y}": (45.0 + STEP * y, 9.0 + STEP * x) for x in range(4) for y in range(4)}
WAYS = {
    # Three sides of a square: its ends lie side by side.
    "u": ["01", "00", "10", "11"],
    # Meets "u" at an inner node.
    "side": ["00", "10", "20", "30"],
    "end": ["30", "31", "32"],
    # Closed.
    "loop": ["32", "33", "23", "22", "32"],
    # Shares with "loop" a node that the node table lacks, and none else.
    "lost1": ["03", "02", "x"],
    "lost2": ["x", "13", "12"],
}


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def roads(spark):
    ways = [(name, "2018-01-01T00:00:00Z", 1, 0, {"highway": "primary"}, nodes) for name, nodes in WAYS.items()]
    nodes = spark.createDataFrame([(k, *v) for k, v in GRID.items()], "id string, latitude double, longitude double")
    return build_roads(spark.createDataFrame(ways, WAY), nodes, full_length=True).cache()


@pytest.fixture(scope="module")
def paths(roads):
    return neighbor_paths(adjacency(roads), roads, P).cache()


def along(name):
    """Metres of each node of a way from its first node."""
    marks = [0.0]
    known = [n for n in WAYS[name] if n in GRID]
    for a, b in zip(known, known[1:]):
        marks.append(marks[-1] + metres(GRID[a], GRID[b]))
    return marks


def test_marks_and_length(roads):
    for r in roads.collect():
        assert [m.at for m in r.marks] == pytest.approx(along(r.road_id))
        assert [m.node_id for m in r.marks] == [n for n in WAYS[r.road_id] if n in GRID]
        assert r.length == pytest.approx(along(r.road_id)[-1])


def test_roads_meet_where_they_share_a_node(roads, paths):
    facts = {(r.start_id, r.end_id): r for r in measured_facts(paths, roads).collect()}
    assert facts.keys() == {(r.start_id, r.end_id) for r in paths.collect()}
    own = facts["u", "u"]
    assert (own.roads, own.inner, own.exit_at, own.enter_at) == (1, None, None, None)
    # "u" and "side" share 00 and 10: the smaller id.
    near = facts["u", "side"]
    assert (near.exit_at, near.inner, near.enter_at) == (pytest.approx(along("u")[1]), 0.0, 0.0)
    # All of "side" and "end" is driven, and the loop is entered where it begins.
    far = facts["u", "loop"]
    assert far.roads == 4
    assert (far.inner, far.enter_at) == (pytest.approx(along("side")[-1] + along("end")[-1]), 0.0)
    back = facts["end", "u"]
    assert (back.exit_at, back.enter_at) == (0.0, pytest.approx(along("u")[1]))
    assert back.inner == pytest.approx(along("side")[-1])
    lost = facts["lost1", "lost2"]
    assert (lost.exit_at, lost.enter_at) == (pytest.approx(along("lost1")[-1]), 0.0)


def _place(x, y):
    return 45.0 + STEP * y, 9.0 + STEP * x


def _routes(spark, roads, paths, places):
    rows = [("u", 0, n, *_place(*xy)) for n, xy in enumerate(places)]
    points = spark.createDataFrame(rows, "customid string, trajid int, timest int, latitude double, longitude double")
    found = candidate_points(candidates(points, road_cells(roads, P), P), P)
    moves = transitions(linked_points(found), measured_facts(paths, roads), P).where("k IS NOT NULL")
    return {(r.timest, r.prev_id, r.road_id): r.route for r in moves.collect()}, found


def test_route_goes_around_the_bend(spark, roads, paths):
    """From the middle of one arm to the middle of the other: half an arm, the base and half an arm."""
    got, found = _routes(spark, roads, paths, [(0, 0.5), (1, 0.5)])
    around = metres(_place(0, 0.5), _place(0, 0)) + metres(_place(0, 0), _place(1, 0)) + metres(_place(1, 0), _place(1, 0.5))
    assert got[1, "u", "u"] == pytest.approx(around, abs=0.01)
    foot = found.where("timest = 0").first().cands[0]
    assert (foot.foot_lat, foot.foot_lon) == pytest.approx(_place(0, 0.5), abs=1e-9)
    assert foot.to0 + foot.to1 == pytest.approx(along("u")[-1])


def test_route_over_other_roads(spark, roads, paths):
    """Down the arm to 00, along "side" and up "end"; points beside the roads are moved onto them."""
    got, _ = _routes(spark, roads, paths, [(-0.0001, 0.5), (3.0001, 1.5)])
    expected = metres(_place(0, 0.5), _place(0, 0)) + along("side")[-1] + metres(_place(3, 0), _place(3, 1)) * 1.5
    assert got[1, "u", "end"] == pytest.approx(expected, abs=0.05)


def test_beyond_the_end_the_foot_is_the_end(spark, roads, paths):
    """Other than on the chord, every candidate has a foot."""
    _, found = _routes(spark, roads, paths, [(0, 1.1)])
    foot = found.first().cands[0]
    assert foot.road_id == "u" and foot.to0 == 0.0
    assert (foot.foot_lat, foot.foot_lon) == pytest.approx(_place(0, 1), abs=1e-9)
