"""Short paths against a recursive search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import paths as paths_module
from roadtrace.operators.paths import _dealt, neighbor_paths, path_facts
from roadtrace.operators.roads import adjacency, adjacency_parts
from roadtrace.params import MatchParams


def edges_frame(spark, lengths, links, touch=()):
    """``touch`` holds (road, neighbour) where the road touches the neighbour with its first end."""
    rows = []
    for a, b in [*links, *[(b, a) for a, b in links]]:
        rows.append((a, lengths[a], b, lengths[b], (a, b) in touch, (b, a) in touch))
    return spark.createDataFrame(
        rows,
        "road_id string, length double, neighbour_id string, neighbour_length double, at0 boolean, neighbour_at0 boolean",
    )


def starts_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "road_id string")


def search(lengths, links, theta, gamma, keep_dead_ends=True):
    """Cheapest (cost, roads, ids) per (start, end), by walking every simple path."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best = {}

    def offer(path):
        micro = sum(round(lengths[r] * 1e6) for r in path)
        key = (path[0], path[-1])
        best[key] = min(best.get(key, (micro, len(path), path)), (micro, len(path), path))

    def walk(path):
        hops = len(path) - 1
        onward = [n for n in sorted(near[path[-1]]) if n not in path]
        if hops != theta - 1 or keep_dead_ends or onward:
            offer(path)
        if hops < theta and (hops == theta - 1 or sum(lengths[r] for r in path) < gamma):
            for n in onward:
                walk(path + [n])

    for start in near:
        walk([start])
    return best


def found(spark, lengths, links, p):
    rows = neighbor_paths(edges_frame(spark, lengths, links), starts_frame(spark, lengths), p).collect()
    return {(r.start_id, r.end_id): (round(r.cost * 1e6), r.roads, [s.road for s in r.path]) for r in rows}


def test_chain(spark):
    lengths = {"A": 90.0, "B": 90.0, "C": 90.0, "D": 90.0}
    links = [("A", "B"), ("B", "C"), ("C", "D")]
    got = found(spark, lengths, links, MatchParams())
    # A, B sum to 180 < 200, so C is reached; A, B, C sum to 270, so D is not.
    assert got["A", "C"] == (270_000_000, 3, ["A", "B", "C"])
    assert ("A", "D") not in got
    assert got["A", "A"] == (90_000_000, 1, ["A"])


def test_long_road_only_reaches_itself(spark):
    lengths = {"A": 200.0, "B": 10.0}
    got = found(spark, lengths, [("A", "B")], MatchParams())
    assert {k for k in got if k[0] == "A"} == {("A", "A")}
    assert ("B", "A") in got


def test_last_hop_is_not_tested(spark):
    lengths = {"A": 10.0, "B": 500.0, "C": 10.0}
    links = [("A", "B"), ("B", "C")]
    assert ("A", "C") in found(spark, lengths, links, MatchParams(theta=2))
    assert ("A", "C") not in found(spark, lengths, links, MatchParams(theta=3))


@pytest.mark.parametrize("theta", [2, 3, 4, 5, 6, 7])
@pytest.mark.parametrize("keep", [True, False])
def test_same_as_the_search_on_random_networks(spark, theta, keep):
    rng = random.Random(theta * 10 + keep)
    lengths, links = {}, []
    # Forty separate small networks in one frame.
    for g in range(40):
        names = [f"{g}_{k}" for k in range(rng.randrange(4, 8 if theta < 6 else 10))]
        for n in names:
            lengths[n] = rng.choice([0.0, 5.0, 30.0, 30.0, 60.0, 90.0, 120.5, 180.0, 250.0])
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        links += rng.sample(pairs, min(len(pairs), rng.randrange(4, 11 if theta < 6 else 16)))
    used = {r for pair in links for r in pair}
    lengths = {k: v for k, v in lengths.items() if k in used}
    expected = search(lengths, links, theta, 200, keep)
    assert found(spark, lengths, links, MatchParams(theta=theta, keep_dead_ends=keep)) == expected


def test_only_asked_starts(spark):
    lengths = {"A": 10.0, "B": 10.0}
    got = neighbor_paths(edges_frame(spark, lengths, [("A", "B")]), starts_frame(spark, ["A"]))
    assert {r.start_id for r in got.collect()} == {"A"}


def test_facts_find_the_shared_ends(spark):
    lengths = {"A": 10.0, "B": 20.0, "C": 30.0}
    links = [("A", "B"), ("B", "C")]
    paths = neighbor_paths(edges_frame(spark, lengths, links, {("B", "C")}), starts_frame(spark, lengths))
    got = {(r.start_id, r.end_id): r for r in path_facts(paths).collect()}
    ac = got["A", "C"]
    assert (ac.roads, ac.whole, ac.inner, ac.first_length, ac.last_length) == (3, 60.0, 20.0, 10.0, 30.0)
    assert (ac.first_at0, ac.last_at0) == (False, False)
    assert (got["B", "C"].first_at0, got["B", "C"].last_at0) == (True, False)
    assert (got["B", "B"].roads, got["B", "B"].inner, got["B", "B"].first_at0) == (1, 0.0, None)
    assert len(got) == paths.count()


ROADS = "road_id string, length double, nodes array<string>, lat0 double, lon0 double, lat1 double, lon1 double"


def roads_frame(spark, nodes_of, lengths):
    """Roads whose ends lie at numbers made of their first and last node."""
    def place(node):
        return float(sum(node.encode()) * 31 + len(node)), float(node.encode()[-1])

    rows = [(r, lengths[r], ns, *place(ns[0]), *place(ns[-1])) for r, ns in nodes_of.items()]
    return spark.createDataFrame(rows, ROADS)


def as_rows(paths):
    return sorted(
        (r.start_id, r.end_id, round(r.cost * 1e6), [(s.road, s.length) for s in r.path], r.roads, r.first_at0, r.last_at0)
        for r in paths.collect()
    )


@pytest.mark.parametrize(
    "hub_roads, p",
    [(1, MatchParams()), (2, MatchParams()), (2, MatchParams(theta=5)), (1, MatchParams(theta=3, keep_dead_ends=False))],
)
def test_hubs_give_the_rows_of_the_pair_table(spark, hub_roads, p):
    rng = random.Random(hub_roads)
    nodes_of, lengths = {}, {}
    for g in range(15):
        nodes = [f"{g}n{k}" for k in range(5)]
        for k in range(rng.randrange(3, 8)):
            nodes_of[f"{g}r{k}"] = rng.choices(nodes, k=rng.randrange(2, 4))
            lengths[f"{g}r{k}"] = rng.choice([0.0, 5.0, 30.0, 30.0, 60.0, 90.0, 180.0, 250.0])
    roads = roads_frame(spark, nodes_of, lengths)
    pairs, hubs = adjacency_parts(roads, hub_roads)
    assert hubs.count() > 0
    assert as_rows(neighbor_paths(pairs, roads, p, hubs)) == as_rows(neighbor_paths(adjacency(roads), roads, p))


def test_a_node_of_many_roads(spark):
    """Two spokes start; every other spoke is one hop away, the far end of a spoke two."""
    n = 5000
    nodes_of = {f"r{k}": ["hub", f"n{k}"] for k in range(n)} | {"far": ["n7", "end"]}
    lengths = {r: 10.0 + int(r[1:]) / n for r in nodes_of if r != "far"} | {"far": 20.0}
    pairs, hubs = adjacency_parts(roads_frame(spark, nodes_of, lengths))
    assert (pairs.count(), hubs.count()) == (2, n)
    got = {(r.start_id, r.end_id): [s.road for s in r.path] for r in
           neighbor_paths(pairs, starts_frame(spark, ["r1", "far"]), MatchParams(), hubs).collect()}
    assert len(got) == 2 * (n + 1)
    assert got["r1", "far"] == ["r1", "r7", "far"]
    assert got["far", "r4999"] == ["far", "r7", "r4999"]
    assert got["r1", "r2"] == ["r1", "r2"]


def test_no_hubs_in_an_empty_network(spark):
    roads = spark.createDataFrame([], ROADS)
    pairs, hubs = adjacency_parts(roads)
    assert neighbor_paths(pairs, roads, MatchParams(), hubs).count() == 0


def small_networks(spark, seed):
    """Roads of fifteen separate networks, with their places, and the links between them."""
    rng = random.Random(seed)
    nodes_of, lengths = {}, {}
    for g in range(15):
        nodes = [f"{g}n{k}" for k in range(5)]
        for k in range(rng.randrange(3, 8)):
            nodes_of[f"{g}r{k}"] = rng.sample(nodes, rng.randrange(2, 4))
            lengths[f"{g}r{k}"] = rng.choice([0.0, 5.0, 30.0, 30.0, 60.0, 90.0, 180.0, 250.0])
    links = [(a, b) for a in nodes_of for b in nodes_of if a < b and set(nodes_of[a]) & set(nodes_of[b])]
    return roads_frame(spark, nodes_of, lengths), lengths, links


def shuffled_by(paths):
    """Columns by which the plan of ``paths`` shuffles anything."""
    plan = paths._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"(\w+)#", " ".join(re.findall(r"Exchange ([^\n]*)", plan))))


def check_whole_and_in_place(spark, p, with_hubs):
    roads, lengths, links = small_networks(spark, 5)
    pairs, hubs = adjacency_parts(roads, 2) if with_hubs else (adjacency(roads), None)
    paths = neighbor_paths(pairs, roads, p, hubs, part_starts=4)
    assert not {"start_id", "end_id", "ids"} & shuffled_by(paths)
    got = {(r.start_id, r.end_id): (round(r.cost * 1e6), r.roads, [s.road for s in r.path]) for r in paths.collect()}
    assert got == search(lengths, links, p.theta, 200, p.keep_dead_ends)


def test_paths_across_hubs_are_not_shuffled(spark):
    check_whole_and_in_place(spark, MatchParams(), True)


def test_paths_without_dead_ends_are_not_shuffled(spark):
    check_whole_and_in_place(spark, MatchParams(keep_dead_ends=False), False)


def test_dead_ends_are_dropped_without_sorting_paths(spark):
    """Whether a path leads on is seen from the roads at its end, not from the longer paths."""
    roads, _, _ = small_networks(spark, 5)
    paths = neighbor_paths(adjacency(roads), roads, MatchParams(keep_dead_ends=False), part_starts=4)
    assert "Window" not in paths._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("with_spur", [False, True])
def test_a_hub_whose_roads_a_path_holds_leads_nowhere(spark, with_spur):
    """A path holds all roads of the hub ``n``; it only goes on if a fourth road ends there."""
    nodes_of = {"a": ["n", "x"], "b": ["x", "y"], "c": ["y", "n"]} | ({"d": ["n", "z"]} if with_spur else {})
    lengths = {r: 10.0 + k for k, r in enumerate(nodes_of)}
    links = [(a, b) for a in nodes_of for b in nodes_of if a < b and set(nodes_of[a]) & set(nodes_of[b])]
    pairs, hubs = adjacency_parts(roads_frame(spark, nodes_of, lengths), 1)
    p = MatchParams(theta=3, keep_dead_ends=False)
    rows = neighbor_paths(pairs, starts_frame(spark, lengths), p, hubs).collect()
    got = {(r.start_id, r.end_id): (round(r.cost * 1e6), r.roads, [s.road for s in r.path]) for r in rows}
    assert got == search(lengths, links, 3, 200, False)


def test_paths_of_all_roads_are_not_shuffled(spark):
    check_whole_and_in_place(spark, MatchParams(), False)


def test_starts_are_dealt_into_bounded_parts_of_neighbours(spark):
    """A dense row of roads at one place and a row as long, a hundred kilometres away."""
    rows = [(f"r{k}", 45.0 + (k % 2), 9.0 + 1e-5 * k) for k in range(4000)] + [("gone", 45.0, 9.0), ("r7", 46.0, 9.0)]
    starts = spark.createDataFrame(rows, "road_id string, lat0 double, lon0 double")
    lengths = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("road_id"), F.lit(1.0).alias("length"))
    dealt, n_parts = _dealt(lengths, starts, 100)
    got = dealt.collect()
    assert n_parts == 41 and sorted(r.road_id for r in got) == sorted(f"r{k}" for k in range(4000))
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append(int(r.road_id[1:]))
    assert max(map(len, parts.values())) <= 200
    # At most one part holds the end of one row and the beginning of the other.
    assert sum(len({k % 2 for k in ks}) > 1 for ks in parts.values()) <= 1


def test_parts_stay_compact_outside_the_usual_degrees(spark):
    """A square of 64 by 64 roads far above 270 degrees of latitude, dealt into 64 parts."""
    rows = [(f"r{k * 1009 % 4096}", 420.0 + 0.0005 * (k // 64), 9.0 + 0.0005 * (k % 64)) for k in range(4096)]
    starts = spark.createDataFrame(rows, "road_id string, lat0 double, lon0 double")
    dealt, _ = _dealt(starts.select("road_id", F.lit(1.0).alias("length")), starts, 64)
    height = (F.max("lat0") - F.min("lat0")).alias("high")
    got = dealt.join(starts, "road_id").groupBy("part").agg(height, F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 4096
    # Half of the parts at least are less high than half the square; the curve's largest leaps lie in few of them.
    assert sorted(r.high for r in got)[len(got) // 2] < 0.0005 * 32


def test_dealing_sorts_as_few_ranges_for_many_parts(spark, monkeypatch):
    """The driver gets samples of each range, so there are no more ranges for more starts; parts are equal all the same."""
    rows = [(f"r{k}", 45.0 + k % 7, 9.0 + 1e-5 * k) for k in range(2000)]
    starts = spark.createDataFrame(rows, "road_id string, lat0 double, lon0 double")
    lengths = starts.select("road_id", F.lit(1.0).alias("length"))
    parts = []
    for ranges in (4, 3, 1):
        monkeypatch.setattr(paths_module, "RANGES", ranges, raising=False)
        dealt, n_parts = _dealt(lengths, starts, 40)
        assert n_parts == 50 and dealt.rdd.getNumPartitions() == ranges
        parts.append({r.road_id: r.part for r in dealt.collect()})
    assert parts[0] == parts[1] == parts[2]
    assert [list(parts[0].values()).count(part) for part in range(50)] == [40] * 50
