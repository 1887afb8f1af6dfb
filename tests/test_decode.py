"""Decoding against brute force, for several block lengths."""

import itertools
import math
import random

import pytest

from roadtrace.operators.chains import PLACES, combined, passed
from roadtrace.operators.decode import decode
from roadtrace.operators.route import routes
from roadtrace.operators.transitions import LOG_SCALE
from roadtrace.params import MatchParams

SCHEMA = (
    "customid string, trajid int, tblock bigint, timest int, latitude double, longitude double, is_last boolean, "
    "prev_timest int, i int, road_id string, log_prob double, k int, prev_id string, prev_log_prob double, log_move double"
)


def trellis(rng, n, broken):
    """Points as lists of (road, prob), and moves[t][k][i] = log probability or None."""
    cands = [
        [(f"r{rng.randrange(6)}_{c}", rng.choice([0.1, 0.25, 0.25, 0.5])) for c in range(rng.randrange(1, 5))]
        for _ in range(n)
    ]
    moves = [None]
    for t in range(1, n):
        grid = [
            [None if rng.random() < 0.3 else rng.choice([-1.0, -2.0, -2.0, -2.5]) for _ in cands[t]]
            for _ in cands[t - 1]
        ]
        if t in broken:
            grid = [[None] * len(cands[t]) for _ in cands[t - 1]]
        moves.append(grid)
    return cands, moves


def rows_of(name, times, cands, moves, block):
    rows = []
    for t, here in enumerate(cands):
        head = (name, 0, times[t] // block, times[t], 45.0, 9.0, t == len(cands) - 1, times[t - 1] if t else None)
        for i, (road, prob) in enumerate(here):
            if t == 0:
                rows.append((*head, i + 1, road, math.log(prob), None, None, None, None))
            else:
                rows += [
                    (*head, i + 1, road, math.log(prob), k + 1, before, math.log(p), moves[t][k][i])
                    for k, (before, p) in enumerate(cands[t - 1])
                ]
    return rows


def whole(x):
    return math.floor(x * LOG_SCALE + 0.5)


def viterbi(cands, moves):
    """States of the longest prefix that can be reached; the first candidate wins ties."""
    score = [whole(math.log(p)) for _, p in cands[0]]
    back = []
    for t in range(1, len(cands)):
        new, ways = [], []
        for i, (_, p) in enumerate(cands[t]):
            best, way = None, None
            for k, s in enumerate(score):
                m = moves[t][k][i]
                if s is not None and m is not None and (best is None or s + whole(m) > best):
                    best, way = s + whole(m), k
            new.append(None if best is None else best + whole(math.log(p)))
            ways.append(way)
        if all(s is None for s in new):
            break
        score = new
        back.append(ways)
    state = max((i for i, s in enumerate(score) if s is not None), key=lambda i: (score[i], -i))
    states = [state]
    for ways in reversed(back):
        states.append(ways[states[-1]])
    return states[::-1]


def brute(cands, moves):
    """Best total of every complete state sequence."""
    best = None
    for states in itertools.product(*[range(len(c)) for c in cands]):
        total = 0
        for t, s in enumerate(states):
            if t:
                m = moves[t][states[t - 1]][s]
                if m is None:
                    break
                total += whole(m)
            total += whole(math.log(cands[t][s][1]))
        else:
            best = total if best is None else max(best, total)
    return best


def total_of(states, cands, moves):
    return sum(whole(math.log(cands[t][s][1])) for t, s in enumerate(states)) + sum(
        whole(moves[t][states[t - 1]][states[t]]) for t in range(1, len(states))
    )


def test_model_itself_is_optimal():
    rng = random.Random(1)
    for _ in range(100):
        cands, moves = trellis(rng, 5, ())
        states = viterbi(cands, moves)
        if len(states) == 5:
            assert total_of(states, cands, moves) == brute(cands, moves)
        else:
            assert brute(cands, moves) is None


@pytest.mark.parametrize("block, alpha", [(1, 4), (7, 4), (30, 4), (30, 7), (200, 4), (10**6, 4), (10**6, 9)])
def test_same_for_every_block_length_and_width(spark, block, alpha):
    rng = random.Random(5)
    rows, expected = [], set()
    for n in range(60):
        length = rng.choice([1, 2, 3, 10, 25, 40])
        cands, moves = trellis(rng, length, {rng.randrange(1, 60)} if n % 3 == 0 else ())
        t, times = 1000 + rng.randrange(50), []
        for _ in range(length):
            t += rng.choice([1, 1, 5, 20, 90])
            times.append(t)
        rows += rows_of(f"u{n}", times, cands, moves, block)
        states = viterbi(cands, moves)
        before = None
        for at, s in enumerate(states):
            road = cands[at][s][0]
            expected.add((f"u{n}", times[at], road, times[at - 1] if at else None, before, at == length - 1))
            before = road
    got = decode(spark.createDataFrame(rows, SCHEMA), MatchParams(alpha=alpha)).collect()
    assert len(got) == len(expected)
    assert {(r.customid, r.timest, r.road_id, r.prev_timest, r.prev_id, r.is_last) for r in got} == expected


def chains(cands, moves):
    """States of every chain, with the place where it begins: after a break a new one begins."""
    start = 0
    while start < len(cands):
        states = viterbi(cands[start:], moves[start:])
        yield start, states
        start += len(states)


@pytest.mark.parametrize("block, alpha", [(1, 4), (7, 4), (30, 7), (200, 4), (10**6, 4), (10**6, 8)])
def test_restart_after_every_break(spark, block, alpha):
    rng = random.Random(9)
    rows, expected = [], set()
    for n in range(60):
        length = rng.choice([1, 2, 3, 10, 25, 40])
        cands, moves = trellis(rng, length, {rng.randrange(1, 40) for _ in range(n % 5)})
        t, times = 1000 + rng.randrange(50), []
        for _ in range(length):
            t += rng.choice([1, 1, 5, 20, 90])
            times.append(t)
        rows += rows_of(f"u{n}", times, cands, moves, block)
        for start, states in chains(cands, moves):
            before = None
            for k, s in enumerate(states):
                at = start + k
                road = cands[at][s][0]
                last = k == len(states) - 1
                expected.add((f"u{n}", times[at], road, times[at - 1] if at else None, before, last))
                before = road
    got = decode(spark.createDataFrame(rows, SCHEMA), MatchParams(alpha=alpha, restart=True)).collect()
    assert len(got) == len(expected)
    assert {(r.customid, r.timest, r.road_id, r.prev_timest, r.prev_id, r.is_last) for r in got} == expected


@pytest.mark.parametrize("restart", [False, True])
def test_a_trajectory_of_many_blocks(spark, restart):
    rng = random.Random(3)
    length, broken = 4000, {1500, 3000, 3001} if restart else ()
    cands = [[(f"r{t % 5}_{c}", rng.choice([0.25, 0.5])) for c in range(2)] for t in range(length)]
    moves = [None] + [
        [[None if t in broken else rng.choice([-1.0, -1.5, -2.0]) for _ in range(2)] for _ in range(2)] for t in range(1, length)
    ]
    # Blocks without points in between.
    times = [7 * t + (900 if t > 2000 else 0) for t in range(length)]
    frame = spark.createDataFrame(rows_of("u", times, cands, moves, 1), SCHEMA)
    got = {r.timest: r.road_id for r in decode(frame, MatchParams(restart=restart)).collect()}
    expected = {times[a + k]: cands[a + k][s][0] for a, states in chains(cands, moves) for k, s in enumerate(states)}
    assert got == expected


def test_no_points(spark):
    for restart in (False, True):
        assert decode(spark.createDataFrame([], SCHEMA), MatchParams(restart=restart)).count() == 0


def test_combining_neighbours_in_any_order_is_the_same():
    """Summaries of random blocks: ((a b) c) and (a (b c)) let the same chains pass."""
    rng = random.Random(4)

    def block(number):
        def ways():
            return [None if rng.random() < 0.3 else {"score": (s := -rng.randrange(4)), "final": s - 1, "rank": rng.randrange(3)}
                    for _ in range(3)]

        rows = []
        tails = {n: ways() for n in range(3)}
        for _ in range(3):
            if rng.random() < 0.5:
                n = rng.randrange(3)
                rows.append({"broke": number * PLACES + n, "stand": {"score": -rng.randrange(3), "x": rng.randrange(3), "rank": 0},
                             "ways": [w and dict(w) for w in tails[n]]})
            else:
                row = ways()
                rows.append({"broke": None, "stand": None, "ways": row if any(row) else [{"score": 0, "final": 0, "rank": 0}] * 3})
        for x in range(3):
            for rank, row in enumerate(rng.sample(rows, 3)):
                if row["ways"][x] and row["broke"] is None:
                    row["ways"][x] = {**row["ways"][x], "rank": rank}
        for rank, row in enumerate(rng.sample(rows, 3)):
            if row["broke"] is not None:
                row["stand"]["rank"] = rank
        return rows

    def shape(node, scores):
        through = passed(node, scores)
        known = [w[0] for w in through.out if w]
        return through.broke, [w and w[0] - max(known) for w in through.out]

    for _ in range(300):
        a, b, c = block(0), block(1), block(2)
        one, two = combined(combined(a, b), c), combined(a, combined(b, c))
        for scores in ([0, None, None], [0, -1, -3], [None, -2, 0]):
            assert shape(one, scores) == shape(two, scores)


def decoded_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "customid string, trajid int, timest int, road_id string, prev_timest int, prev_id string, is_last boolean",
    )


def paths_frame(spark, paths):
    return spark.createDataFrame(
        [(p[0], p[-1], [(r, 1.0) for r in p]) for p in paths],
        "start_id string, end_id string, path array<struct<road:string,length:double>>",
    )


def test_route_fills_the_gap_and_ends_with_the_last_road(spark):
    decoded = decoded_frame(
        spark,
        [
            ("u", 0, 0, "r1", None, None, False),
            ("u", 0, 5, "r1", 0, "r1", False),
            ("u", 0, 9, "r3", 5, "r1", True),
        ],
    )
    got = routes(decoded, paths_frame(spark, [["r1", "r2", "r3"], ["r1"], ["r3"]]))
    assert sorted((r.timest, r.seq, r.roadID) for r in got.collect()) == [(5, 0, "r1"), (5, 1, "r2"), (9, 0, "r3")]


def test_same_road_throughout_is_one_row(spark):
    decoded = decoded_frame(spark, [("u", 0, 0, "r", None, None, False), ("u", 0, 5, "r", 0, "r", True)])
    assert [tuple(r) for r in routes(decoded, paths_frame(spark, [["r"]])).collect()] == [("u", 0, 5, "r", 0)]


def test_cut_route_does_not_emit_its_last_road(spark):
    decoded = decoded_frame(spark, [("u", 0, 0, "a", None, None, False), ("u", 0, 5, "b", 0, "a", False)])
    got = routes(decoded, paths_frame(spark, [["a", "b"]])).collect()
    assert [(r.timest, r.roadID) for r in got] == [(0, "a")]


def test_one_point(spark):
    decoded = decoded_frame(spark, [("u", 0, 3, "a", None, None, True)])
    assert [tuple(r) for r in routes(decoded, paths_frame(spark, [["a"]])).collect()] == [("u", 0, 3, "a", 0)]
