"""Segmentation against hand cases and a row-by-row model."""

import math
import random
from collections import defaultdict

import pytest

from roadtrace.operators.segment import best_per_second, clean_pings, is_outlier, segment, valid_pings
from roadtrace.params import SegmentParams

SCHEMA = "customid string, timestamp int, latitude double, longitude double, accuracy int"
T0 = 1504300000
FEW = SegmentParams(min_pings=0)


def pings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def steady(n, start=T0, gap=5, user="u", step=0.0005):
    return [(user, start + gap * k, 45.44 + step * k, 9.14, 10) for k in range(n)]


def metres(a, b):
    h = (
        math.sin(math.radians(a[0] - b[0]) / 2) ** 2
        + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    )
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def model(rows, p):
    """Plain model: group, cut at gaps, drop edges and outliers."""
    users = defaultdict(list)
    for r in rows:
        if (
            p.time_range[0] <= r[1] <= p.time_range[1]
            and p.lat_range[0] <= r[2] <= p.lat_range[1]
            and p.lon_range[0] <= r[3] <= p.lon_range[1]
            and r[4] < p.max_accuracy
        ):
            users[r[0]].append(r)
    out = set()
    for user, all_pings in users.items():
        if len(all_pings) <= p.min_pings:
            continue
        best = {}
        for r in sorted(all_pings, key=lambda r: (r[1], r[4], r[2], r[3])):
            best.setdefault(r[1], r)
        line = [best[t] for t in sorted(best)]
        parts, speeds = [[line[0]]], {}
        for a, b in zip(line, line[1:]):
            speeds[b[1]] = metres((b[2], b[3]), (a[2], a[3])) / (b[1] - a[1]) * 3.6
            if b[1] - a[1] >= p.max_gap:
                parts.append([])
            parts[-1].append(b)
        for number, part in enumerate(parts):
            v = [speeds.get(r[1]) for r in part]
            for k in range(3, len(part) - 2):
                limit = v[k] / 3 + 2
                if abs(v[k] - (v[k - 1] + v[k - 2]) / 2) > limit and abs(v[k] - (v[k + 1] + v[k + 2]) / 2) > limit:
                    continue
                out.add((user, part[k][1], number))
    return out


def keys(df):
    return {(r.customid, r.timest, r.trajid) for r in df.collect()}


def test_only_the_middle_of_six_points_is_kept(spark):
    got = segment(pings(spark, steady(6)), FEW).collect()
    assert [r.timest for r in got] == [T0 + 15]
    assert got[0].timediff == 5 and got[0].trajid == 0 and got[0].status == "in"
    assert got[0].spacediff == pytest.approx(55.597, abs=0.001)
    assert got[0].speed == pytest.approx(40.03, abs=0.01)
    assert segment(pings(spark, steady(5)), FEW).count() == 0


@pytest.mark.parametrize("gap, trajectories", [(59, 1), (60, 2)])
def test_gap_of_a_minute_splits(spark, gap, trajectories):
    rows = steady(7) + [
        (u, t - 5 + gap, lat, lon, acc) for u, t, lat, lon, acc in steady(14)[7:]
    ]
    ids = {r.trajid for r in segment(pings(spark, rows), FEW).collect()}
    assert ids == set(range(trajectories))


@pytest.mark.parametrize("n, users", [(50, 0), (51, 1)])
def test_users_need_more_than_fifty_pings(spark, n, users):
    rows = steady(n, step=0.0001)
    assert clean_pings(pings(spark, rows)).select("customid").distinct().count() == users
    assert segment(pings(spark, rows)).select("customid").distinct().count() == users


def test_copies_count_before_they_are_merged(spark):
    rows = steady(26, step=0.0001) * 2
    assert clean_pings(pings(spark, rows)).count() == 26


def test_best_accuracy_wins_per_second(spark):
    rows = [("u", T0, 45.44, 9.14, 20), ("u", T0, 45.45, 9.15, 5), ("u", T0, 45.43, 9.16, 5)]
    got = best_per_second(pings(spark, rows)).first()
    assert (got.best.latitude, got.best.accuracy, got.copies) == (45.43, 5, 3)


def test_ping_filter(spark):
    good = ("u", T0, 45.44, 9.14, 99)
    bad = [
        (None, T0, 45.44, 9.14, 1),
        ("u", None, 45.44, 9.14, 1),
        ("u", T0, None, 9.14, 1),
        ("u", T0, 45.44, None, 1),
        ("u", T0, 45.44, 9.14, None),
        ("u", 1504223999, 45.44, 9.14, 1),
        ("u", 1514764801, 45.44, 9.14, 1),
        ("u", T0, 45.38, 9.14, 1),
        ("u", T0, 45.44, 9.28, 1),
        ("u", T0, 45.44, 9.14, 100),
    ]
    assert valid_pings(pings(spark, [good] + bad)).count() == 1


@pytest.mark.parametrize(
    "speeds, outlier", [((30, 30, 90, 30, 30), True), ((30, 30, 60, 55, 60), False), ((30, 30, 31, 30, 30), False)]
)
def test_outlier_rule(spark, speeds, outlier):
    row = spark.createDataFrame([tuple(float(s) for s in speeds)], "a double, b double, v double, c double, d double")
    from pyspark.sql import functions as F

    c = F.col
    assert row.select(is_outlier(c("v"), (c("b"), c("a")), (c("c"), c("d")))).first()[0] is outlier


@pytest.mark.parametrize("block", [180, 600, 3600, 10**6])
def test_same_as_the_model_for_any_block_length(spark, block):
    rng = random.Random(7)
    rows = []
    for user in range(12):
        t = T0 + rng.randrange(4000)
        lat = 45.44
        for _ in range(rng.choice([20, 150, 300])):
            t += rng.choice([0, 1, 5, 5, 10, 30, 58, 59, 60, 61, 400, 5000] if rng.random() < 0.2 else [5, 10, 20])
            lat += rng.choice([0.0001, 0.0003, 0.0003, 0.0004, -0.0002] * 8 + [0.004])
            lat = 45.39 + (lat - 45.39) % 0.14
            rows.append((f"u{user}", t, lat, 9.14 + rng.random() * 0.001, rng.randrange(110)))
    p = SegmentParams(min_pings=30, block_seconds=block)
    expected = model(rows, p)
    assert len(expected) > 300
    assert keys(segment(pings(spark, rows), p)) == expected


def test_block_length_must_cover_the_frame():
    with pytest.raises(ValueError):
        SegmentParams(block_seconds=100)


def test_calendar_and_point_text(spark):
    got = segment(pings(spark, steady(6, start=1504223985 + 15)), FEW).first()
    assert (got.weekday, got.dayhour) == (6, 2)
    assert got.geojson == f'{{"type":"Point","coordinates":[{got.longitude},{got.latitude}]}}'
    assert 0 <= got.rnd < 1
