import math

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geo


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()
    return list(row) if len(row) > 1 else row[0]


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_haversine_forms(spark):
    a = (45.4647, 9.1653)
    b = (45.4744, 9.1952)
    metres, km, flat, fixed = one(
        spark,
        geo.haversine_m(*lits(*a, *b)),
        geo.haversine_km(*lits(*a, *b)),
        geo.flat_km(*lits(*a, *b)),
        geo.flat_km(*lits(*a, *b), in_degrees=False),
    )
    half = (
        math.sin(math.radians(a[0] - b[0]) / 2) ** 2
        + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    )
    assert metres == pytest.approx(2 * 6371000 * math.asin(math.sqrt(half)))
    assert km == pytest.approx(2 * 6372.8 * math.asin(math.sqrt(half)))
    assert flat == pytest.approx(110.25 * math.hypot(a[0] - b[0], (a[1] - b[1]) * math.cos(b[0])))
    assert fixed == pytest.approx(metres / 1000, rel=0.02)


def test_floor_goes_down(spark):
    assert one(spark, geo.floor_to(F.lit(1.23456789), 6), geo.floor_to(F.lit(-1.23456789), 6)) == [1.234567, -1.234568]


@pytest.mark.parametrize("frame", geo.FRAMES)
def test_projection_and_back(spark, frame):
    x, y = geo.project(*lits(45.4647, 9.1653), frame)
    lat, lon = geo.unproject(x, y, frame)
    got = one(spark, x, y, lat, lon)
    assert got[2:] == pytest.approx([45.4647, 9.1653], abs=1e-9)
    east = 6378137 * math.radians(9.1653 if frame == "mercator" else 45.4647)
    assert got[0] == pytest.approx(east)


def test_unknown_frame():
    with pytest.raises(ValueError):
        geo.project(F.lit(1.0), F.lit(2.0), "other")


def test_foot_inside_outside_and_equal_ends(spark):
    chord = (45.44, 9.14, 45.45, 9.14)
    rows = [
        (1, 45.445, 9.141, *chord),
        (2, 45.455, 9.141, *chord),
        (3, 45.44, 9.14, 45.44, 9.14, 45.44, 9.14),
    ]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, a double, b double, c double, d double")
    got = {r.id: r for r in geo.with_foot(df, ("lat", "lon"), ("a", "b", "c", "d")).collect()}
    assert (got[1].foot_lat, got[1].foot_lon) == pytest.approx((45.445, 9.14))
    assert got[2].foot_lat is None and got[2].foot_lon is None
    assert got[3].foot_lat == pytest.approx(45.44, abs=1e-9)


def test_point_geojson_round_trip(spark):
    text = geo.point_geojson(F.lit(45.4647071), F.lit(9.1653119), 6)
    lat, lon = geo.parse_point(text)
    assert one(spark, text, lat, lon) == ['{"type":"Point","coordinates":[9.165311,45.464707]}', 45.464707, 9.165311]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Rome"])
def test_local_time_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        clock = geo.local_time(F.lit(1504224000), "Europe/Rome")
        winter = geo.local_time(F.lit(1512000000), "Europe/Rome")
        assert one(spark, F.dayofweek(clock), F.hour(clock), F.hour(winter)) == [6, 2, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_gaussian(spark):
    assert one(spark, geo.gaussian_emission(F.lit(0.0))) == pytest.approx(1 / (math.sqrt(2 * math.pi) * 10))
