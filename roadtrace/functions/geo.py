"""Geographic functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.params import GPS_SIGMA

# Earth radii and degree length.
MEAN_RADIUS_KM = 6371
LONG_RADIUS_KM = 6372.8
DEGREE_KM = 110.25
MERCATOR_RADIUS_M = 6378137.0
EQUAL_ENDS_SHIFT = 0.00001

POINT_JSON = "type string, coordinates array<double>"
LINE_JSON = "type string, id string, properties struct<timestamp string, version int, changeset bigint, lenght double, " \
    "highway string, loc_ref string, name string, oneway string, surface string>, " \
    "geometry struct<type string, coordinates array<array<double>>>"

FRAMES = ("mercator", "swapped")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (arc tangent form)."""
    s_lat = F.sin(F.radians(lat1 - lat2) / 2)
    s_lon = F.sin(F.radians(lon1 - lon2) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(MEAN_RADIUS_KM) * (2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))) * 1000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres (arc sine form, slightly larger radius)."""
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + s_lon * s_lon * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(LONG_RADIUS_KM) * (2 * F.asin(F.sqrt(h)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, in_degrees: bool = True) -> Column:
    """Euclidean approximation in kilometres.

    By default the cosine is given the latitude in degrees, which is what existing results were made with;
    ``in_degrees=False`` converts it first.
    """
    shrink = F.cos(lat2) if in_degrees else F.cos(F.radians(lat2))
    d_lat, d_lon = lat1 - lat2, (lon1 - lon2) * shrink
    return F.lit(DEGREE_KM) * F.sqrt(d_lat * d_lat + d_lon * d_lon)


def floor_to(value: Column, digits: int) -> Column:
    """Cut down to ``digits`` decimals, towards minus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale) / scale


def fixed(value: Column, scale: float) -> Column:
    """``value * scale`` rounded half up to a whole number; sums of these are exact in any order."""
    return F.floor(value * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


def snap(value: Column, digits: int = 6) -> Column:
    """Nearest multiple of 10^-digits, so that equal distances compare equal."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def _mercator_east(degrees: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(degrees)


def _mercator_north(degrees: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(degrees) / 2))


def project(lat: Column, lon: Column, frame: str = "mercator") -> tuple[Column, Column]:
    """Spherical Mercator coordinates (x, y).

    ``mercator`` takes longitude east and latitude north.  ``swapped`` feeds the two axes the other way round;
    it is kept because published results were computed that way.
    """
    if frame == "mercator":
        return _mercator_east(lon), _mercator_north(lat)
    if frame == "swapped":
        return _mercator_east(lat), _mercator_north(lon)
    raise ValueError(f"frame must be one of {FRAMES}")


def unproject(x: Column, y: Column, frame: str = "mercator") -> tuple[Column, Column]:
    """Latitude and longitude of projected coordinates."""
    east = F.degrees(x / F.lit(MERCATOR_RADIUS_M))
    north = F.degrees(2 * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS_M))) - F.lit(math.pi / 2))
    if frame == "mercator":
        return north, east
    if frame == "swapped":
        return east, north
    raise ValueError(f"frame must be one of {FRAMES}")


def gaussian_emission(distance: Column, sigma: float = GPS_SIGMA) -> Column:
    """Normal density of the distance, an alternative to the inverse-distance emission."""
    z = distance / F.lit(sigma)
    return F.lit(1.0 / (math.sqrt(2 * math.pi) * sigma)) * F.exp(F.lit(-0.5) * z * z)


def log_gaussian_emission(distance: Column, sigma: float = GPS_SIGMA) -> Column:
    """Its natural logarithm, finite at any distance."""
    z = distance / F.lit(sigma)
    return F.lit(-0.5) * z * z - F.lit(math.log(math.sqrt(2 * math.pi) * sigma))


def with_foot(df: DataFrame, point: tuple[str, str], chord: tuple[str, str, str, str], frame: str = "swapped",
              prefix: str = "foot") -> DataFrame:
    """Add ``<prefix>_lat`` and ``<prefix>_lon``: the foot of the perpendicular from a point to a chord.

    ``point`` names (lat, lon) columns, ``chord`` names (lat, lon) of both ends.  Both results are null where
    the foot is outside the bounding box of the chord.  The steps are separate projections so that each
    intermediate value is computed once.
    """
    c = F.col
    px, py = project(c(point[0]), c(point[1]), frame)
    ax, ay = project(c(chord[0]), c(chord[1]), frame)
    bx, by = project(c(chord[2]), c(chord[3]), frame)
    keep = df.columns
    step = df.withColumns({"_px": px, "_py": py, "_ax": ax, "_ay": ay, "_bx": bx, "_by": by})
    same = (c("_ax") == c("_bx")) & (c("_ay") == c("_by"))
    step = step.withColumn("_ax", F.when(same, c("_ax") - F.lit(EQUAL_ENDS_SHIFT)).otherwise(c("_ax")))
    dx, dy = c("_bx") - c("_ax"), c("_by") - c("_ay")
    step = step.withColumn("_u", ((c("_px") - c("_ax")) * dx + (c("_py") - c("_ay")) * dy) / (dx * dx + dy * dy))
    step = step.withColumns({"_fx": c("_ax") + c("_u") * dx, "_fy": c("_ay") + c("_u") * dy})
    inside = (
        c("_fx").between(F.least("_ax", "_bx"), F.greatest("_ax", "_bx"))
        & c("_fy").between(F.least("_ay", "_by"), F.greatest("_ay", "_by"))
    )
    lat, lon = unproject(c("_fx"), c("_fy"), frame)
    return step.select(
        *keep,
        F.when(inside, lat).alias(f"{prefix}_lat"),
        F.when(inside, lon).alias(f"{prefix}_lon"),
    )


def point_geojson(lat: Column, lon: Column, digits: int = 8) -> Column:
    """GeoJSON text of a point, longitude first, cut to ``digits`` decimals."""
    return F.concat(
        F.lit('{"type":"Point","coordinates":['),
        floor_to(lon, digits).cast("string"),
        F.lit(","),
        floor_to(lat, digits).cast("string"),
        F.lit("]}"),
    )


def parse_point(geojson: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a GeoJSON point."""
    coordinates = F.from_json(geojson, POINT_JSON)["coordinates"]
    return coordinates[1], coordinates[0]


def parse_line(geojson: Column) -> Column:
    """A GeoJSON line feature as a struct with ``id``, ``properties`` and ``geometry``."""
    return F.from_json(geojson, LINE_JSON)


def local_time(epoch: Column, zone: str) -> Column:
    """Wall-clock time of epoch seconds in a zone, whatever the session's own zone is."""
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=epoch)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
