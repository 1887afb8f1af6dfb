"""Candidate roads of each point: distance join, ranking and emission probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.functions.geo import gaussian_emission, haversine_m, log_gaussian_emission, project, snap, unproject, with_foot
from roadtrace.operators.blocks import time_block
from roadtrace.params import DISTANCE_FLOOR, MatchParams
from roadtrace.staging import staged

POINT = ["customid", "trajid", "tblock", "timest", "latitude", "longitude"]
BLOCK = ["customid", "trajid", "tblock"]
ENDS = ["lat0", "lon0", "lat1", "lon1"]
# Of an edge: metres of the road before it, its own and those of the whole road.
MEASURES = ["before", "metres", "length"]

# A cell is this many search radii wide; an edge longer than a cell is laid out piece by piece.
CELL_RADII = 2
# At most this many cells are dealt over tasks.  They are those with most pairs and rows, so any other cell has less than
# one part in this many of all of them.
DEALT_CELLS = 10_000


def road_cells(roads: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Every edge of every road, once per grid cell that lies within ``tau`` of it.

    Long edges are cut into pieces for the layout only (the whole edge stays in the row), so the number of
    cells grows with the length of an edge and not with the area of its box.  With ``full_length`` an edge carries
    ``MEASURES``, for which roads need ``marks``.
    """
    side = float(CELL_RADII * p.tau)
    c = F.col
    n = F.size("coordinates")
    sides = [F.slice("coordinates", F.lit(1), n - 1).alias("a"), F.slice("coordinates", F.lit(2), n - 1).alias("b")]
    measures = MEASURES if p.full_length else []
    if p.full_length:
        sides += [F.slice("marks.at", F.lit(1), n - 1).alias("before"), F.slice("marks.at", F.lit(2), n - 1).alias("after")]
    edges = roads.select("road_id", *ENDS, *measures[2:], F.explode(F.arrays_zip(*sides)).alias("e"))
    if p.full_length:
        edges = edges.withColumns({"before": c("e.before"), "metres": c("e.after") - c("e.before")})
    x1, y1 = project(c("e.a.lat"), c("e.a.lon"), p.frame)
    x2, y2 = project(c("e.b.lat"), c("e.b.lon"), p.frame)
    edges = edges.select("road_id", *ENDS, *measures, x1.alias("x1"), y1.alias("y1"), (x2 - x1).alias("dx"), (y2 - y1).alias("dy"))
    square = c("dx") * c("dx") + c("dy") * c("dy")
    edges = edges.withColumn("square", F.when(square > 0, square).otherwise(F.lit(1.0)))
    span = F.greatest(F.abs("dx"), F.abs("dy"))
    cut = edges.withColumn("parts", F.greatest(F.lit(1), F.ceil(span / side))).withColumn(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), c("parts")))
    )
    start, end = (c("part") - 1) / c("parts"), c("part") / c("parts")
    boxed = cut.withColumns(
        {
            "xa": c("x1") + c("dx") * start,
            "xb": c("x1") + c("dx") * end,
            "ya": c("y1") + c("dy") * start,
            "yb": c("y1") + c("dy") * end,
        }
    )
    # One unit of slack covers the rounding of the cut points.
    reach = p.tau + 1

    def cells(a: str, b: str):
        low = F.floor((F.least(a, b) - reach) / side)
        high = F.floor((F.greatest(a, b) + reach) / side)
        return F.sequence(low, high)

    return (
        boxed.withColumn("cx", F.explode(cells("xa", "xb")))
        .withColumn("cy", F.explode(cells("ya", "yb")))
        .select("cx", "cy", "road_id", *ENDS, *measures, "x1", "y1", "dx", "dy", "square")
    )


def placed_points(points: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Points with their projected place, grid cell and time block."""
    side = float(CELL_RADII * p.tau)
    c = F.col
    x, y = project(c("latitude"), c("longitude"), p.frame)
    return points.select(
        "customid", "trajid", "timest", "latitude", "longitude", x.alias("px"), y.alias("py")
    ).withColumns(
        {
            "cx": F.floor(c("px") / side),
            "cy": F.floor(c("py") / side),
            "tblock": time_block(c("timest"), p.block_seconds),
        }
    )


def crowded_cells(placed: DataFrame, cells: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Cells with more than ``part_points`` points or ``part_edges`` edges, and the parts to deal both into.

    Only counts are shuffled, merged on the map side.  There are ``DEALT_CELLS`` rows at most: the cells with the largest
    (points + 1) x (edges + 1), which are their pairs, points and edges.  Cells that have only points or only edges count,
    as they are shuffled too.
    """
    c, none = F.col, F.lit(0)
    own = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("points"))
    near = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("edges"))
    return (
        own.join(near, ["cx", "cy"], "full")
        .withColumns({"points": F.coalesce("points", none), "edges": F.coalesce("edges", none)})
        .where((c("points") > p.part_points) | (c("edges") > p.part_edges))
        .orderBy(((c("points") + 1.0) * (c("edges") + 1.0)).desc(), "cx", "cy")
        .limit(DEALT_CELLS)
        .select(
            "cx",
            "cy",
            F.greatest(F.lit(1), F.ceil(c("points") / p.part_points)).alias("point_parts"),
            F.greatest(F.lit(1), F.ceil(c("edges") / p.part_edges)).alias("edge_parts"),
        )
    )


def dealt(placed: DataFrame, cells: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and edges with the parts of their cell, ``pp`` and ``ep``: each pair of a cell meets in one part.

    A cell of P point parts and E edge parts becomes P x E keys.  A point goes to the E keys of its part, an edge to the P
    keys of its own.  Cells that are not crowded have one part.  Smaller cells would not do: vehicles that stand still
    share one place, and the edges within ``tau`` of a part of a cell are nearly those of the cell.
    """
    c = F.col
    # DEALT_CELLS rows at most.
    crowded = F.broadcast(crowded)
    one = F.lit(1).cast("bigint")
    point_parts, edge_parts = F.coalesce("point_parts", one), F.coalesce("edge_parts", one)

    def every(parts):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))

    point = F.xxhash64("customid", "trajid", "timest", "latitude", "longitude")
    edge = F.xxhash64("road_id", "x1", "y1", "dx", "dy")
    own = placed.join(crowded, ["cx", "cy"], "left").withColumn("pp", F.pmod(point, point_parts))
    near = cells.join(crowded, ["cx", "cy"], "left").withColumn("ep", F.pmod(edge, edge_parts))
    return (
        own.withColumn("ep", every(edge_parts)).drop("point_parts", "edge_parts"),
        near.withColumn("pp", every(point_parts)).drop("point_parts", "edge_parts"),
    )


def near_roads(points: DataFrame, cells: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Roads within ``tau`` of each point, with the floored distance: one row per (point, road).

    A point has one cell, so this is an equi-join on the cell followed by the exact distance.  Cells with many pairs are
    first dealt into parts of a bounded number of points and edges: what a cell costs is its pairs, which says nothing to
    adaptive execution, as that looks at bytes.  The roads found are laid out by (trajectory, time block), which also
    serves ranking and the collection per point.
    """
    c = F.col
    # Counted and joined: two readers of what may be a long computation.
    placed = staged(placed_points(points, p))
    own, near = dealt(placed, cells, crowded_cells(placed, cells, p))
    # Squared, and from the edge vector the road side already has: the join evaluates this for every pair in a
    # cell, and a short expression keeps the generated method small enough to be compiled.
    along = F.greatest(
        F.lit(0.0),
        F.least(
            F.lit(1.0), ((c("px") - c("x1")) * c("dx") + (c("py") - c("y1")) * c("dy")) / c("square")
        ),
    )
    off_x = c("px") - c("x1") - along * c("dx")
    off_y = c("py") - c("y1") - along * c("dy")
    hits = (
        own.join(near, ["cx", "cy", "pp", "ep"])
        .withColumn("d2", F.pow(off_x, F.lit(2.0)) + F.pow(off_y, F.lit(2.0)))
        .where(c("d2") <= p.tau * p.tau)
    )
    if p.full_length:
        # The foot on the nearest edge; of equally near edges the one that comes first.
        foot = F.struct(
            snap(F.sqrt("d2")).alias("d"),
            (c("before") + along * c("metres")).alias("at"),
            (c("x1") + along * c("dx")).alias("x"),
            (c("y1") + along * c("dy")).alias("y"),
        )
        carried, best = ["length"], [F.min("foot").alias("foot")]
        hits = hits.withColumn("foot", foot).select(*POINT, "road_id", *ENDS, "length", "d2", "foot")
    else:
        carried, best = [], []
        hits = hits.select(*POINT, "road_id", *ENDS, "d2")
    return (
        hits.repartition(*BLOCK)
        .groupBy(*POINT, "road_id")
        .agg(F.min("d2").alias("d2"), *[F.first(e).alias(e) for e in [*ENDS, *carried]], *best)
        .withColumn("distance", snap(F.greatest(F.sqrt("d2"), F.lit(DISTANCE_FLOOR))))
        .drop("d2")
    )


def candidates(points: DataFrame, cells: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """The ``alpha`` nearest roads of each point with their emission probability.

    The probability is the inverse distance over the sum of inverse distances of all roads within ``tau``, so
    the kept ones may sum to less than 1.  ``log_prob`` is its logarithm, in closed form for the normal density, which
    itself becomes 0 far away.  Equal distances go to the smaller road id.  Points with no road vanish.
    """
    by_distance = Window.partitionBy(*BLOCK, "timest").orderBy("distance", "road_id")
    everything = by_distance.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = 1 / F.col("distance") / F.col("total")
    inverse = p.emission == "inverse"
    prob = share if inverse else gaussian_emission(F.col("distance"))
    log_prob = F.log(share) if inverse else log_gaussian_emission(F.col("distance"))
    return (
        near_roads(points, cells, p)
        .withColumns(
            {
                "rank": F.row_number().over(by_distance),
                "total": F.sum(1 / F.col("distance")).over(everything),
            }
        )
        .where(F.col("rank") <= p.alpha)
        .withColumns({"prob": prob, "log_prob": log_prob})
        .drop("total")
    )


def candidate_points(found: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """One row per point with its candidates (``alpha`` at most) in rank order.

    Each candidate carries what later steps need of its road: the foot of the point on the chord between the
    road's ends (null if outside), the distances from the foot to both ends, and whether the point is nearer
    to the first end.  With ``full_length`` the foot is the nearest place on the road itself, so there always is one, and
    the distances to both ends are those along the road.
    """
    c = F.col
    end0, end1 = (c("lat0"), c("lon0")), (c("lat1"), c("lon1"))
    foot = (c("foot_lat"), c("foot_lon"))
    here = (c("latitude"), c("longitude"))
    if p.full_length:
        lat, lon = unproject(c("foot.x"), c("foot.y"), p.frame)
        footed = found.withColumns({"foot_lat": lat, "foot_lon": lon})
        to_ends = {"to0": c("foot.at"), "to1": c("length") - c("foot.at")}
    else:
        footed = with_foot(found, ("latitude", "longitude"), tuple(ENDS), p.foot_frame)
        to_ends = {"to0": haversine_m(*foot, *end0), "to1": haversine_m(*foot, *end1)}
    footed = footed.withColumns({**to_ends, "near0": haversine_m(*here, *end0) < haversine_m(*here, *end1)})
    one = F.struct("rank", "road_id", "prob", "log_prob", "foot_lat", "foot_lon", "to0", "to1", "near0")
    return footed.groupBy(*POINT).agg(F.array_sort(F.collect_list(one)).alias("cands"))


def candidate_roads(points: DataFrame) -> DataFrame:
    """Distinct roads that are a candidate of some point."""
    return points.select(F.explode("cands.road_id").alias("road_id")).distinct()
