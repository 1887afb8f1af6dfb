"""Cheapest short paths between roads."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.functions.geo import fixed
from roadtrace.operators.roads import touches
from roadtrace.params import MatchParams
from roadtrace.staging import staged

# Path costs are compared in whole micrometres: sums are exact, so ties do not depend on the order of adding.
MICRO = 1e6

# Up to this many hops one path per (start, end, hops) is enough to extend, the cheapest; see ``neighbor_paths``.
PRUNABLE_HOPS = 4

# Starts whose paths are searched together in one task; results do not depend on it.
PART_STARTS = 1000

# Ranges that are sorted to number the starts.  The driver gets some 300 samples for each, so their number stays fixed.
RANGES = 200

PATH = ["micro", "ids", "lengths", "first_at0", "last_at0"]


def neighbor_paths(
    edges: DataFrame,
    starts: DataFrame,
    p: MatchParams = MatchParams(),
    hubs: DataFrame | None = None,
    part_starts: int = PART_STARTS,
) -> DataFrame:
    """The cheapest path of at most ``theta`` hops for every (start, end): path, cost, number of roads.

    A path visits each road once.  A hop is allowed while the roads before the new one sum to less than
    ``gamma``; the last of ``theta`` hops is not tested.  The cost counts both end roads; equal costs go to
    fewer hops, then to smaller road ids.  ``first_at0`` (``last_at0``) tells whether the first (last) road touches the
    next (previous) one with its first end, as the pair table says; null for a path of one road.

    Before each further hop the paths are reduced to the cheapest per (start, end).  With at most four hops
    this loses nothing: if the cheaper path shares a road with the rest of a dropped path, then that road is
    reached at a cost below ``gamma`` in fewer hops, and the rest follows from there.  With more hops the
    untested last hop breaks that argument: a shorter path has its last hop tested.  Nor does it hold if dead ends are
    dropped.  Then a path is dropped only if, whatever roads follow it, a cheaper one of as many hops can be followed
    by the same roads (``_irreplaceable``).  Both ways the paths that go on are a fixed number per (start, end, hops).

    ``edges`` is the pair table, or its part without crowded nodes, whose stops are then ``hubs`` (``adjacency_parts``).
    Across a hub a hop goes from road to node to road, with few paths per (start, node) in between
    (``_across_hubs``), so a hub of n roads costs n rows per start and hop instead of n².  The rows are the same.

    Paths are never shuffled.  Starts are dealt into parts of about ``part_starts`` neighbours (``_dealt``), and each part
    gets the pairs and hubs of all roads its paths can reach (``_reached``); every hop then stays in its part.  Every hop
    also reads the paths once: those found so far go along with the new ones, told apart by their number of roads.
    """
    c = F.col
    unknown = F.lit(None).cast("boolean")
    limit = F.lit(round(p.gamma * MICRO)).cast("bigint")
    known = edges.select("road_id", "length")
    if hubs is not None:
        known = known.unionByName(hubs.select("road_id", "length"))
    lengths = known.groupBy("road_id").agg(F.first("length").alias("length"))
    dealt, n_parts = _dealt(lengths, starts, part_starts)
    reached = _reached(dealt, edges, hubs, p.theta - 1, limit)

    def in_parts(table: DataFrame) -> DataFrame:
        return table.repartitionById(n_parts, c("part"))

    ways = edges.select(
        "road_id",
        "neighbour_id",
        "neighbour_length",
        fixed(c("neighbour_length"), MICRO).alias("step"),
        "at0",
        "neighbour_at0",
    )
    onward = None
    if hubs is not None:
        at = hubs.select("road_id", "node_id", c("e0").alias("o0"), c("e1").alias("o1"))
        if not p.keep_dead_ends:
            # A path of theta-1 hops holds fewer roads.
            at = at.join(_some_roads(hubs, p.theta + 1), "node_id")
        ways = ways.unionByName(at, allowMissingColumns=True)
        nodes = reached.join(hubs.select("road_id", "node_id"), "road_id").select("part", "node_id").distinct()
        onward = in_parts(nodes.join(hubs, "node_id")).select(
            "part",
            "node_id",
            c("road_id").alias("next_id"),
            c("length").alias("next_length"),
            c("e0").alias("n0"),
            c("e1").alias("n1"),
        )
    way = F.struct(*[name for name in ways.columns if name != "road_id"])
    lists = ways.groupBy("road_id").agg(F.collect_list(way).alias("ways"))
    lists = in_parts(reached.join(lists, "road_id")).select("part", c("road_id").alias("end_id"), "ways")
    no_way = F.lit(None).cast(lists.schema["ways"].dataType.elementType)

    paths = in_parts(dealt).select(
        "part",
        c("road_id").alias("start_id"),
        c("road_id").alias("end_id"),
        fixed(c("length"), MICRO).alias("micro"),
        F.array("road_id").alias("ids"),
        F.array("length").alias("lengths"),
        unknown.alias("first_at0"),
        unknown.alias("last_at0"),
    )
    prune = p.theta <= PRUNABLE_HOPS and p.keep_dead_ends
    pair = ["part", "start_id", "end_id"]
    for hop in range(1, p.theta + 1):
        last = hop == p.theta
        # The paths of the hop before have as many roads as this hop's number.
        newest = F.size("ids") == hop
        goes_on = newest & (F.lit(True) if last else c("micro") < limit)
        # Without a way the path stays as it is.
        stays = F.array(no_way)
        if last and not p.keep_dead_ends:
            # A path of theta-1 hops only counts if it can be extended.
            stays = F.when(~newest | _leads_on(hubs is not None), stays).otherwise(F.array())
        tried = paths.join(lists, ["part", "end_id"], "left").select(
            *pair,
            *PATH,
            F.explode(
                F.concat(stays, F.when(goes_on & c("ways").isNotNull(), c("ways")).otherwise(F.array()))
            ).alias("way"),
        )
        turn = c("way.neighbour_id").isNotNull()
        tried = tried.where(~turn | ~F.array_contains("ids", c("way.neighbour_id")))

        def then(new: Column, old: str) -> Column:
            return F.when(turn, new).otherwise(c(old)).alias(old)

        longer = tried.select(
            "part",
            "start_id",
            then(c("way.neighbour_id"), "end_id"),
            then(c("micro") + c("way.step"), "micro"),
            then(F.concat("ids", F.array("way.neighbour_id")), "ids"),
            then(F.concat("lengths", F.array("way.neighbour_length")), "lengths"),
            then(c("way.at0") if hop == 1 else c("first_at0"), "first_at0"),
            then(c("way.neighbour_at0"), "last_at0"),
            *([] if hubs is None else ["way.node_id", "way.o0", "way.o1"]),
        )
        if hubs is not None:
            longer = _across_hubs(longer, onward, hop, prune)
        if last or (hop == 1 and hubs is None):
            paths = longer
        elif hop == 1 or prune:
            # Two roads may meet at a hub and elsewhere.
            paths = _cheapest(longer.withColumn("roads", F.size("ids")), [*pair, "roads"])
        else:
            longer = longer.withColumn("roads", F.size("ids"))
            if hubs is not None:
                longer = longer.dropDuplicates([*pair, "ids"])
            paths = _irreplaceable(longer, [*pair, "roads"], p.theta - hop)
    best = _cheapest(paths, pair)
    return best.select(
        "start_id",
        "end_id",
        F.arrays_zip(c("ids").alias("road"), c("lengths").alias("length")).alias("path"),
        (c("micro") / MICRO).alias("cost"),
        F.size("ids").alias("roads"),
        "first_at0",
        "last_at0",
    )


def _dealt(lengths: DataFrame, starts: DataFrame, part_starts: int) -> tuple[DataFrame, int]:
    """Starts that have neighbours, with their length and a ``part``; and the number of parts.

    Parts are ranges of equal size, so their size does not depend on how densely roads lie.  Starts with ``lat0`` and
    ``lon0`` are ordered along a curve through the plane, the others by id; where neighbours are far apart in that order,
    parts only reach more roads.

    Starts are numbered in that order and cut by their numbers.  Range partitioning into the parts themselves would bring
    samples of each part to the driver, about a third of all starts.
    """
    c = F.col
    place = _along_curve(c("lat0"), c("lon0")) if {"lat0", "lon0"} <= set(starts.columns) else F.lit(0)
    own = starts.select("road_id", place.alias("place")).groupBy("road_id").agg(F.min("place").alias("place"))
    n = starts.count()
    n_parts = max(-(-n // part_starts), min(n, starts.sparkSession.sparkContext.defaultParallelism), 1)
    order = ["place", "road_id"]
    ranges = lengths.join(own, "road_id").repartitionByRange(min(n_parts, RANGES), *order).sortWithinPartitions(*order)
    # Written once, as the ranges come from samples.  The id holds the range and, in its lower 33 bits, the row's place there.
    ordered = staged(ranges.select("road_id", "length", F.monotonically_increasing_id().alias("id")))
    of_range = F.shiftright("id", 33).cast("int")
    sizes = {r["range"]: r["count"] for r in ordered.groupBy(of_range.alias("range")).count().collect()}
    before = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))]
    number = F.get(F.lit(before), of_range) + c("id").bitwiseAND(F.lit(2**33 - 1))
    part = F.floor(number * n_parts / max(before[-1], 1)).cast("int")
    return ordered.select("road_id", "length", part.alias("part")), n_parts


def _along_curve(lat: Column, lon: Column) -> Column:
    """Place along a Z-order curve: the bits of both degrees, in steps of about two metres, by turns.

    The curve runs through squares of 360 degrees, one after the other, so places outside the usual range keep their order.
    """

    def steps(degrees: Column, least: float) -> Column:
        return F.floor((degrees - least) / 360 * 2**24).cast("bigint")

    def spread(steps: Column) -> Column:
        bits = steps.bitwiseAND(F.lit(2**24 - 1))
        for shift, mask in (
            (16, 0x0000FFFF0000FFFF),
            (8, 0x00FF00FF00FF00FF),
            (4, 0x0F0F0F0F0F0F0F0F),
            (2, 0x3333333333333333),
            (1, 0x5555555555555555),
        ):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    up, right = steps(lat, -90.0), steps(lon, -180.0)
    return F.struct(
        F.shiftright(up, 24).alias("up"),
        F.shiftright(right, 24).alias("right"),
        F.shiftleft(spread(up), 1).bitwiseOR(spread(right)).alias("curve"),
    )


def _reached(dealt: DataFrame, edges: DataFrame, hubs: DataFrame | None, hops: int, limit: Column) -> DataFrame:
    """Roads that paths from a part reach in at most ``hops`` hops, once per part; perhaps some more.

    Only the single road before a hop is held against ``limit``, not the sum of all.
    """
    c = F.col
    near = edges.where(fixed(c("length"), MICRO) < limit).select("road_id", "neighbour_id")
    reached = dealt.select("part", "road_id")
    for _ in range(hops):
        wider = reached.unionByName(reached.join(near, "road_id").select("part", c("neighbour_id").alias("road_id")))
        if hubs is not None:
            short = hubs.where(fixed(c("length"), MICRO) < limit).select("road_id", "node_id")
            nodes = reached.join(short, "road_id").select("part", "node_id").distinct()
            wider = wider.unionByName(nodes.join(hubs, "node_id").select("part", "road_id"))
        reached = staged(wider.distinct())
    return reached


def _some_roads(hubs: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` different roads of each hub: ``some``."""
    by_road = Window.partitionBy("node_id").orderBy("road_id")
    first = hubs.select("node_id", "road_id").distinct().withColumn("k", F.row_number().over(by_road))
    return first.where(F.col("k") <= n).groupBy("node_id").agg(F.collect_list("road_id").alias("some"))


def _leads_on(across: bool) -> Column:
    """Whether one of the ``ways`` leads to a road that ``ids`` do not hold, also at a hub if ``across``."""

    def new(road: Column) -> Column:
        return ~F.array_contains("ids", road)

    def leads(way: Column) -> Column:
        along = way["neighbour_id"].isNotNull() & new(way["neighbour_id"])
        return along | F.exists(way["some"], new) if across else along

    return F.coalesce(F.exists("ways", leads), F.lit(False))


def _across_hubs(paths: DataFrame, onward: DataFrame, hop: int, prune: bool) -> DataFrame:
    """Paths that stand at a hub (``node_id``) get one road longer; the others stay as they are.

    With ``prune`` only the cheapest extension per (start, end) is wanted.  For a road that the cheapest path at the
    node does not hold, that path gives it; for a road it holds, the cheapest path without that road does.  So a
    (start, node) needs one path and one more per road of it except the start.  All paths here have the same number of
    roads, and the new road comes last in all, so it does not change their order.
    """
    c = F.col
    stands = c("node_id").isNotNull()
    here = paths.select(
        "part",
        "start_id",
        F.when(~stands, c("end_id")).alias("end_id"),
        "node_id",
        F.struct(*PATH, "o0", "o1").alias("w"),
        F.lit(None).cast("string").alias("without"),
    )
    # The first hop has one path per start.
    if prune and hop > 1:
        key = ["part", "start_id", "node_id"]
        # Paths that stand at no hub have a key of their own, their end.
        top = F.min("w").over(Window.partitionBy(*key, "end_id"))
        held = F.filter(
            F.slice("top.ids", F.lit(2), F.size("top.ids") - 1), lambda road: ~F.array_contains("w.ids", road)
        )
        first = F.array(F.lit(None).cast("string"))
        here = (
            here.withColumn("top", top)
            .withColumn("without", F.explode(F.when(~stands | (c("w") == c("top")), first).otherwise(held)))
            .groupBy(*key, "end_id", "without", F.size("w.ids").alias("roads"))
            .agg(F.min("w").alias("w"))
        )
    fits = ~F.array_contains("w.ids", c("next_id")) & (c("without").isNull() | (c("without") == c("next_id")))

    def then(new: Column, old: str) -> Column:
        return F.when(stands, new).otherwise(c(f"w.{old}")).alias(old)

    return (
        here.join(onward, ["part", "node_id"], "left")
        .where(~stands | fits)
        .select(
            "part",
            "start_id",
            F.coalesce("next_id", "end_id").alias("end_id"),
            then(c("w.micro") + fixed(c("next_length"), MICRO), "micro"),
            then(F.concat("w.ids", F.array("next_id")), "ids"),
            then(F.concat("w.lengths", F.array("next_length")), "lengths"),
            then(touches(c("w.o0"), c("n0"), c("n1")) if hop == 1 else c("w.first_at0"), "first_at0"),
            then(touches(c("n0"), c("w.o0"), c("w.o1")), "last_at0"),
        )
    )


def _cheapest(paths: DataFrame, key: list[str]) -> DataFrame:
    """Smallest (cost, number of roads, ids) per key."""
    whole = F.struct("micro", F.size("ids").alias("n"), "ids", "lengths", "first_at0", "last_at0")
    return (
        paths.groupBy(*key)
        .agg(F.min(whole).alias("w"))
        .select(*[k for k in key if k != "roads"], *[f"w.{name}" for name in PATH])
    )


def _irreplaceable(paths: DataFrame, key: list[str], more: int) -> DataFrame:
    """Paths of one number of hops without those that cheaper ones of the same ``key`` can replace.

    A path may be followed by any ``more`` roads or fewer that it does not hold itself.  It is needed if there are such
    roads of which every cheaper path holds one.  Going from the cheapest path on, ``hitting`` has sets of at most ``more``
    roads, one of each path kept so far, so a path is kept if it avoids one of these sets, and the sets then take up one of
    its own roads.  Start and end do not count: no continuation has them.  With i inner roads a path, a set can grow
    in i ways at most ``more`` times, so there are at most i^more sets; the paths kept are at most
    (i + more)! / (i! more!), the bound for set pairs of which only the equal ones are disjoint.  Equal costs go by ids,
    which continuations do not change.
    """
    whole = F.struct(*PATH)
    grouped = paths.groupBy(*key).agg(F.array_sort(F.collect_list(whole)).alias("ordered"))
    sets = f"array<{paths.schema['ids'].dataType.simpleString()}>"
    kept = grouped.schema["ordered"].dataType.simpleString()

    def hit(some: Column, inner: Column) -> Column:
        return F.arrays_overlap(some, inner)

    def with_one_more(hitting: Column, inner: Column) -> Column:
        missing = F.filter(hitting, lambda some: ~hit(some, inner) & (F.size(some) < more))
        return F.flatten(F.transform(missing, lambda some: F.transform(inner, lambda r: F.concat(some, F.array(r)))))

    def step(state: Column, path: Column) -> Column:
        inner = F.slice(path["ids"], F.lit(2), F.greatest(F.size(path["ids"]) - 2, F.lit(0)))
        hitting = state["hitting"]
        taken = F.struct(
            F.concat(F.filter(hitting, lambda some: hit(some, inner)), with_one_more(hitting, inner)).alias("hitting"),
            F.concat(state["kept"], F.array(path)).alias("kept"),
        )
        return F.when(F.exists(hitting, lambda some: ~hit(some, inner)), taken).otherwise(state)

    begin = F.struct(F.array(F.array()).cast(sets).alias("hitting"), F.array().cast(kept).alias("kept"))
    needed = F.aggregate("ordered", begin, step, lambda state: state["kept"])
    return grouped.select(*key, F.explode(needed).alias("w")).select(
        *[k for k in key if k != "roads"], *[f"w.{name}" for name in PATH]
    )


def path_facts(paths: DataFrame) -> DataFrame:
    """What the transition probability needs of each path; ``inner`` is the length without first and last road."""
    c = F.col
    inside = F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))
    return paths.select(
        "start_id",
        "end_id",
        "roads",
        F.aggregate("path", F.lit(0.0), lambda t, s: t + s["length"]).alias("whole"),
        F.aggregate(inside, F.lit(0.0), lambda t, s: t + s["length"]).alias("inner"),
        c("path")[0]["length"].alias("first_length"),
        F.element_at("path", -1)["length"].alias("last_length"),
        "first_at0",
        "last_at0",
    )


def measured_facts(paths: DataFrame, roads: DataFrame) -> DataFrame:
    """What the transition probability needs of each path where roads are measured along their pieces.

    ``exit_at`` is the place on the first road where the path leaves it, ``enter_at`` that on the last road where it
    arrives, ``inner`` what it drives on the roads in between, all in metres; a path of one road has only ``roads``.  Two
    roads meet at the node they share, at the one with the smallest id if there are several, and where a road passes it
    first.  Roads that share only nodes whose place is unknown are taken to meet at the end of the one and the start of the
    other.  ``roads`` has ``marks``.  Only pairs that occur in a path look up their node, so crowded nodes form no pairs.
    """
    c = F.col
    n = F.size("path.road")
    hop = F.arrays_zip(
        F.slice("path.road", F.lit(1), n - 1).alias("road"), F.slice("path.road", F.lit(2), n - 1).alias("then")
    )
    hops = paths.where(c("roads") > 1).select("start_id", "end_id", F.posexplode(hop).alias("pos", "hop"))
    hops = hops.select("start_id", "end_id", "pos", "hop.road", "hop.then")

    def marks(name: str) -> DataFrame:
        return roads.select(c("road_id").alias(name), c("marks").alias(f"{name}_marks"))

    def place(name: str):
        at_node = F.filter(f"{name}_marks", lambda m: m["node_id"] == c("node_id"))
        return F.array_min(F.transform(at_node, lambda m: m["at"]))

    joints = (
        hops.select("road", "then")
        .distinct()
        .join(marks("road"), "road")
        .join(marks("then"), "then")
        .withColumn("node_id", F.array_min(F.array_intersect("road_marks.node_id", "then_marks.node_id")))
        .select(
            "road",
            "then",
            F.coalesce(place("road"), F.element_at("road_marks", -1)["at"]).alias("out_at"),
            F.coalesce(place("then"), F.lit(0.0)).alias("in_at"),
        )
    )
    met = (
        hops.join(joints, ["road", "then"])
        .groupBy("start_id", "end_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "out_at", "in_at"))).alias("met"))
    )
    # On the road between two meetings: from where the first one enters it to where the second one leaves it.
    between = F.zip_with(
        F.slice("met", F.lit(1), F.size("met") - 1),
        F.slice("met", F.lit(2), F.size("met") - 1),
        lambda a, b: F.abs(b["out_at"] - a["in_at"]),
    )
    none = F.lit(None).cast("double")
    single = paths.where(c("roads") == 1).select(
        "start_id", "end_id", "roads", none.alias("inner"), none.alias("exit_at"), none.alias("enter_at")
    )
    return single.unionByName(
        met.select(
            "start_id",
            "end_id",
            (F.size("met") + 1).alias("roads"),
            F.aggregate(between, F.lit(0.0), lambda total, x: total + x).alias("inner"),
            c("met")[0]["out_at"].alias("exit_at"),
            F.element_at("met", -1)["in_at"].alias("enter_at"),
        )
    )
