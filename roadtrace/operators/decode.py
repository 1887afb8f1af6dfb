"""Most likely road of every point (Viterbi decoding), in time blocks.

A trajectory is cut into time blocks.  Inside a block a fold keeps, for each possible entry candidate, the best
score of every candidate reached and where it came from.  Blocks of one trajectory then meet as small matrices
(at most alpha x alpha numbers each), a few at a time (``chains``), to choose entry and exit of every block, and each
block reads off its own part.  Scores are whole numbers and ties go to the smaller candidate of the later point first,
so the outcome is the same as for one pass over the whole trajectory.  Trajectories inside one block, the usual
case, skip the middle step.

Where no candidate of a point can be reached, the chain breaks off.  Without ``restart`` all that follows has no road;
with it a new chain begins at that point, with all its candidates.

A score and the candidate it came from share one number: score * width + (width - 1 - candidate), where width is
a power of two above alpha.  The largest of these numbers is the best score, and the first candidate on ties.  The last
part, 0, says that a chain begins here.
The score of a candidate leaves out its own emission, which is part of every move out of it instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.operators.candidates import BLOCK
from roadtrace.operators.chains import ENTRIES, chosen_blocks
from roadtrace.operators.transitions import KEYS, ORDER, scored
from roadtrace.params import MatchParams
from roadtrace.staging import staged


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _positions(array: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    return F.transform(array, lambda _, pos: pos)


def _width(p: MatchParams) -> int:
    return 1 << p.alpha.bit_length()


def _score(packed: Column, width: int) -> Column:
    """The score part, still times ``width``."""
    return packed.bitwiseAND(F.lit(-width).cast("bigint"))


def _origin(packed: Column, width: int) -> Column:
    """The candidate part."""
    return (width - 1 - packed.bitwiseAND(F.lit(width - 1).cast("bigint"))).cast("int")


def block_steps(moves: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """One row per (trajectory, block) with its points in order.

    A point holds its candidates; each has its emission and the moves ``into`` it, by candidate of the point
    before.  A block has at most one point per second, a point at most alpha x alpha moves.
    """
    c = F.col
    width = _width(p)
    origin = F.coalesce(c("k") - 1, F.lit(0))
    rows = scored(moves).withColumns(
        {
            "move": (c("prev_emit") + c("move")) * width + (width - 1 - origin),
            "emit": c("emit") * width,
            "prev_emit": c("prev_emit") * width,
        }
    )
    move = F.struct("i", "k", "road_id", "prev_id", "emit", "prev_emit", "move")
    per_point = (
        rows.groupBy(*BLOCK, *ORDER, "is_last", "prev_timest")
        .agg(F.array_sort(F.collect_list(move)).alias("moves"), F.max("i").alias("n"))
        .withColumn("m", (F.size("moves") / c("n")).cast("int"))
        .withColumn(
            "cands",
            F.transform(
                F.sequence(F.lit(0), c("n") - 1),
                lambda i: _bind(
                    F.slice("moves", i * c("m") + 1, c("m")),
                    lambda own: F.struct(
                        own[0]["road_id"].alias("road_id"), own[0]["emit"].alias("emit"), own["move"].alias("into")
                    ),
                ),
            ),
        )
        .withColumn("origins", F.slice("moves", F.lit(1), c("m")))
        .withColumns({"from_ids": c("origins.prev_id"), "from_emits": c("origins.prev_emit")})
    )
    step = F.struct(*ORDER, "is_last", "prev_timest", "from_ids", "from_emits", "cands")
    return per_point.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def _fresh(point: Column, width: int) -> Column:
    """Does a chain begin at this point of a fold?"""
    return F.exists(point, lambda b: b.isNotNull() & (b.bitwiseAND(F.lit(width - 1).cast("bigint")) == 0))


def _forward(steps: Column, entries: Column, entry: Column, width: int, restart: bool) -> Column:
    """Fold over the points of a block, entered at one candidate.

    The result has one array before the first and one after each point, with the packed number of each
    candidate, null where it cannot be reached.  The state is that growing list and nothing else, so a step
    copies references only.
    """
    nothing = F.lit(0).cast("bigint")
    start = F.transform(_positions(entries), lambda e: F.when(e == entry, nothing))

    def reached_or_new(reached: Column) -> Column:
        if not restart:
            return reached
        return _bind(
            reached,
            lambda own: F.when(F.exists(own, lambda b: b.isNotNull()), own).otherwise(F.transform(own, lambda _: nothing)),
        )

    return F.aggregate(
        steps,
        F.array(start),
        lambda reached, point: F.concat(
            reached,
            F.array(
                reached_or_new(
                    F.transform(
                        point["cands"]["into"],
                        lambda into: F.array_max(
                            F.zip_with(F.element_at(reached, -1), into, lambda s, m: _score(s, width) + m)
                        ),
                    )
                )
            ),
        ),
    )


def _survived(reached: Column, width: int, restart: bool) -> Column:
    """Number of points until no candidate can be reached."""
    if restart:
        first = F.get(F.filter(_positions(reached), lambda j: (j > 0) & _fresh(F.get(reached, j), width)), F.lit(0))
        return F.coalesce(first, F.size(reached)) - 1
    return F.size(F.filter(reached, lambda point: F.exists(point, lambda b: b.isNotNull()))) - 1


def _emissions(steps: Column, n: Column) -> Column:
    """Emissions of the candidates of the n-th point; of the point before the block if n is 0."""
    return F.when(n > 0, F.get(steps, n - 1)["cands"]["emit"]).otherwise(steps[0]["from_emits"])


def _walk(reached: Column, n: Column, exit_: Column, width: int) -> Column:
    """Candidates from ``exit_`` at the n-th point back to the entry, latest first, within one chain."""
    return F.aggregate(
        F.reverse(F.slice(reached, F.lit(2), n)),
        F.array(exit_),
        lambda way, point: F.concat(way, F.array(_origin(F.get(point, F.element_at(way, -1)), width))),
    )


def _walk_chains(steps: Column, reached: Column, n: Column, exit_: Column, width: int) -> Column:
    """The same over several chains: an earlier one is left at its best candidate."""
    points = F.transform(
        F.slice(reached, F.lit(2), n),
        lambda point, j: F.struct(
            point.alias("at"),
            F.when(_fresh(point, width), _first_best(_finals(steps, reached, j, width))).alias("left"),
        ),
    )
    return F.aggregate(
        F.reverse(points),
        F.array(exit_),
        lambda way, p: F.concat(
            way, F.array(F.coalesce(p["left"], _origin(F.get(p["at"], F.element_at(way, -1)), width)))
        ),
    )


def _finals(steps: Column, reached: Column, n: Column, width: int) -> Column:
    """Scores of the candidates of the n-th point with their emissions, null where they cannot be reached."""
    return F.zip_with(F.get(reached, n), _emissions(steps, n), lambda b, emit: _score(b, width) + emit)


def _first_best(scores: Column) -> Column:
    """Position of the highest score, the first one on ties."""
    return -F.array_max(
        F.filter(
            F.transform(scores, lambda s, x: F.struct(s.alias("s"), (-x).alias("minus"))), lambda o: o["s"].isNotNull()
        )
    )["minus"]


def _states(steps: Column, reached: Column, exit_: Column, width: int, restart: bool) -> Column:
    """Chosen candidates of the points of a block, in time order, as far as they can be reached."""
    if restart:
        n = F.size(reached) - 1
        return F.reverse(F.slice(_walk_chains(steps, reached, n, exit_, width), F.lit(1), n))
    return _bind(
        _survived(reached, width, restart),
        lambda n: F.reverse(F.slice(_walk(reached, n, exit_, width), F.lit(1), n)),
    )


def _begins(reached: Column, width: int) -> Column:
    """Of each point of a block: does a chain begin there after a break?"""
    return F.transform(F.slice(reached, F.lit(2), F.size(reached) - 1), lambda point: _fresh(point, width))


def block_runs(steps: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """The fold of every block from every possible entry; finished at once where the block is a trajectory."""
    c = F.col
    width = _width(p)
    entries = c("steps")[0]["from_ids"]
    whole = c("steps")[0]["prev_timest"].isNull() & F.element_at("steps", -1)["is_last"]
    runs = steps.withColumn("whole", whole).withColumn(
        "runs", F.transform(_positions(entries), lambda e: _forward(c("steps"), entries, e, width, p.restart))
    )
    only = c("runs")[0]
    last = F.size(only) - 1 if p.restart else _survived(only, width, False)
    finals = _bind(last, lambda n: _finals(c("steps"), only, n, width))
    done = F.when(
        c("whole"), _bind(_first_best(finals), lambda x: _states(c("steps"), only, x, width, p.restart))
    )
    begins = F.when(c("whole"), _begins(only, width)) if p.restart else F.lit(None).cast("array<boolean>")
    return runs.withColumns({"states": done, "begins": begins}).withColumn("runs", F.when(~c("whole"), c("runs")))


def _block_matrices(runs: DataFrame, width: int, restart: bool) -> DataFrame:
    """Summaries of the blocks of longer trajectories, as ``chains`` combines them: per entry the ways to all exits, or
    where it breaks off, the best candidate there and the ways after a restart."""
    c = F.col
    parts = (
        runs.where(~c("whole"))
        .select(*BLOCK, "steps", "runs", F.transform("runs", lambda r: _survived(r, width, restart)).alias("ns"))
        .withColumn(
            "walks",
            F.transform(
                "runs",
                lambda r, e: F.transform(
                    F.get(r, c("ns")[e]),
                    lambda b, x: F.when(b.isNotNull(), _walk(r, c("ns")[e], x, width)),
                ),
            ),
        )
    )

    def rank_of(e: Column, x: Column, way: Column) -> Column:
        """How many entries have a smaller way to the same exit; only used to break ties."""
        mine = F.struct(way.alias("way"), e.alias("e"))
        others = F.transform(
            "walks",
            lambda w, f: F.when(
                (c("ns")[f] == c("ns")[e]) & F.get(w, x).isNotNull(),
                F.struct(F.get(w, x).alias("way"), f.alias("e")) < mine,
            ),
        )
        return F.size(F.filter(others, lambda smaller: smaller))

    def ways_at(r: Column, n: Column, rank: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.get(r, n),
            lambda b, x: F.when(
                b.isNotNull(),
                F.struct(
                    _score(b, width).alias("score"),
                    (_score(b, width) + F.get(_emissions(c("steps"), n), x)).alias("final"),
                    rank(x).alias("rank"),
                ),
            ),
        )

    size = F.size("steps")
    entries = F.transform(
        F.transform(
            "runs",
            lambda r, e: F.struct(
                c("ns")[e].alias("n"),
                ways_at(r, c("ns")[e], lambda x: rank_of(e, x, F.get(c("walks")[e], x))).alias("ways"),
                (ways_at(r, size, lambda _: F.lit(0)) if restart else F.array()).alias("after"),
            ),
        ),
        lambda s: F.struct(
            F.when(s["n"] < size, s["n"].cast("bigint")).alias("broke"),
            F.when(
                s["n"] < size,
                _bind(
                    _first_best(s["ways"]["final"]),
                    lambda x: F.struct(
                        F.get(s["ways"], x)["final"].alias("score"), x.alias("x"), F.get(s["ways"], x)["rank"].alias("rank")
                    ),
                ),
            ).alias("stand"),
            F.when(s["n"] == size, s["ways"]).otherwise(s["after"]).alias("ways"),
        ),
    )
    return parts.select(*BLOCK, entries.cast(ENTRIES).alias("entries"))


def choose_blocks(runs: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """Entry and exit candidate of every block of the trajectories that span several blocks."""
    return chosen_blocks(_block_matrices(runs, _width(p), p.restart), KEYS)


def decode(moves: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """The matched road of each point, with the matched road and time of the point before.

    If at some point no candidate can be reached, that point and all later ones of the trajectory get none.  With
    ``restart`` a new chain begins there instead: its first point has no road before it (``prev_id``), and the last point
    of the chain before counts as last (``is_last``), so that the route ends with its road.
    """
    c = F.col
    width = _width(p)
    runs = staged(block_runs(block_steps(moves, p), p))
    carried = [*BLOCK, "steps", "states", "begins", "entry", "ends"]
    whole = runs.where(c("whole")).withColumns({"entry": F.lit(0), "ends": F.lit(False)}).select(*carried)
    run = F.get("runs", c("entry"))
    cut = (
        runs.where(~c("whole"))
        .drop("states", "begins")
        .join(choose_blocks(runs, p), BLOCK)
        .withColumns({
            "states": _states(c("steps"), run, c("exit"), width, p.restart),
            "begins": _begins(run, width) if p.restart else F.lit(None).cast("array<boolean>"),
        })
        .select(*carried)
    )
    chosen = whole.unionByName(cut)
    place = F.col("at")
    step, before = F.get("steps", place), F.get("steps", place - 1)
    before_id = F.when(place == 0, F.get(step["from_ids"], c("entry"))).otherwise(
        F.get(before["cands"], F.get("states", place - 1))["road_id"]
    )
    last = step["is_last"]
    if p.restart:
        before_id = F.when(~F.get("begins", place), before_id)
        last = last | F.coalesce(F.get("begins", place + 1), c("ends"))
    return (
        chosen.select(*carried, F.posexplode("states").alias("at", "state"))
        .select(
            *KEYS,
            step["timest"].alias("timest"),
            step["latitude"].alias("latitude"),
            step["longitude"].alias("longitude"),
            F.get(step["cands"], c("state"))["road_id"].alias("road_id"),
            step["prev_timest"].alias("prev_timest"),
            before_id.alias("prev_id"),
            last.alias("is_last"),
        )
    )
