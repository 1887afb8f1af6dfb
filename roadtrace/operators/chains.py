"""Entry and exit candidate of every time block, by a tree over the blocks of a trajectory.

A block is known by a small summary: for every candidate by which it can be entered, the best way to every candidate by
which it can be left (score, score with the emission at the end, rank among the entries on ties), or where that entry
breaks off, the best candidate there, and what comes out of the block after a restart.  Summaries of consecutive blocks
combine into one of the same size, and it does not matter in which order neighbours are combined: sums of whole numbers
and a total order of ways.  So up to ``FAN`` neighbours at a time become one node, in rounds, until a trajectory is one
node; then the scores at the entry of every node are handed down, and exits back, over the same rounds.  No group is ever
larger than ``FAN`` rows, whatever the length of a trajectory; the number of rounds grows with its logarithm.

An entry breaks off where no candidate can be reached.  For several entries at once the latest break counts, because a
chain only ends when the last of its candidates does; which entries those are is known on the way down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.staging import staged

# Blocks or nodes that are combined at once.
FAN = 8
# A place in a trajectory is the number of a block times this plus the number of points survived in it.
PLACES = 1 << 24

ENTRIES = (
    "array<struct<broke:bigint,stand:struct<score:bigint,x:int,rank:int>,"
    "ways:array<struct<score:bigint,final:bigint,rank:int>>>>"
)


class Passed(NamedTuple):
    """What comes out of a node: where the chain broke off (or null), the entry it came by, and (score, final, entry) by exit."""

    broke: int | None
    entry: int | None
    out: list[tuple[int, int, int] | None]


def passed(entries: list[dict], scores: list[int | None]) -> Passed:
    """A node entered with a score per entry; null where the entry cannot be reached."""
    alive = [m for m, s in enumerate(scores) if s is not None]
    through = [m for m in alive if entries[m]["broke"] is None]
    if through:
        out: list[tuple[int, int, int] | None] = []
        for x in range(max(len(entries[m]["ways"]) for m in through)):
            best = None
            for m in through:
                way = entries[m]["ways"][x]
                if way is not None:
                    option = (scores[m] + way["score"], -way["rank"], m, scores[m] + way["final"])
                    best = option if best is None else max(best, option)
            out.append(best and (best[0], best[3], best[2]))
        return Passed(None, None, out)
    if not alive:
        return Passed(None, None, [])
    broke = max(entries[m]["broke"] for m in alive)

    def stand(m: int) -> tuple:
        at = entries[m]["stand"]
        return scores[m] + at["score"], -at["x"], -at["rank"], m

    entry = max((m for m in alive if entries[m]["broke"] == broke), key=stand)
    return Passed(broke, entry, [w and (w["score"], w["final"], entry) for w in entries[entry]["ways"]])


def combined(a: list[dict], b: list[dict]) -> list[dict]:
    """The summary of two neighbours."""
    made: list[dict] = []
    places: list[Passed] = []
    for row in a:
        through = passed(b, [w and w["score"] for w in row["ways"]])
        places.append(through)
        broke, stand = row["broke"], row["stand"]
        if broke is None and through.broke is not None:
            broke, own = through.broke, b[through.entry]["stand"]
            stand = {"score": row["ways"][through.entry]["score"] + own["score"], "x": own["x"], "rank": 0}
        ways = [w and {"score": w[0], "final": w[1], "rank": 0} for w in through.out]
        made.append({"broke": broke, "stand": stand, "ways": ways})
    whole = [e for e, row in enumerate(made) if row["broke"] is None]
    for x in range(max((len(made[e]["ways"]) for e in whole), default=0)):
        reaching = [e for e in whole if made[e]["ways"][x] is not None]

        def later_first(e: int) -> tuple:
            m = places[e].out[x][2]
            return b[m]["ways"][x]["rank"], a[e]["ways"][m]["rank"], e

        for rank, e in enumerate(sorted(reaching, key=later_first)):
            made[e]["ways"][x]["rank"] = rank
    ended = [e for e, row in enumerate(a) if row["broke"] is None and made[e]["broke"] is not None]

    def stand_first(e: int) -> tuple:
        m = places[e].entry
        return b[m]["stand"]["rank"], a[e]["ways"][m]["rank"], e

    for rank, e in enumerate(sorted(ended, key=stand_first)):
        made[e]["stand"]["rank"] = rank
    _lowered([w for e in whole for w in made[e]["ways"] if w], ("score", "final"))
    for place in {made[e]["broke"] for e in ended}:
        _lowered([made[e]["stand"] for e in ended if made[e]["broke"] == place], ("score",))
    for row in made:
        if row["broke"] is not None:
            _lowered([w for w in row["ways"] if w], ("score", "final"))
    return made


def _lowered(values: list[dict], names: tuple[str, ...]) -> None:
    """Only differences are compared; without their common part, numbers stay small however long the trajectory."""
    if values:
        top = max(v["score"] for v in values)
        for v in values:
            for name in names:
                v[name] -= top


def handed_down(nodes: list[dict], scores: list[int | None], exit_: int | None, ends: bool) -> list[tuple]:
    """Per child (number, entry scores, exit, does the chain end there) of a node that is entered and left like this."""
    entered, through = [scores], []
    for node in nodes:
        through.append(passed(node["entries"], entered[-1]))
        known = [w and w[0] for w in through[-1].out]
        top = max((s for s in known if s is not None), default=0)
        entered.append([None if s is None else s - top for s in known])
    asked = []
    for node, own, went in zip(reversed(nodes), reversed(entered[:-1]), reversed(through)):
        asked.append((node["idx"], own, exit_, ends))
        if all(s is None for s in own):
            exit_, ends = None, False
        elif went.broke is None:
            exit_, ends = went.out[exit_][2], False
        else:
            # Broken off before the first point of the node: the chain ends with the node before.
            exit_, ends = went.entry, went.broke == node["first"] * PLACES
    return asked


def _by_row(make: Callable[[dict], Iterator[tuple[int, tuple]]], kept: list[str], made: dict[str, str]):
    """``mapInArrow`` function: for every row the tuples that ``make`` gives, with the ``kept`` columns of the row."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    way = pa.struct([("score", pa.int64()), ("final", pa.int64()), ("rank", pa.int32())])
    stand = pa.struct([("score", pa.int64()), ("x", pa.int32()), ("rank", pa.int32())])
    kinds[ENTRIES] = pa.list_(pa.struct([("broke", pa.int64()), ("stand", stand), ("ways", pa.list_(way))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.drop_columns(kept).to_pylist()
            found = [(i, values) for i, row in enumerate(rows) for values in make(row)]
            place = pa.array([i for i, _ in found], pa.int64())
            columns = [batch.column(k).take(place) for k in kept]
            columns += [pa.array([v[n] for _, v in found], kinds[kind]) for n, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    return run


def _mapped(df: DataFrame, make, kept: list[str], made: dict[str, str]) -> DataFrame:
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in kept] + [f"{k} {v}" for k, v in made.items()])
    return df.mapInArrow(_by_row(make, kept, made), schema)


def _combine(row: dict) -> Iterator[tuple]:
    nodes = row["nodes"]
    entries = nodes[0]["entries"]
    for node in nodes[1:]:
        entries = combined(entries, node["entries"])
    yield nodes[0]["first"], entries


def _root(row: dict) -> Iterator[tuple]:
    out = passed(row["entries"], [0]).out
    finals = [(w[1], -x) for x, w in enumerate(out) if w]
    yield [0], -max(finals)[1] if finals else None, False


def _hand_down(row: dict) -> Iterator[tuple]:
    yield from handed_down(row["nodes"], row["scores"], row["exit"], row["ends"])


def _settle(row: dict) -> Iterator[tuple]:
    went = passed(row["entries"], row["scores"])
    if all(s is None for s in row["scores"]):
        return
    entry = went.entry if went.broke is not None else went.out[row["exit"]][2]
    exit_ = row["exit"] if row["exit"] is not None else row["entries"][entry]["stand"]["x"]
    yield entry, exit_, row["ends"]


def chosen_blocks(blocks: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """``blocks`` has ``keys``, ``tblock`` and ``entries``, where a break is the number of points survived.

    One row per block that can be reached: ``keys``, ``tblock``, ``entry``, ``exit`` (candidate at its last point, or at
    the last one reached if nothing comes after) and ``ends`` (a chain ends at its last point because the next block
    begins with a restart).
    """
    c = F.col
    spans = blocks.groupBy(*keys).agg(F.min("tblock").alias("start"), F.max("tblock").alias("stop"))
    placed = F.transform(
        "entries",
        lambda e: F.struct((e["broke"] + c("tblock") * PLACES - c("start") * PLACES).alias("broke"), e["stand"], e["ways"]),
    )
    leaves = staged(
        blocks.join(spans, keys).select(
            *keys, "tblock", (c("tblock") - c("start")).alias("idx"), (c("stop") - c("start")).alias("last"),
            (c("tblock") - c("start")).alias("first"), placed.cast(ENTRIES).alias("entries"),
        )
    )
    longest = leaves.agg(F.max("last")).first()[0] or 0
    levels = [leaves]
    node = F.struct("idx", "first", "entries")
    while longest:
        longest //= fan
        grown = (
            levels[-1].where("last > 0")
            .groupBy(*keys, F.floor(c("idx") / fan).alias("above"), F.floor(c("last") / fan).alias("last"))
            .agg(F.array_sort(F.collect_list(node)).alias("nodes"))
            .withColumnRenamed("above", "idx")
        )
        made = _mapped(grown, _combine, [*keys, "idx", "last"], {"first": "bigint", "entries": ENTRIES})
        levels.append(staged(made.select(*keys, "idx", "last", "first", "entries")))
    asking = {"scores": "array<bigint>", "exit": "int", "ends": "boolean"}
    asked = None
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth].where("last = 0").select(*keys, "idx", "entries")
        roots = _mapped(own, _root, [*keys, "idx"], asking)
        if asked is None:
            asked = roots
            continue
        below = (
            levels[depth].where("last > 0")
            .groupBy(*keys, F.floor(c("idx") / fan).alias("idx"))
            .agg(F.array_sort(F.collect_list(node)).alias("nodes"))
        )
        handed = _mapped(asked.join(below, [*keys, "idx"]).drop("idx"), _hand_down, keys, {"idx": "bigint", **asking})
        asked = handed.unionByName(roots)
    settled = asked.join(leaves.select(*keys, "tblock", "idx", "entries"), [*keys, "idx"])
    return _mapped(
        settled.drop("idx"), _settle, [*keys, "tblock"], {"entry": "int", "exit": "int", "ends": "boolean"}
    )
