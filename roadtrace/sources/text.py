"""Comma-separated text whose last fields are JSON with commas of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadtrace.sources.readers import NODE_SCHEMA, TRAJECTORY_SCHEMA, WAY_SCHEMA
from roadtrace.staging import Written

SCHEMAS = {"ways": WAY_SCHEMA, "nodes": NODE_SCHEMA, "trajectories": TRAJECTORY_SCHEMA}

# Plain fields before the JSON part, and the shape of what follows them.
PLAIN_FIELDS = {"ways": 6, "nodes": 6, "trajectories": 8}
TAILS = {
    "ways": (r"^(\{.*\}),(\[[^\]]*\])$", ["tags", "nodes"]),
    "nodes": (r"^(\{.*\}),([^,]*),([^,]*)$", ["tags", "latitude", "longitude"]),
    "trajectories": (r"^(.*)$", ["geojson"]),
}


def _check_kind(kind: str) -> None:
    if kind not in SCHEMAS:
        raise ValueError(f"kind must be one of {sorted(SCHEMAS)}")


def load_text(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read ``ways``, ``nodes`` or ``trajectories`` text; see ``parse_text``."""
    _check_kind(kind)
    return parse_text(spark.read.text(path), kind)


class Counts:
    """What one pass over the lines met: lines read, lines with a fault, and faults per field.

    The numbers come from an ``Observation`` of ``checked_text``: they are there once its rows have been written or
    counted, and cost no pass of their own.
    """

    def __init__(self, kind: str):
        _check_kind(kind)
        self.names = [name for name, _ in _columns(kind)]
        self.observation = Observation()

    def measures(self) -> list[Column]:
        faulty = [F.count_if(F.array_contains("faults", name)).alias(name) for name in self.names]
        return [F.count(F.lit(1)).alias("lines"), F.count_if(F.size("faults") > 0).alias("faulty_lines"), *faulty]

    def get(self) -> dict[str, int]:
        return {name: int(value or 0) for name, value in self.observation.get.items()}


def _columns(kind: str) -> list[tuple[str, str]]:
    """Names and types of the columns."""
    plain = SCHEMAS[kind].replace("map<string,string>", "map<string;string>").split(",")
    return [(name, type_name.replace(";", ",")) for name, type_name in (c.strip().split(" ", 1) for c in plain)]


def _fields(lines: DataFrame, kind: str) -> DataFrame:
    """Lines (``value``) that are neither empty nor a header, split into ``f``: plain fields, then the rest in one."""
    _check_kind(kind)
    rows = lines.where(F.length("value") > 0).select("value", F.split("value", ",", PLAIN_FIELDS[kind] + 1).alias("f"))
    # Only a header has the column name itself, with or without the table name, as its first field.
    return rows.where(~F.col("f")[0].rlike(rf"^([^.]+\.)?{_columns(kind)[0][0]}$"))


def _raw_and_parsed(kind: str) -> list[tuple[str, Column, Column]]:
    """Per column its name, its text (null if there is none) and its value (null if the text does not parse)."""
    plain = PLAIN_FIELDS[kind]
    pattern, _ = TAILS[kind]
    tail = F.get("f", F.lit(plain))
    found = []
    for n, (name, type_name) in enumerate(_columns(kind)):
        raw = F.get("f", F.lit(n)) if n < plain else F.regexp_extract(tail, pattern, n - plain + 1)
        nested = type_name.startswith(("map", "array"))
        found.append((name, raw, F.from_json(raw, type_name) if nested else raw.try_cast(type_name)))
    return found


def parse_text(lines: DataFrame, kind: str) -> DataFrame:
    """Lines of text (column ``value``) to rows; a header line is dropped if there is one.

    Values that do not parse become null, as in any delimited table; ``checked_text`` says which these were.
    """
    return _fields(lines, kind).select(*[value.alias(name) for name, _, value in _raw_and_parsed(kind)])


def checked_text(lines: DataFrame, kind: str, counts: Counts | None = None) -> DataFrame:
    """The rows of ``parse_text`` with two more columns: the line (``value``) and ``faults``.

    ``faults`` names the columns, in their order, without a value: the text is missing or does not parse (an empty text is a
    value of a string column only).  It is empty for a good line.  ``counts`` collects how many there were, in the same
    pass.  An empty line is no line, a header neither.
    """
    columns = _raw_and_parsed(kind)
    rows = _fields(lines, kind).select("value", *[value.alias(name) for name, _, value in columns])
    faults = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name, _, _ in columns]))
    checked = rows.withColumn("faults", faults).select(*[name for name, _, _ in columns], "value", "faults")
    return checked if counts is None else checked.observe(counts.observation, *counts.measures())


def write_checked_text(lines: DataFrame, kind: str, table: str) -> dict[str, int]:
    """Good lines replace ``table``, faulty ones (``value``, ``faults``) ``<table>_rejects``; returns the counts.

    The lines are read and parsed once, into the shared folder; both tables are made from there.
    """
    counts = Counts(kind)
    interim = Written(checked_text(lines, kind, counts))
    good = F.size("faults") == 0
    interim.read().where(good).drop("value", "faults").write.mode("overwrite").saveAsTable(table)
    interim.read().where(~good).select("value", "faults").write.mode("overwrite").saveAsTable(f"{table}_rejects")
    interim.remove()
    return counts.get()
