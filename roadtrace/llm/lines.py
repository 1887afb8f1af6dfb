"""Lines that many documents repeat, found with levelled sorted runs of line hashes.

The store of known lines is a set of runs.  A run is a table with one row per line hash, bucketed and sorted by it:
how many documents hold the line, and the document that keeps it.  A new batch of documents becomes a run of level 0:
it is merged against the older runs by anti-joins, bucket by bucket and without a shuffle, and only lines that no older
run holds get a keeper from the batch; the others only add to the count.  When a level has ``fanout`` runs, they are
merged into one run of the next level, so every hash is rewritten once per level.

``repeated_lines_dropped`` feeds the documents in batches of descending ids, so that the first batch with a line holds the
largest id with it.  A line that enough documents hold is then dropped wherever it is not kept.  Only hashes (128 bits)
move between tasks; texts move once, to meet the hashes that they lose.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed
from roadtrace.staging import Written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2

BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    """Without blanks at both ends, A-Z in lower case; all else as it is."""
    return line.strip(BLANKS).translate(_LOWER)


def _hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the key of a line; null for keys of fewer than ``min_chars`` code points."""
    if len(line) < min_chars:
        return None
    key = line_key(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id``, ``text_key`` and ``line``: the different long lines of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                if text.is_valid:
                    own = {_hash(line, min_chars) for line in text.as_py().split(b"\n")} - {None}
                    owners += [i] * len(own)
                    found += own
            rows = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(found, pa.binary())],
                ["doc_id", "text_key", "line"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, line binary")


class LineRuns:
    """Runs by level.  ``add`` takes a batch, ``totals`` reads what is known, ``drop`` removes all tables."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        """The number of buckets is that of shuffle partitions, so that what an aggregation shuffled is a bucket."""
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _table(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        before = self.spark.conf.get(_IN_ORDER)
        # Runs are read in their order, so that merging does not sort them again.
        self.spark.conf.set(_IN_ORDER, "true")
        try:
            rows.write.bucketBy(self.buckets, "line").sortBy("line").saveAsTable(name)
        finally:
            self.spark.conf.set(_IN_ORDER, before)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """A batch as one row (``doc_id``, ``line``) per document and line.  Lines of earlier batches stay with them.

        A new line is kept by the largest ``doc_id`` of its batch.  Rows without an id count, but keep no line.
        """
        own = lines.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        name = self._table(own)
        if older := self._runs():
            batch = self.spark.table(name)
            fresh = batch
            for run in older:
                fresh = fresh.join(self.spark.table(run).select("line"), "line", "left_anti")
            known = batch.join(fresh.select("line"), "line", "left_anti")
            unkept = known.withColumn("keeper", F.lit(None).cast(batch.schema["keeper"].dataType))
            merged = self._table(fresh.unionByName(unkept))
            self._drop([name])
            name = merged
        self._place(name, 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._table(self._merged(runs))
            self._drop(runs)
            self._place(merged, level + 1)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Full outer merge joins: two runs need no shuffle.  (An aggregation of their union is planned without one as
        well, but does not always bring equal buckets together.)"""
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).select("line", F.col("n_docs").alias("more_docs"), F.col("keeper").alias("other_keeper"))
            rows = rows.join(other, "line", "full").select(
                "line",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
                # One of them at most is known: a line has one batch that keeps it.
                F.coalesce("keeper", "other_keeper").alias("keeper"),
            )
        return rows

    def totals(self) -> DataFrame | None:
        """``line``, ``n_docs`` and ``keeper`` over all batches; None before the first one.  Read it before ``drop``."""
        runs = self._runs()
        return self._merged(runs) if runs else None

    def drop(self) -> None:
        self._drop(self._runs())
        self.levels = []


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of similar size; any bounds give the same result."""
    found = docs.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [k / batches for k in range(1, batches)], 0.01
    ) if batches > 1 else []
    return sorted({int(x) for x in found})


def repeated_lines_dropped(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Texts without the lines that many documents repeat: one row per row of ``docs``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``; other columns, whatever their names, are left out.  A text is
    split at line feeds; a null or empty text is one empty line.  Lines count as equal if their keys are (blanks at both
    ends removed, A-Z in lower case).  Keys of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold lose all their lines but those of the largest ``doc_id`` that holds them.  Texts are read whole, however long.

    A document is a row: repeated rows count each, and all rows of the largest id keep the line.  Rows without an id count
    and never are the largest; where no row with an id holds a line, nobody loses it.  An empty table gives none.

    Columns: ``doc_id``, ``text`` (what stays, joined by line feeds), ``n_lines`` (before), ``n_dropped``.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs, batches)
    # Batch 0 has the largest ids; rows without an id come last.  The largest bound is asked first.
    batch = F.when(F.col("doc_id").isNotNull(), len(bounds)).otherwise(len(bounds) + 1)
    for k, bound in enumerate(bounds):
        batch = F.when(F.col("doc_id") >= bound, len(bounds) - 1 - k).otherwise(batch)
    lines = Written(_hashes(docs, min_chars).withColumn("batch", batch.cast("int")), partition_by=["batch"])
    runs = LineRuns(spark, fanout)
    for k in sorted(r["batch"] for r in lines.read().select("batch").distinct().collect()):
        runs.add(lines.read().where(F.col("batch") == k).drop("batch"))
    totals = runs.totals()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if totals is None:
        lost = spark.createDataFrame([], f"lost_id {kind}, lost_key long, lost array<binary>")
    else:
        common = checkpointed(totals.where((F.col("n_docs") >= min_docs) & F.col("keeper").isNotNull()).drop("n_docs"))
        loses = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper"))
        lost = checkpointed(
            lines.read()
            .join(common, "line")
            .where(loses)
            .groupBy(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"))
            .agg(F.collect_set("line").alias("lost"))
        )
    runs.drop()
    lines.remove()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (text, gone) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("lost"))):
                parts = (text.as_py() or b"").split(b"\n")
                before[i] = len(parts)
                if gone.is_valid:
                    known = set(gone.as_py())
                    parts = [p for p in parts if _hash(p, min_chars) not in known]
                    dropped[i] = before[i] - len(parts)
                texts.append(b"\n".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).view(pa.string()), pa.array(before), pa.array(dropped)],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key"))
    return (
        keyed.join(lost, same, "left")
        .select("doc_id", "text", "lost")
        .mapInArrow(cut, f"doc_id {kind}, text string, n_lines long, n_dropped long")
    )
