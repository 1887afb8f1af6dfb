"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and connected components.

Each table cuts the space with random hyperplanes; vectors of one label with the same signs share a bucket.  How many
planes follows from the rows of the largest label, one more whenever they double, so that vectors spread evenly leave
about ``BUCKET`` to a bucket at any size.  The tables follow from that: two vectors at the threshold meet in none of them
with probability ``MISS`` at most.  At cosine 0.98 they agree in a bit with probability 0.936, which makes 10 tables of 5
bits for 8,000 rows, 31 of 17 bits for 32 million and 45 of 22 bits for a billion.  A label of ``BUCKET`` rows is one
bucket.

Equal vectors are merged first and counted, so copies are compared once.  A bucket of more than ``BLOCK`` vectors is
compared block against block, in as many tasks as it has pairs of blocks.  A pair that several tables find counts in
the first of them only: each vector carries its signs in all tables, so no pairs have to be written to find that out.
What leaves a comparison is, per vector, a number of links and one link to the smallest vector of its part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed
from roadtrace.llm.components import components

BUCKET = 256
MISS = 6e-6
# Codes are 32-bit numbers; a label of more than 5 * 10^11 rows has larger buckets, which are compared in blocks.
MOST_BITS = 31
BLOCK = 1024
SEED = 20
_KEY = ["label", "dim", "table", "code", "low", "high"]


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty, all finite and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def layout(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of tables, for the rows of the largest label."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if together == 1 else math.ceil(math.log(MISS) / math.log1p(-together))


def _coded(bits: int, tables: int):
    """Adds the code of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors, codes = batch.column("embedding"), np.zeros((len(batch), tables), np.int32)
            sizes = np.asarray(batch.column("dim"))
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
                rows = np.flatnonzero(sizes == dim)
                signs = _matrix(vectors.take(pa.array(rows))) @ planes[dim] > 0
                codes[rows] = signs.reshape(len(rows), tables, bits) @ weights
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(ends, pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    return run


def _parts(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix: the first row of its connected part."""
    part, n = np.arange(len(linked)), len(linked)
    while True:
        least = np.minimum(part, np.where(linked, part[None, :], n).min(axis=1))
        least = least[least]
        if (least == part).all():
            return part
        part = least


def _compared(threshold: float):
    """Per group of a sorted stream: links of each vector and the smallest vector of its part."""

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        ids = rows.column("id").combine_chunks()
        x = _matrix(rows.column("embedding").combine_chunks())
        table = rows.column("table")[0].as_py()
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        if low != high:
            block = rows.column("block").to_numpy()
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return None
        i, j = np.nonzero(linked)
        first = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
        copies = rows.column("copies").to_numpy()
        links = np.bincount(i[first], weights=copies[j[first]], minlength=len(rows)).astype(np.int64)
        order = np.asarray(pa.compute.sort_indices(ids))
        rank = np.argsort(order)
        part = order[_parts(linked[np.ix_(order, order)])][rank]
        some = np.flatnonzero(linked.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(some)), ids.take(pa.array(part[some])), pa.array(links[some])], ["id", "other", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = [held.column(k).to_numpy() for k in _KEY]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.concatenate([[0], change])
            # The last group may go on in the next batch; a group has two blocks at most.
            for start, end in zip(starts[:-1], starts[1:]):
                if end - start > 1 and (found := group(held.slice(start, end - start))) is not None:
                    yield found
            held = held.slice(starts[-1])
        if held is not None and len(held) > 1 and (found := group(held)) is not None:
            yield found

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links and components of vectors: one row per row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` (array of float or double) and ``label``; other columns are left out.
    Only vectors of equal label and length are compared.  Vectors that are null, empty, zero or hold null or
    non-finite numbers, and rows whose label or id is null, link with nothing.  Repeated rows are other vectors that
    link.  Rows that share an id but not the vector are one vector that links if any of them does.

    Columns: ``vec_id``, ``n_links``, ``component_id`` (the id itself if nothing links) and ``kept`` (is it the
    component's smallest id; true for null ids).
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    merged = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    plain = merged.select("id", F.xxhash64("label").alias("label"), "embedding", "copies", F.size("embedding").alias("dim"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    # One number: the rows of the largest label, copies included.
    rows_of = good.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    coded = checkpointed(plain.mapInArrow(_coded(*layout(rows_of or 0, threshold)), f"{kinds}, codes array<int>"))
    bucket = ["label", "dim", "table", "code"]
    placed = coded.select("*", F.posexplode("codes").alias("table", "code"))
    crowded = (
        placed.groupBy(*bucket)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .drop("n")
    )
    dealt = (
        placed.join(crowded, bucket)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "partner"), "high": F.greatest("block", "partner")})
        .select(*_KEY, "block", "id", "copies", "embedding", "codes")
        .repartition(*_KEY)
        .sortWithinPartitions(*_KEY)
    )
    id_type = plain.schema["id"].dataType.simpleString()
    found = checkpointed(dealt.mapInArrow(_compared(threshold), f"id {id_type}, other {id_type}, links long"))
    counts = found.groupBy(F.col("id").alias("_id")).agg(F.sum("links").alias("_links"))
    part = components(found, "id", "other").select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    repeated = merged.where(F.col("copies") > 1).select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), F.col("id").alias("_first"), "copies"
    )
    same = (
        F.col("vec_id").isNotNull()
        & (F.col("label") == F.col("_label"))
        & (F.col("embedding") == F.col("_embedding"))
    )
    first = F.coalesce("_first", "vec_id")
    return (
        rows.join(repeated, same, "left")
        .withColumn("_first", first)
        .join(counts, F.col("_first") == F.col("_id"), "left")
        .join(part, F.col("_first") == F.col("_node"), "left")
        .select(
            "vec_id",
            (F.coalesce("_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("_component", "_first").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
