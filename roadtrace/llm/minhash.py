"""Near-duplicate documents by BagMinHash signatures, banding, and exact multiset overlap.

A document is the multiset of its runs of five words.  Similarity is the weighted Jaccard index of two multisets:
sum of the smaller counts over sum of the larger ones.

Signature.  The weights of an element are discretised at 1, 2, 4, 8, ...: the range up to its count is covered by the
intervals [0,1), [1,2), [2,4), ...  Each interval of each element has its own Poisson process, seeded by element and
interval, so that all documents see the same points.  A point has a time, a component of the signature, and a level
within the interval; it counts if its level lies below the count.  A component holds the time of its first point over
all elements.  Two documents agree in a component with a probability equal to their similarity.  Points are made in
the order of time up to a horizon by which a signature is expected to be full, and the few documents that are not
full by then get twice the time; so the work per document is the same for any number of words but for one draw each.

Search.  Equal texts are one text.  Signatures are cut into bands; texts that share a band share a bucket.  No pairs of
a bucket are formed at first: every text is compared with the text it shares most buckets with as their smallest.
In buckets whose texts are not all connected by then, texts are compared with one of the bucket's.  Where that leaves a
bucket in parts, texts outside its smallest part (strays) are compared with all texts of other parts, block by block inside
tasks; only links come out.  For that a stray has one home, the largest of its buckets, and a text that shares any bucket
with it goes to that home once, however many buckets they share.  So every pair that shares a bucket is compared or
connected, and what is written grows with the texts, not with their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import Cached, checkpointed, group_sums, lengths_to_bounds
from roadtrace.llm.components import components
from roadtrace.staging import Written

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
SIMILAR = 0.8
# 24 bands of 5: two texts at similarity 0.8 share a bucket with probability 0.99993.
BANDS, BAND_SIZE = 24, 5
SIZE = BANDS * BAND_SIZE
REMEMBERED = 50_000
# Texts of a block when the parts of a bucket are compared.
BLOCK = 256
# Characters of texts that are taken together.
PASS = 500_000

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_word = Cached(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")), REMEMBERED)


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * _A
        z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` words of a whole text, as sorted 64-bit hashes, and their counts.

    Words are runs of letters and digits, lower-cased.  Fewer words than ``size`` are one run; none give none.
    """
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.fromiter((_word[w] for w in words), dtype=np.uint64, count=len(words))
    run = min(size, len(words))
    made = np.full(len(codes) - run + 1, run, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            made = made * _C + codes[k : len(codes) - run + 1 + k]
    made = np.sort(_mixed(made))
    starts = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
    return made[starts], np.diff(starts, append=len(made))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two results of ``shingles``; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    place = np.searchsorted(a[0], b[0])
    place[place == len(a[0])] = 0
    common = a[0][place] == b[0]
    shared = int(np.minimum(a[1][place[common]], b[1][common]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Signature of each bag of (hashes, counts); infinite for empty bags."""
    times = np.full((len(bags), SIZE), np.inf)
    sizes = np.array([len(h) for h, _ in bags], dtype=np.int64)
    weight = np.array([c.sum() for _, c in bags], dtype=float)
    todo = np.flatnonzero(sizes > 0)
    # Points that fill all components but with a chance of one in twenty.
    spread = SIZE * (np.log(SIZE) + 3.0)
    while len(todo):
        hashes = np.concatenate([bags[i][0] for i in todo])
        counts = np.concatenate([bags[i][1] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        until = (spread / np.maximum(weight, 1.0))[owner]
        _first_times(times, _mixed(hashes), owner, until)
        longer: list[tuple[np.ndarray, ...]] = []
        low, high = 1, 2
        while (counts > low).any():
            more = counts > low
            hashes, counts, owner, until = hashes[more], counts[more], owner[more], until[more]
            with np.errstate(over="ignore"):
                seed = _mixed(hashes + np.array([low], np.uint64) * _C)
            length = np.full(len(hashes), float(high - low))
            longer.append((seed, owner, until, length, np.minimum(counts, high) - low))
            low, high = high, 2 * high
        if longer:
            _first_times(times, *map(np.concatenate, zip(*longer)))
        todo = todo[np.isinf(times[todo]).any(axis=1)]
        spread *= 2
    return times


def _first_times(
    times: np.ndarray,
    seed: np.ndarray,
    owner: np.ndarray,
    until: np.ndarray,
    length: np.ndarray | None = None,
    covered: np.ndarray | None = None,
) -> None:
    """Runs the process of each interval up to its horizon and keeps the first time per component.

    ``covered`` is the part of each interval below the count.  Without lengths all are 1 and covered.
    """
    flat = times.reshape(-1)
    base = owner * SIZE
    now = np.zeros(len(seed))
    while len(seed):
        with np.errstate(over="ignore"):
            seed = seed + _C
        draw = _mixed(seed)
        step = np.log(((draw >> np.uint64(24)) + np.uint64(1)) * 2.0**-40)
        now = now - (step if length is None else step / length)
        alive = now <= until
        seed, base, until, now, draw = seed[alive], base[alive], until[alive], now[alive], draw[alive]
        place = base + ((draw & np.uint64(0xFFFFFF)) * np.uint64(SIZE) >> np.uint64(24)).astype(np.int64)
        if length is None:
            np.minimum.at(flat, place, now)
        else:
            length, covered = length[alive], covered[alive]
            counted = (_mixed(draw) >> np.uint64(11)) * 2.0**-53 * length < covered
            np.minimum.at(flat, place[counted], now[counted])


def bands(times: np.ndarray) -> np.ndarray:
    """One hash per band of each signature."""
    bits = times.view(np.uint64).reshape(len(times), BANDS, BAND_SIZE)
    made = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND_SIZE):
            made = _mixed(made + bits[:, :, k]) + _C
    return made.view(np.int64)


def _bands_of(text: Column) -> Column:
    """Bands of each text as an array; null for texts without words."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        result: list[np.ndarray | None] = [None] * len(texts)
        start = 0
        while start < len(texts):
            bags, place, held = [], [], 0
            while start < len(texts) and (not bags or held < PASS):
                held += len(texts.iloc[start] or "")
                bag = shingles(texts.iloc[start])
                if len(bag[0]):
                    bags.append(bag)
                    place.append(start)
                start += 1
            if bags:
                for i, made in zip(place, bands(signatures(bags))):
                    result[i] = made
        return pd.Series(result)

    return of(text)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough.  Texts meet by key; large groups may be split."""
    kind = texts.schema["id"].dataType.simpleString()
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            good = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                one = text_a[i].as_py()
                if one != last:
                    last, held = one, shingles(one)
                good[i] = similarity(held, shingles(text_b[i].as_py())) >= SIMILAR
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _links_of(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Rows of one block of strays and one block of members: a link from a stray to each other part that has one."""
    stray = rows.column("stray").to_numpy()
    bags = [shingles(t) for t in rows.column("text").to_pylist()]
    part = rows.column("part").combine_chunks().dictionary_encode().indices.to_numpy().copy()
    own = rows.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
    codes = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), BANDS)
    weight = np.array([c.sum() for _, c in bags])
    members, left, right = np.flatnonzero(~stray), [], []
    for i in np.flatnonzero(stray):
        shared = (codes[members] == codes[i]).any(axis=1)
        light = np.minimum(weight[members], weight[i]) >= SIMILAR * np.maximum(weight[members], weight[i])
        others = members[shared & light & (part[members] != part[i]) & (own[members] != own[i])]
        if not len(others):
            continue
        hashes, counts = np.concatenate([bags[j][0] for j in others]), np.concatenate([bags[j][1] for j in others])
        place = np.minimum(np.searchsorted(bags[i][0], hashes), len(bags[i][0]) - 1)
        common = np.where(bags[i][0][place] == hashes, np.minimum(bags[i][1][place], counts), 0)
        common = group_sums(common, lengths_to_bounds(len(bags[j][0]) for j in others))
        near = others[common / (weight[others] + weight[i] - common) >= SIMILAR]
        for j in near:
            if part[j] != part[i]:
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return left, right


def _linked_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of a stream that is sorted by bucket and blocks."""
    held: pa.Table | None = None

    def links(rows: pa.Table) -> pa.RecordBatch:
        left, right = _links_of(rows)
        ids = rows.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))], ["a", "b"]
        )

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = [held.column(k).to_numpy() for k in ("band", "code", "strays", "members")]
        starts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1])
        for start, end in zip(starts[:-1], starts[1:]):
            yield links(held.slice(start, end - start))
        held = held.slice(starts[-1])
    if held is not None:
        yield links(held)


def _located(members: DataFrame, links: DataFrame) -> Written:
    """Members of buckets that hold texts of several parts, with their part and the bucket's smallest one."""
    parts = components(links, "a", "b").withColumnRenamed("node", "id")
    located = Written(
        members.join(parts, "id", "left").select("band", "code", "id", F.coalesce("component", "id").alias("part"))
    )
    mixed = (
        located.read().groupBy("band", "code")
        .agg(F.min("part").alias("main"), F.max("part").alias("most"), F.count("*").alias("n"))
        .where(F.col("main") != F.col("most"))
        .drop("most")
    )
    found = Written(located.read().join(mixed, ["band", "code"]))
    located.remove()
    return found


def _between_parts(open_members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between parts of a bucket, found by comparing every text outside the main part with all others.

    A bucket's homes are few, because its strays choose the largest of their buckets.
    """
    strays = open_members.where(F.col("part") != F.col("main"))
    bucket = F.struct("band", "code")
    home = strays.groupBy("id", "part").agg(F.max_by(bucket, F.struct("n", "band", "code")).alias("home"))
    homes = (
        strays.select("band", "code", "id").join(home.select("id", "home"), "id")
        .groupBy("band", "code").agg(F.collect_set("home").alias("homes"))
    )
    reached = (
        open_members.select("band", "code", "id", "part").join(homes, ["band", "code"])
        .groupBy("id", "part").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
        .select("id", "part", F.explode("homes").alias("home"))
    )
    placed = checkpointed(
        reached.withColumn("stray", F.lit(False)).unionByName(home.select("id", "part", "home", F.lit(True).alias("stray")))
    )
    sizes = placed.groupBy("home").agg(
        F.ceil(F.count_if(~F.col("stray")) / BLOCK).alias("n"), F.ceil(F.count_if("stray") / BLOCK).alias("k")
    )
    # A member meets all blocks of strays, a stray all blocks of members.
    own = F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("k")).otherwise(F.col("n")))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("stray"), F.col("n")).otherwise(F.col("k")) - 1))
    dealt = placed.join(sizes, "home").withColumns({"own": own, "met": met}).select(
        "home.band", "home.code", "id", "part", "stray",
        F.when(F.col("stray"), F.col("own")).otherwise(F.col("met")).alias("strays"),
        F.when(F.col("stray"), F.col("met")).otherwise(F.col("own")).alias("members"),
    )
    order = ["band", "code", "strays", "members"]
    rows = dealt.join(texts, "id").repartition(*order).sortWithinPartitions(*order, "stray", "id")
    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_linked_in_blocks, f"a {kind}, b {kind}")


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """Class of every document: one row per row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left out.  Equal texts (empty ones too) share a class, and
    so do texts at a similarity of ``SIMILAR`` or more, and what such links connect.  Texts without words are similar
    to none.  Null texts and rows without an id are alone.  Repeated rows are equal texts; rows that share an id but
    not the text are one document.

    Columns: ``doc_id``, ``text_key`` (md5 of the text; null for null), ``class_id`` (smallest id of the class) and
    ``kept`` (is it that one; true for rows that are alone).
    """
    keyed = docs.select("doc_id", F.md5("text").alias("text_key"), "text")
    signed = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # One row per different text; copies merge before they move.
    unique = Written(
        signed.select("doc_id", "text_key", _bands_of(F.col("text")).alias("bands"))
        .groupBy("text_key")
        .agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"))
    )
    placed = unique.read().where(F.col("bands").isNotNull()).select("id", F.posexplode("bands").alias("band", "code"))
    shared = (
        placed.groupBy("band", "code")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    members = Written(placed.join(shared, ["band", "code"]))
    wanted = members.read().select("id").distinct().join(unique.read().select("id", "text_key", "bands"), "id")
    texts = Written(
        signed.join(wanted.withColumnRenamed("id", "_id"), "text_key")
        .where(F.col("doc_id") == F.col("_id"))
        .groupBy(F.col("_id").alias("id"), "text_key")
        .agg(F.any_value("text").alias("text"), F.any_value("bands").alias("bands"))
        .select("id", "text", "bands")
    )
    votes = members.read().where(F.col("id") != F.col("first")).groupBy("id", "first").agg(F.count("*").alias("n"))
    nearest = votes.groupBy("id").agg(F.max_by("first", F.struct("n", "first")).alias("a"))
    links = checkpointed(_verified(nearest.select("a", F.col("id").alias("b")), texts.read()))
    mixed = _located(members.read(), links)
    members.remove()
    centre = mixed.read().groupBy("band", "code").agg(F.min_by(F.struct("id", "part"), F.xxhash64("id")).alias("c"))
    pairs = (
        mixed.read().join(centre, ["band", "code"])
        .where(F.col("part") != F.col("c.part"))
        .select(F.col("c.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    links = links.unionByName(checkpointed(_verified(pairs, texts.read())))
    # Parts only merge, so a bucket of one part stays one.
    left = _located(mixed.read().select("band", "code", "id"), links)
    mixed.remove()
    links = links.unionByName(checkpointed(_between_parts(left.read(), texts.read())))
    left.remove()
    texts.remove()
    parts = components(links, "a", "b").select(F.col("node").alias("id"), "component")
    classes = checkpointed(
        unique.read().select("id", "text_key")
        .join(parts, "id", "left")
        .select("text_key", F.coalesce("component", "id").alias("class_id"))
    )
    unique.remove()
    found = keyed.select("doc_id", "text_key").join(classes, "text_key", "left")
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull()
    return found.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("doc_id") == F.col("class_id"))).alias("kept"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id.

    Of repeated rows one stays.  ``docs`` may have any columns beside ``doc_id`` and ``text``.
    """
    kept = (
        duplicate_classes(docs)
        .where("kept")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.count("*").alias("_rows"))
    )
    # Whole rows are carried as one column, so their names meet no others.
    rows = docs.select("doc_id", F.md5("text").alias("text_key"), F.struct("*").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    joined = rows.join(kept, same)
    # Rows without an id are alone: they stay, whatever their number.
    once = (F.col("_rows") == 1) | F.col("doc_id").isNull()
    repeated = joined.where(~once).dropDuplicates(["_id", "_key"])
    return joined.where(once).select("row.*").unionByName(repeated.select("row.*"))
