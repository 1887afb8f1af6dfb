"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on shingles.

Items and documents are sets of runs of five words.  A document's sketch is a one-permutation MinHash: the range of a
64-bit hash is cut into bins, and the smallest hash of each bin is kept.  The number of bins follows the size partition
of the document (the next power of two of its number of shingles), so a bin holds the same share of a shingle in a
20-word note and in a book, and a short item is found in either: any of its shingles that is the smallest of its bin
meets the item's own hash.  How many bins a shingle gets follows from the shortest item, so that an item held at the
threshold is missed with a probability of 1e-6 at most.

Documents whose sketch meets enough of an item's hashes are candidates.  They are read once more, and the item's share
of shingles found in the whole text is counted exactly, on the words themselves.

Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed

SHINGLE = 5
THRESHOLD = 0.8
MISSED = 1e-6
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def _runs(words: Column, of_words, of_all) -> Column:
    """``of_words`` every run of five words; ``of_all`` words if there are fewer; empty without words.

    Single elements are looked up, because a slice of an array takes as long as the whole array.
    """
    size = F.size(words)
    many = F.transform(
        F.sequence(F.lit(0), size - SHINGLE), lambda i: of_words(*[F.get(words, i + k) for k in range(SHINGLE)])
    )
    few = F.array(of_all(words))
    none = F.slice(few, 1, 0)
    return F.when(size >= SHINGLE, many).when(size > 0, few).otherwise(none)


def _bins_per_shingle(items: DataFrame) -> int:
    """Power of two, from the smallest item: its chance to lose every shingle to a neighbour in its bin is 1e-6."""
    least = items.agg(F.min("n_shingles")).first()[0]
    if least is None:
        return 1
    lost = MISSED ** (1 / math.ceil(THRESHOLD * least))
    # With an expected load of x, the first in a bin is another one with a probability below x / 2.
    return 2 ** min(40, max(0, math.ceil(math.log2(1 / (2 * lost)))))


def _sketch(hashed: DataFrame, bins_per_shingle: int) -> DataFrame:
    """``hashed`` with ``hashes`` replaced by ``sketch``: the smallest hash of every bin.

    The bins are the high bits of the hash.  Each step is a projection of its own, so that none is evaluated anew
    for every element.
    """
    ordered = hashed.withColumn("ordered", F.sort_array(F.array_distinct("hashes"))).drop("hashes")
    bits = F.ceil(F.log2(F.greatest(F.size("ordered"), F.lit(1)))) + int(math.log2(bins_per_shingle))
    # A shift by 63 leaves the sign alone, which makes two bins of documents that could do with one.
    shifted = ordered.withColumn("shift", F.greatest(F.lit(0), F.least(F.lit(63), 64 - bits)).cast("int"))

    def bin_of(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("shift"))

    first = F.filter("ordered", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.col("ordered")[i - 1])))
    return shifted.withColumn("sketch", first).drop("ordered", "shift")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of which a document holds ``THRESHOLD`` or more: one row per document and item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are left out.  Null,
    empty and wordless texts hold nothing and are held by nothing.  An item of fewer than five words is one run of all
    its words, which only a document of just these words has.  Rows that agree in id and text (null ids too) are one
    document or item.

    Columns: ``doc_id``, ``text_key`` (64-bit hash of the document's text), ``item_id``, ``n_shingles`` (distinct ones
    of the item), ``n_found``, ``containment``.
    """
    benchmark = items.select("item_id", F.col("text").alias("item_text")).distinct()
    benchmark = benchmark.withColumn("words", words_of(F.col("item_text")))
    benchmark = benchmark.withColumn("shingles", F.array_distinct(_runs(F.col("words"), F.xxhash64, F.xxhash64)))
    # Written, because a filter on a projection is pushed into it: its expressions would be evaluated per element.
    benchmark = checkpointed(benchmark.select("item_id", "item_text", "shingles"))
    benchmark = benchmark.withColumn("n_shingles", F.size("shingles")).where(F.col("n_shingles") > 0)
    bins = _bins_per_shingle(benchmark)
    wanted = benchmark.select("item_id", "item_text", "n_shingles", F.explode("shingles").alias("h"))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where(F.col("text").isNotNull())
    hashed = keyed.select("doc_id", "text_key", words_of(F.col("text")).alias("words")).select(
        "doc_id", "text_key", _runs(F.col("words"), F.xxhash64, F.xxhash64).alias("hashes")
    )
    # The outer form, because the inner one brings a filter on the array, which is pushed down as above.
    met = _sketch(hashed, bins).select("doc_id", "text_key", F.explode_outer("sketch").alias("h")).join(wanted, "h")
    # A quarter of what is expected at the threshold: far below any count that chance brings about.
    enough = F.greatest(F.lit(1.0), F.col("n_shingles") * (THRESHOLD / 4) * (1 - 1 / (2 * bins)))
    candidates = checkpointed(
        met.groupBy("doc_id", "text_key", "item_id", "item_text", "n_shingles")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") >= enough)
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "item_id", "item_text", "n_shingles")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))

    def written(words: str) -> Column:
        return _runs(F.col(words), lambda *run: F.concat_ws(" ", *run), lambda few: F.array_join(few, " "))

    found = checkpointed(
        keyed.join(candidates, same)
        .select("doc_id", "text_key", "item_id", "n_shingles", words_of(F.col("text")).alias("words"),
                words_of(F.col("item_text")).alias("item_words"))
        .select("doc_id", "text_key", "item_id", "n_shingles", written("words").alias("has"),
                written("item_words").alias("asked"))
        .select("doc_id", "text_key", "item_id", "n_shingles", F.size(F.array_intersect("asked", "has")).alias("n_found"))
    )
    return (
        found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .where(F.col("containment") >= THRESHOLD)
        .select("doc_id", "text_key", "item_id", "n_shingles", "n_found", "containment")
        .distinct()
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no item, with all their columns, whatever their names."""
    held = leaks(docs, items).select("doc_id", "text_key").distinct().alias("held")
    same = F.col("docs.doc_id").eqNullSafe(F.col("held.doc_id")) & (F.xxhash64("docs.text") == F.col("held.text_key"))
    return docs.alias("docs").join(held, same, "left_anti")
