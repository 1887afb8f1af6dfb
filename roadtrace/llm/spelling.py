"""Spelling variants: words that differ by one code point, found with blocked Gram matrices.

A word is the vector of its letter counts.  One inserted or deleted code point changes one count by one, a replaced one
changes two, so near words have vectors at a squared distance of one (lengths one apart) or two (equal lengths).  Squared
distances of a block of words to another are two norms less twice the product of the blocks' count matrices.

Only blocks that can hold near words meet.  Letters are dealt into groups, and a cell holds the words of one length with the
same number of letters of each group.  Near words lie in the same cell, in two cells of one length that differ by one letter
moved between two groups, or in two cells of adjacent lengths that differ by one letter of one group.  The number of groups
follows from the number of words, so that cells stay near ``CELL`` words, and a cell that is larger all the same is
cut into parts that meet part by part; so neither memory nor the pairs looked at grow with the square of the words.

Pairs at the right distance are verified on the words themselves.  Only counts and best partners leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed

MIN_LENGTH = 6
MIN_COUNT = 5
# A word's form must occur this many times as often as the word.
LEAD = 5
# Words of a cell that are aimed at, and words of a part of a larger cell.
CELL = 256
PART = 1024

LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
_PLACE = np.full(256, len(LETTERS), np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, every: int | None = 199) -> DataFrame:
    """``word`` of every run of at least ``MIN_LENGTH`` letters in a text, A-Z in lower case.

    Where ``every`` divides the hash h of document and run, code point h modulo the length is deleted: the same misprints
    everywhere.  Words that are too short after that are gone.  None leaves all runs as they are.
    """
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run")
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    if every is None:
        return runs.select(F.col("run").alias("word"))
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = runs.withColumn("h", F.crc32(F.concat(owner, F.lit(":"), "run").cast("binary")))
    size = F.char_length("run")
    at = (F.col("h") % size).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    made = hashed.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))
    return made.where(F.char_length("word") >= MIN_LENGTH)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word, one column per letter.  Other code points are counted together in the last column."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    columns = np.where(points < 256, _PLACE[np.minimum(points, 255)], len(LETTERS))
    width = len(LETTERS) + 1
    cells = np.repeat(np.arange(len(words)), lengths) * width + columns
    return np.bincount(cells, minlength=len(words) * width).reshape(len(words), width)


def near_pairs(a: list[str], b: list[str] | None = None) -> Iterator[tuple[int, int]]:
    """Positions of near words in ``a`` and ``b``, or of each pair within ``a``."""
    left = letter_counts(a)
    right = left if b is None else letter_counts(b)
    others = a if b is None else b
    norm_a, norm_b = (left * left).sum(axis=1), (right * right).sum(axis=1)
    # Whole numbers below 2^24 are exact in single precision.
    kind = np.float32 if max(norm_a.max(initial=0), norm_b.max(initial=0)) < 2**22 else np.float64
    gram = left.astype(kind) @ right.astype(kind).T
    distance = norm_a[:, None] + norm_b[None, :] - 2 * gram
    apart = left.sum(axis=1)[:, None] != right.sum(axis=1)[None, :]
    rows, columns = np.nonzero(np.where(apart, distance == 1, distance == 2))
    for i, j in zip(rows.tolist(), columns.tolist()):
        if (b is not None or i < j) and one_edit(a[i], others[j]):
            yield i, j


def letter_groups(counted: DataFrame, n_groups: int) -> list[str]:
    """Letters dealt into groups of similar use: the most frequent letter goes to the group with fewest uses so far."""
    used = counted.agg(
        *[F.sum(F.char_length("word") - F.char_length(F.replace("word", F.lit(c)))).alias(f"c{k}") for k, c in enumerate(LETTERS)]
    ).first()
    groups, load = [""] * n_groups, [0] * n_groups
    for use, letter in sorted(((used[k] or 0, c) for k, c in enumerate(LETTERS)), key=lambda x: (-x[0], x[1])):
        least = load.index(min(load))
        groups[least] += letter
        load[least] += use
    return groups


def _groups_needed(n_words: int) -> int:
    """Groups that make cells of about ``CELL`` words for words of ten letters, spread evenly."""
    n, cells = 1, 1.0
    while n < 12 and n_words / 10 / cells > CELL:
        n += 1
        cells *= (10 + n - 1) / (n - 1)
    return n


def _cell(word: Column, groups: list[str]) -> Column:
    """Number of letters of each group; their sum is the length."""
    return F.array(*[
        (F.char_length(word) - F.char_length(F.translate(word, group, ""))).cast("int") if group else F.lit(0) for group in groups
    ])


def _neighbours(cell: Column, n_groups: int) -> Column:
    """The cell itself and the cells after it that can hold near words: each pair of cells is named by one of them.

    Of two cells of one length that differ by a letter moved, the one with more letters in the earlier group names the
    other; of two lengths the shorter names the longer.
    """
    def moved(plus: int | None, minus: int | None) -> Column:
        return F.array(*[
            cell[k] + (1 if k == plus else 0) - (1 if k == minus else 0) for k in range(n_groups)
        ])

    others = [moved(plus, minus) for minus in range(n_groups) for plus in range(minus + 1, n_groups)]
    others += [moved(plus, None) for plus in range(n_groups)]
    return F.array(cell, *others)


def near_words(counted: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (struct of count and word of the best near word), for words that have near ones.

    ``counted`` has the different words as ``word`` and their ``n``.
    """
    n_words = counted.count()
    n_groups = _groups_needed(n_words)
    groups = letter_groups(counted, n_groups)
    # A filled cell is known by its numbers; how many words it has decides into how many parts it is cut.
    celled = counted.withColumn("cell", _cell(F.col("word"), groups))
    sizes = checkpointed(
        celled.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    )
    placed = celled.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    pairs = checkpointed(
        sizes.select(F.col("cell").alias("one"), F.explode(_neighbours(F.col("cell"), n_groups)).alias("other"))
        .join(sizes.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other")
    )

    def each(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    same = F.col("one") == F.col("other")
    first = placed.join(pairs.withColumnRenamed("one", "cell"), "cell").select(
        F.col("cell").alias("one"), "other", F.lit(0).alias("side"), "word", "n", F.col("part").alias("i"), each(F.col("other_parts")).alias("j")
    )
    # Parts of one cell meet once, and a part meets itself with one side.
    first = first.where((F.col("one") != F.col("other")) | (F.col("i") <= F.col("j")))
    second = placed.join(pairs.select(F.col("other").alias("cell"), "one"), "cell").select(
        "one", F.col("cell").alias("other"), F.lit(1).alias("side"), "word", "n", F.col("part").alias("j"), "parts"
    )
    one_parts = sizes.select(F.col("cell").alias("one"), F.col("parts").alias("one_parts"))
    second = second.join(one_parts, "one").select(
        "one", "other", "side", "word", "n", each(F.col("one_parts")).alias("i"), "j"
    ).where(~same | (F.col("i") < F.col("j")))
    key = F.xxhash64(F.array_join("one", ","), F.array_join("other", ","), "i", "j")
    rows = first.unionByName(second).select(
        F.concat_ws("|", F.array_join("one", ","), F.array_join("other", ","), "i", "j").alias("key"),
        key.alias("deal"), (same & (F.col("i") == F.col("j"))).alias("own"), "side", "word", "n",
    )
    dealt = rows.repartition("deal").sortWithinPartitions("deal", "key", "side")
    found = dealt.drop("deal").mapInArrow(_linked, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best"))).alias("b")
    ).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within each group of a stream that is sorted by key and side."""
    held: pa.Table | None = None

    def links(rows: pa.Table) -> pa.RecordBatch:
        words, counts, side = (rows.column(c).to_pylist() for c in ("word", "n", "side"))
        cut = side.index(1) if 1 in side else len(side)
        alone = rows.column("own")[0].as_py() and cut == len(side)
        near: dict[int, list] = {}
        pairs = near_pairs(words[:cut]) if alone else (
            (i, cut + j) for i, j in near_pairs(words[:cut], words[cut:])) if 0 < cut < len(side) else ()
        for i, j in pairs:
            for x, y in ((i, j), (j, i)):
                mine = near.setdefault(x, [0, (0, "")])
                mine[0] += 1
                mine[1] = min(mine[1], (-counts[y], words[y])) if mine[0] > 1 else (-counts[y], words[y])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in near], pa.string()),
                pa.array([m[0] for m in near.values()], pa.int64()),
                pa.array([-m[1][0] for m in near.values()], pa.int64()),
                pa.array([m[1][1] for m in near.values()], pa.string()),
            ],
            ["word", "n_near", "best_n", "best"],
        )

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = held.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        for start, end in zip(starts[:-1], starts[1:]):
            yield links(held.slice(start, end - start))
        held = held.slice(starts[-1])
    if held is not None:
        yield links(held)


def _roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form or null) with ``root``: the last word that following forms leads to.

    Every round doubles the steps taken; counts grow by ``LEAD`` with every step, so there are few.
    """
    known = checkpointed(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = checkpointed(known.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        known = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return forms.join(known, "word")


def spelling_variants(docs: DataFrame, every: int | None = 199, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of all texts with their spelling variants: one row per word.

    ``docs`` has ``doc_id`` and ``text``; other columns, whatever their names, are left out.  Words are runs of letters
    (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case, of at least six code points after the misprints of ``words_of``, that occur
    at least ``min_count`` times overall.  Two words are near if they differ by exactly one code point.  A word's form is
    its near word with the largest count (ties: the smallest in code-point order) if that is at least ``LEAD`` times its own.

    Null and empty texts hold no word; a null ``doc_id`` counts as an empty one; repeated rows count each time.  Texts
    and runs of any length are taken whole.  An empty table gives no rows.

    Columns: ``word``, ``form`` (or null), ``root`` (following forms to the last; the word itself without one), ``n``,
    ``n_near`` (number of near words), ``form_n`` (count of the form, or null).
    """
    counted = checkpointed(
        words_of(docs, every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    )
    near = near_words(counted)
    leads = F.col("best_n") >= LEAD * F.col("n")
    formed = checkpointed(
        counted.join(near, "word", "left").select(
            "word",
            F.when(leads, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, F.col("best_n")).alias("form_n"),
        )
    )
    return _roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
