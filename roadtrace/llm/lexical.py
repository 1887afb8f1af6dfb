"""Ranked lexical search with geometrically blocked posting lists.

Scores are sums over the terms of an item of a weight (rarity of the term) times an impact (how much of a document the term
is).  Documents are read once and become forward rows: their terms among those asked for.  A task takes forward rows in
segments.  In a segment, the posting list of a term is clustered by document similarity into blocks, and each block stores a
summary: the largest impact of every term over the documents of the block.  The dot product of an item with a summary bounds
the score of every document of the block, so a block is skipped only if this bound lies below the score of the item's
current last place.  Lists are taken from the term that can add most; when all terms that are left cannot reach the last
place together, no document outside the lists seen can, and the search of the segment ends.  Blocks of a list are made when
first asked for and serve all items of the segment.

The last places carry over from segment to segment of a task.  Tasks return the best documents per item, and these meet.
Items are taken in groups of bounded size, so what a task is sent does not grow with their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm.common import checkpointed, lengths_to_bounds
from roadtrace.staging import Written

TOP = 20
# Documents of a segment, and of a block on average.
SEGMENT = 4096
BLOCK = 64
# Dimensions of the sketches by which the documents of a list are clustered.
SKETCH = 16
# Rows (item, term) of the items that are searched together.
GROUP = 500_000
# Bytes of a text that are split at once.
WINDOW = 1 << 20

_APART = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of the terms of a whole text in UTF-8.

    Terms are runs of ASCII letters, digits and all code points from U+0080 on; only A-Z are lower-cased.
    """
    marked = (text or b"").translate(_APART)
    counts: Counter = Counter()
    start = 0
    while start < len(marked):
        end = marked.find(b" ", start + WINDOW)
        end = len(marked) if end < 0 else end
        counts.update(marked[start:end].split())
        start = end
    return counts


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_key``, ``item_id``, ``term``, ``k`` (occurrences) of the different items."""
    kind = items.schema["item_id"].dataType.simpleString()
    keyed = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct().select(
        F.md5(F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")).alias("item_key"), "item_id", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                counts = term_counts(text.as_py())
                rows = pa.array(np.full(len(counts), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_key").take(rows), batch.column("item_id").take(rows),
                     pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())],
                    ["item_key", "item_id", "term", "k"],
                )

    return keyed.mapInArrow(run, f"item_key string, item_id {kind}, term binary, k long")


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` (those in ``vocabulary``, by number) and ``counts`` per document.

    Documents without any term are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(len(batch), np.int64)
            lengths = np.zeros(len(batch), np.int64)
            terms: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                found = term_counts(text.as_py())
                sizes[i] = found.total()
                held = vocabulary.keys() & found.keys()
                numbers = np.fromiter((vocabulary[t] for t in held), np.int32, len(held))
                times = np.fromiter((found[t] for t in held), np.int32, len(held))
                order = np.argsort(numbers)
                terms.append(numbers[order])
                counts.append(times[order])
                lengths[i] = len(held)
            bounds = pa.array(lengths_to_bounds(lengths), pa.int32())
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes),
                 pa.ListArray.from_arrays(bounds, np.concatenate(terms) if terms else np.zeros(0, np.int32)),
                 pa.ListArray.from_arrays(bounds, np.concatenate(counts) if counts else np.zeros(0, np.int32))],
                ["doc_id", "n", "terms", "counts"],
            )
            yield made.filter(pa.array(sizes > 0))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def _rows_of(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, and where each row's entries start among them."""
    lengths = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return np.repeat(bounds[rows] - starts, lengths) + np.arange(ends[-1] if len(ends) else 0), starts


class Segment:
    """Some documents, their terms with impacts, and the blocks of the posting lists asked for so far."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray, projection: np.ndarray):
        """Every document has a term."""
        self.ids, self.bounds, self.terms, self.impacts = ids, bounds, terms, impacts
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        self.listed, starts = np.unique(terms[order], return_index=True)
        self.postings = np.split(owner[order], starts[1:])
        self.most = np.maximum.reduceat(impacts[order], starts)
        self.place = {int(t): i for i, t in enumerate(self.listed)}
        made = np.empty((len(ids), SKETCH), np.float32)
        for first in range(0, len(ids), 256):
            last = min(first + 256, len(ids))
            part = slice(bounds[first], bounds[last])
            weighed = projection[terms[part]] * impacts[part, None].astype(np.float32)
            made[first:last] = np.add.reduceat(weighed, bounds[first:last] - bounds[first], axis=0)
        self.sketches = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
        self._blocks: dict[int, tuple] = {}

    def bound(self, term: int) -> int:
        """Largest impact of a term in the segment."""
        at = self.place.get(term)
        return 0 if at is None else int(self.most[at])

    def blocks(self, term: int) -> tuple:
        """Documents by block (with bounds), and the summaries: terms and largest impacts by block (with starts)."""
        if term not in self._blocks:
            docs = self.postings[self.place[term]]
            n = -(-len(docs) // BLOCK)
            if n > 1:
                centres = self.sketches[docs[np.arange(n) * len(docs) // n]]
                cluster = (self.sketches[docs] @ centres.T).argmax(axis=1)
                order = np.argsort(cluster, kind="stable")
                docs, cluster = docs[order], cluster[order]
                edges = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
            else:
                edges = np.array([0, len(docs)])
            entries, _ = _rows_of(self.bounds, docs)
            width = int(self.listed[-1]) + 1
            of_block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            key = np.repeat(of_block, self.bounds[docs + 1] - self.bounds[docs]) * width + self.terms[entries]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            largest = np.maximum.reduceat(self.impacts[entries][order], first)
            block = key[first] // width
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            self._blocks[term] = docs, edges, (key[first] % width).astype(np.int32), largest, starts
        return self._blocks[term]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        entries, starts = _rows_of(self.bounds, docs)
        return np.add.reduceat(weights[self.terms[entries]] * self.impacts[entries], starts)


class Places:
    """The best ``top`` documents of an item so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @property
    def last(self) -> int:
        """What a document needs to come in: more than nothing, and at least the score of the last place if all are taken."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.last
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]


def search_segment(segment: Segment, terms: np.ndarray, worth: np.ndarray, weights: np.ndarray, places: Places) -> int:
    """Adds a segment's documents to ``places``; returns how many of them were scored.

    ``worth`` is the weight of each of an item's ``terms`` times its repeats; ``weights`` the same by term number.
    """
    most = worth * np.array([segment.bound(t) for t in terms.tolist()], np.int64)
    order = np.argsort(-most, kind="stable")
    order = order[most[order] > 0]
    # What the terms from each place on can add together.
    rest = np.cumsum(most[order][::-1])[::-1]
    seen = np.zeros(len(segment.ids), bool)
    for term, reach in zip(terms[order].tolist(), rest.tolist()):
        if reach < places.last:
            break
        docs, edges, of_summary, largest, starts = segment.blocks(term)
        bounds = np.add.reduceat(weights[of_summary] * largest, starts)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] < places.last:
                break
            own = docs[edges[b] : edges[b + 1]]
            own = own[~seen[own]]
            if len(own):
                seen[own] = True
                places.add(segment.scores(own, weights), segment.ids[own])
    return int(seen.sum())


def _search(forward: DataFrame, asked: list[tuple], n_docs: int, n_terms: int, df: np.ndarray, top: int) -> DataFrame:
    """``item`` (its number), ``doc_id``, ``score``: per task the best documents of each item.

    ``asked`` holds (term numbers, repeats) of each item, ``df`` the documents of each term.
    """
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = np.random.default_rng(12).standard_normal((len(weight), SKETCH), dtype=np.float32)
        worth = [weight[terms] * repeats for terms, repeats in asked]
        places = [Places(top) for _ in asked]
        weights = np.zeros(len(weight), np.int64)

        def take(rows: pa.Table) -> None:
            terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
            bounds = lengths_to_bounds(terms.value_lengths().to_numpy())
            length = np.repeat(rows.column("n").to_numpy(), np.diff(bounds))
            tf = counts.flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * length * n_docs) // n_terms
            impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            segment = Segment(rows.column("doc_id").to_numpy(), bounds, terms.flatten().to_numpy(), impacts, projection)
            for (own, _), value, best in zip(asked, worth, places):
                weights[own] = value
                search_segment(segment, own, value, weights, best)
                weights[own] = 0

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            while sum(map(len, held)) >= SEGMENT:
                rows = pa.Table.from_batches(held)
                take(rows.slice(0, SEGMENT))
                held = rows.slice(SEGMENT).to_batches()
        if held:
            take(pa.Table.from_batches(held))
        sizes = [len(p.ids) for p in places]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(asked)), sizes), pa.int32()), pa.array(np.concatenate([p.ids for p in places])),
                 pa.array(np.concatenate([p.scores for p in places]))],
                ["item", "doc_id", "score"],
            )

    held = forward.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return held.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` highest-scoring documents of every item, with scores above 0; equal scores by smaller ``doc_id``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``, ``items`` has ``item_id`` and ``text``; other columns, whatever
    their names, are left out.  Texts are taken whole, however long.  Null, empty and termless texts hold nothing and match
    nothing, and an item without terms has no rows.  Repeated documents are documents of their own; documents without an id
    count in the statistics and are not returned.  Items that agree in id and text are one; an id with several texts has
    a ranking for each.  Empty tables give no rows.

    With N documents that have terms, L terms in all, n in the document, tf occurrences there and df documents with the term:
    the weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact 10^9 tf div (1000 tf + 12 m) for
    m = 75 + 25 n N div L, and a score sums weight times impact over the item's terms with repeats.

    Columns: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.
    """
    spark = docs.sparkSession
    terms = checkpointed(_item_terms(items))
    n_groups = -(-terms.count() // GROUP)
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in range(n_groups):
        # At most about GROUP rows, or one item.
        own = terms.where(F.pmod(F.crc32(F.col("item_key").cast("binary")), F.lit(n_groups)) == group)
        rows = own.orderBy("item_key", "term").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        by_item: dict[str, list] = {}
        ids = {}
        for r in rows:
            by_item.setdefault(r["item_key"], []).append((vocabulary[bytes(r["term"])], r["k"]))
            ids[r["item_key"]] = r["item_id"]
        asked = [(np.array([t for t, _ in x], np.int64), np.array([k for _, k in x], np.int64)) for x in by_item.values()]
        forward = Written(forward_rows(docs, vocabulary))
        n_docs, n_terms = forward.read().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for t, n in forward.read().select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids.values())], f"item int, item_id {kind}")
        # A task hands on ``top`` rows an item; Spark drops what cannot be among them before rows meet.
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        found = checkpointed(
            _search(forward.read(), asked, n_docs, n_terms, df, top)
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= top)
            .join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        forward.remove()
        result = result.unionByName(found)
    return result
