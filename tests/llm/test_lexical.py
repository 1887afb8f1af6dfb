"""Ranked search against scoring every document, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np

import roadtrace.llm.lexical as lexical
from roadtrace.llm.lexical import Places, Segment, ranked, search_segment, term_counts

DOCS = "doc_id long, text string, score string, rank string"
ITEMS = "item_id long, text string, term string"


def _terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found)


def _expected(docs, items, top=20):
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        if text is None:
            continue
        scores = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in _terms(text).items() if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def _found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ranked(d, q, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def _corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)] + ["Ça", "œuf", "ﬁn", "日本"]

    def text(size):
        return rng.choice([" ", ", ", "\n"]).join(words[min(int(rng.expovariate(0.03)), 203)] for _ in range(size))

    docs = [(i, text(rng.choice([1, 5, 30, 120]))) for i in range(n)]
    docs += [(n + i, docs[i % 3][1]) for i in range(30)]
    items = [(k, text(rng.choice([1, 4, 15]))) for k in range(25)] + [(100, "W1 w1 w1 zzz"), (101, "zzz"), (102, None), (103, "")]
    return docs, items


def test_same_as_scoring_everything(spark, monkeypatch):
    docs, items = _corpus(1, 700)
    expected = _expected(docs, items)
    assert _found(spark, docs, items) == expected
    # Small segments, blocks and groups of items.
    monkeypatch.setattr(lexical, "GROUP", 40)
    assert _found(spark, docs, items) == expected
    assert _found(spark, docs, items, top=3) == _expected(docs, items, 3)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(c * 20, c * 20 + 40, 15)) for c in rng.integers(0, 10, 3000)]
    bounds = lexical.lengths_to_bounds(map(len, sets))
    terms = np.concatenate(sets)
    impacts = rng.integers(1, 1000, len(terms))
    segment = Segment(np.arange(3000), bounds, terms, impacts, rng.standard_normal((300, lexical.SKETCH), dtype=np.float32))
    scored = 0
    for _ in range(20):
        asked = np.unique(rng.integers(0, 240, 8))
        worth = rng.integers(1, 5000, len(asked))
        weights = np.zeros(300, np.int64)
        weights[asked] = worth
        places = Places(5)
        scored += search_segment(segment, asked, worth, weights, places)
        whole = np.add.reduceat(weights[terms] * impacts, bounds[:-1])
        best = sorted(zip(-whole, range(3000)))[:5]
        assert list(zip(-places.scores, places.ids)) == [x for x in best if x[0]]
        for term in filter(segment.place.__contains__, asked.tolist()):
            docs, edges, of_summary, largest, starts = segment.blocks(term)
            limits = np.add.reduceat(weights[of_summary] * largest, starts)
            assert sorted(docs) == sorted(segment.postings[segment.place[term]])
            for b, limit in enumerate(limits):
                assert limit >= whole[docs[edges[b] : edges[b + 1]]].max()
    assert scored < 20 * 1500


def test_terms():
    assert term_counts("A-b a\x00Éé É1".encode()) == {"a".encode(): 2, b"b": 1, "Éé".encode(): 1, "É1".encode(): 1}
    long = ("word " * 500_000 + "x" * 3_000_000).encode()
    assert term_counts(long) == {b"word": 500_000, b"x" * 3_000_000: 1}
    assert not term_counts(None) and not term_counts(b"")


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "alpha"), (3, "alpha"), (3, "beta beta"), (4, "..."), (5, "alpha " * 100_000),
            (6, "gamma"), (7, "gamma"), (8, "gamma"), (9, "delta")]
    items = [(None, "alpha"), (1, "alpha"), (1, "alpha"), (1, "beta"), (2, "gamma alpha gamma")]
    assert _found(spark, docs, items) == _expected(docs, items)
    assert _found(spark, [], items) == [] and _found(spark, docs, []) == [] and _found(spark, [(1, None)], [(1, None)]) == []
