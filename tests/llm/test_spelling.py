"""Spelling variants against edits of every pair, and odd inputs."""

import itertools
import random
import zlib
from collections import Counter
import re

import roadtrace.llm.spelling as spelling
from roadtrace.llm.spelling import near_pairs, near_words, one_edit, spelling_variants

DOCS = "doc_id long, text string, word string, n string"


def _expected(docs, every=199, least=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts.get(form[w]) or 0) for w in counts)


def _found(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    rows = spelling_variants(frame, **options).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows)


def _words(rng, n, letters="abcdeé", low=5, high=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def _corpus(seed):
    rng = random.Random(seed)
    base = _words(rng, 60)
    docs = []
    for i in range(80):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdÿ") + w[at:], w[:at] + "z" + w[at + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper()]))
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return docs


def test_one_edit():
    def plain(a, b):
        near = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in set(b)}
        near |= {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in set(b)}
        return a != b and b in near

    for a, b in itertools.product(["", "a", "ab", "ba", "aab", "abb", "abab", "baba", "aabb", "éab"], repeat=2):
        assert one_edit(a, b) == plain(a, b)


def test_gram_matrices_find_every_near_pair():
    rng = random.Random(2)
    words = sorted(set(_words(rng, 400, "abc", 4, 8)))
    expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and one_edit(a, b)}
    assert set(near_pairs(words)) == expected
    assert set(near_pairs(words[:90], words[90:])) == {(i, j - 90) for i, j in expected if i < 90 <= j}


def test_cells_lose_no_pair(spark, monkeypatch):
    """Small cells and parts, so that words meet over all kinds of neighbouring cells."""
    rng = random.Random(3)
    words = sorted(set(_words(rng, 1500, "abcdefé", 4, 9)))
    near = Counter(w for a, b in itertools.combinations(words, 2) if one_edit(a, b) for w in (a, b))
    counted = spark.createDataFrame([(w, 5 + k % 7) for k, w in enumerate(words)], "word string, n long")
    for cell, part in ((4, 3), (1000, 50)):
        monkeypatch.setattr(spelling, "CELL", cell)
        monkeypatch.setattr(spelling, "PART", part)
        assert {r.word: r.n_near for r in near_words(counted).collect()} == dict(near)


def test_same_as_every_pair(spark):
    docs = _corpus(5)
    expected = _expected(docs)
    assert sum(1 for r in expected if r[1]) > 5
    assert _found(spark, docs) == expected
    assert _found(spark, docs, every=None) == _expected(docs, None)


def test_odd_rows(spark):
    long_run = "ab" * 50_000
    docs = [(None, "lanterne lanterna"), (1, None), (2, ""), (3, "short 12345 ..."), (4, "lanterne " * 40), (4, "lanterne " * 40),
            (5, "lanterna " * 6), (6, f"{long_run} " * 6), (7, f"{long_run}c " * 5), (8, "ÀÉÎÕÜÿ×÷ " * 7)]
    assert _found(spark, docs) == _expected(docs)
    assert _found(spark, []) == []
