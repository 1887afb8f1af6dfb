"""BagMinHash: unbiased signatures; classes against all pairs; odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from roadtrace.llm import minhash
from roadtrace.llm.minhash import duplicate_classes, shingles, signatures, similarity, without_duplicates

SCHEMA = "doc_id long, text string, lang string, band string, component int"


def _bag(text):
    words = re.findall(r"[^\W_]+", text.lower())
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def _plain_similarity(a, b):
    a, b = _bag(a), _bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def _plain_classes(rows):
    known = [(i, t) for i, t, *_ in rows if i is not None and t is not None]
    part = {i: i for i, _ in known}
    links = [(i, j) for i, t in known for j, u in known if i < j and (t == u or _plain_similarity(t, u) >= 0.8)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(part[i], part[j])
            if part[i] != low or part[j] != low:
                part[i] = part[j] = low
                changed = True
    return part


def _rows():
    r = random.Random(4)
    words = [a + b for a in "bcdfglmnprst" for b in ("a", "eu", "ino", "or", "ush")]
    rows = []
    for group in range(8):
        base = [r.choice(words) for _ in range(r.randint(30, 120))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy) + r.choice((".", "", "!")), "xx", "clash", 1))
    passage = " ".join(r.choice(words) for _ in range(60))
    rows += [(500 + i, " ".join([r.choice(words) for _ in range(90)]) + " " + passage, "xx", "clash", 1) for i in range(12)]
    rows += [(600 + i, t, None, None, None) for i, t in enumerate(["", "", "...", "...", "one two", "One, two", None, None, "ha " * 400, "ha " * 410])]
    return rows


def test_signatures_agree_as_often_as_bags_are_similar():
    r = np.random.default_rng(1)
    hashes = np.sort(r.integers(0, 2**63, 80).astype(np.uint64))
    counts = r.integers(1, 12, 80)
    other = np.where(r.random(80) < 0.7, counts, r.integers(1, 12, 80))
    a, b = (hashes, counts), (hashes[10:], other[10:])
    agree = []
    for salt in range(50):
        salted = minhash._mixed(hashes + np.uint64(salt))
        one, two = signatures([(salted, counts), (salted[10:], other[10:])])
        agree.append((one == two).mean())
    assert abs(np.mean(agree) - similarity(a, b)) < 4 * np.std(agree) / 50**0.5


def test_shingles_and_similarity_against_counters():
    texts = [t for _, t, *_ in _rows() if t is not None][::5] + ["a b c d e f a b c d e f a b c d e f"]
    for one in texts:
        assert sorted(shingles(one)[1]) == sorted(_bag(one).values())
        for two in texts[:6]:
            assert similarity(shingles(one), shingles(two)) == pytest.approx(_plain_similarity(one, two))


def test_classes_same_as_all_pairs(spark):
    rows = _rows()
    plain = _plain_classes(rows)
    found = {r.doc_id: r for r in duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        assert found[doc_id].class_id == plain.get(doc_id, doc_id)
        assert found[doc_id].kept == (plain.get(doc_id, doc_id) == doc_id)
    assert len(set(plain.values())) < len(plain)


def test_one_of_each_class_stays(spark):
    long = "word after word goes on " * 30_000
    rows = [(1, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (2, "A b c d e f", "z", "y", 2), (3, None, None, None, None),
            (4, None, None, None, None), (None, "a b c d e f", "n", None, 3), (None, "a b c d e f", "n", None, 3), (5, long, "l", "", 1), (6, long + "on", "l", "", 1)]
    found = without_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "lang", "band", "component"]
    kept = found.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5]
    assert sum(r.doc_id is None for r in kept) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert duplicate_classes(empty).count() == 0 and without_duplicates(empty).count() == 0
