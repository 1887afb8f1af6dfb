"""Benchmark items in documents against plain sets."""

import random
import re

from roadtrace.llm.decontaminate import leaks, without_leaks

DOCS = "doc_id long, text string, lang string, h string, words int"
ITEMS = "item_id long, text string, shingles string"


def _set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def _case():
    r = random.Random(8)
    words = ["la", "Mo", "ste", "Éri", "n3", "oup", "dra", "vin", "ket", "zum", "pol", "fir"]

    def text(n):
        return " ".join(r.choice(words) + r.choice(("", "", ",")) for _ in range(n))

    items = [(i, text(n), "c") for i, n in enumerate([5, 6, 8, 9, 13, 20, 33, 47, 80, 200])]
    items += [(50, None, None), (51, "", None), (52, "?!", None), (53, "zum zum", None), (None, "ket pol fir la ste oup", None), (54, items[4][1], "other")]
    docs = []
    for n in (0, 3, 30, 300, 3000):
        for item in items[:10]:
            held = item[1].split()
            cut = len(held) if r.random() < 0.6 else int(len(held) * r.choice((0.7, 0.85, 0.95)))
            docs.append((len(docs), f"{text(n)} {' '.join(held[:cut]).upper()} {text(n)}", "x", "clash", 1))
    docs += [(900, None, None, None, None), (901, "", "x", "h", 1), (902, "Zum, zum!", "x", "h", 1), (903, "zum zum la", "x", "h", 1),
             (None, "la " + items[5][1], "x", "h", 1), (904, items[6][1], "x", "h", 1), (904, items[6][1], "x", "h", 1), (905, text(60_000), "x", "h", 1)]
    return docs, items


def _plain(docs, items):
    found = set()
    for doc_id, text, *_ in docs:
        own = _set(text)
        for item_id, asked, _ in items:
            want = _set(asked)
            if want and len(want & own) / len(want) >= 0.8:
                found.add((doc_id, item_id, len(want), len(want & own)))
    return found


def test_same_as_plain_sets(spark):
    docs, items = _case()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    rows = leaks(d, b).collect()
    plain = _plain(docs, items)
    assert len(plain) > 30
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows} == plain
    assert len(rows) == len(plain)
    clean = without_leaks(d, b)
    assert clean.columns == d.columns
    hit = {doc_id for doc_id, *_ in plain}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in docs if i not in hit)


def test_empty_tables(spark):
    docs, items = _case()
    d, b = spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame(items, ITEMS)
    assert leaks(d.limit(0), b).count() == 0
    assert leaks(d, b.limit(0)).count() == 0 and without_leaks(d, b.limit(0)).count() == 5
