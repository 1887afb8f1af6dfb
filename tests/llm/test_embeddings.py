"""Vector links and components against all pairs."""

import numpy as np
import pytest

import roadtrace.llm.embeddings as embeddings
from roadtrace.llm.embeddings import layout, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, codes string"


def _plain(rows):
    def good(v, label):
        return v is not None and label is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)

    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i, (_, v, a, _) in enumerate(rows):
        for j, (_, w, b, _) in enumerate(rows):
            if i != j and good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                linked[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98
    part = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(part, np.where(linked, part[None, :], 1 << 60).min(axis=1))
        if (new == part).all():
            return linked.sum(axis=1), part
        part = new


def _rows():
    r = np.random.default_rng(2)
    rows = []
    for centre in range(6):
        middle = r.normal(size=16)
        for k in range(30):
            v = middle + r.normal(size=16) * (0.0 if k < 5 else 0.13) * np.linalg.norm(middle) / 4
            rows.append((len(rows), (v * (2.0 if k % 2 else 1.0)).tolist(), centre % 2, "x"))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 0, "x") for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None, "x"), (2001, rows[0][1], None, "x"), (2002, rows[0][1], 0, "x")]
    return rows


@pytest.mark.parametrize("block, bucket", [(1024, 256), (1024, 1), (8, 16)])
def test_same_as_all_pairs(spark, monkeypatch, block, bucket):
    """Also with buckets of few rows, and with blocks so small that buckets are compared in parts."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "BUCKET", bucket)
    rows = _rows()
    links, part = _plain(rows)
    found = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    for (vec_id, *_), n, component in zip(rows, links, part):
        assert (found[vec_id].n_links, found[vec_id].component_id) == (n, component)
        assert found[vec_id].kept == (vec_id == component)


def test_null_ids_repeated_rows_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1, ""), (5, v, 1, ""), (6, v, 1, ""), (None, v, 1, ""), (None, None, None, None)]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in found if r.vec_id) == [
        (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)] * 2
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_layout_follows_the_rows():
    assert layout(0, 0.98) == layout(256, 0.98) == (0, 1)
    for rows in (257, 8_000, 32_000_000, 10**9, 10**12):
        bits, tables = layout(rows, 0.98)
        assert rows / 2**bits <= 256 or bits == 31
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 6e-6
    assert [layout(n, 0.98) for n in (8_000, 32_000_000, 10**9)] == [(5, 10), (17, 31), (22, 45)]


def test_recall_at_the_threshold(spark, monkeypatch):
    """4,000 pairs just above the threshold, 11 bits, in code only: the tables lose none."""
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    monkeypatch.setattr(embeddings, "BUCKET", 4)
    rows = [(2 * i + j, v.tolist(), 1, "") for i in range(4000) for j, v in enumerate((x[i], y[i]))]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links = 1 AND component_id = vec_id - vec_id % 2")
    assert found.count() == 8000
