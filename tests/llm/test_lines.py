"""Repeated lines against a plain count, and odd inputs."""

import random
from collections import defaultdict

from roadtrace.llm.lines import LineRuns, line_key, repeated_lines_dropped

DOCS = "doc_id long, text string, n_lines string, lost string"


def _expected(docs, min_chars=40, min_docs=5):
    held = defaultdict(list)

    def key(line):
        return line_key(line.encode()).decode()

    for i, text in docs:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if keeper.get(key(x)) is None or keeper[key(x)] == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def _found(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    rows = repeated_lines_dropped(frame, **options).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows), key=str)


def test_same_as_counting_for_any_batches(spark):
    rng = random.Random(1)
    common = [f"line number {k} that several documents hold, Ünïted" for k in range(12)]
    docs = []
    for i in range(120):
        lines = [rng.choice(common) for _ in range(rng.randrange(4))] + [f"own {i} " + "x" * rng.randrange(60), "short", ""]
        rng.shuffle(lines)
        docs.append((i, "\n".join(rng.choice([x, x.upper().replace("Ü", "ü").replace("Ï", "ï"), f"\t{x} \r"]) for x in lines)))
    expected = _expected(docs)
    assert any(r[3] for r in expected)
    for options in ({}, {"batches": 1}, {"batches": 7, "fanout": 3}):
        assert _found(spark, docs, **options) == expected


def test_odd_rows(spark):
    line = "a line of more than forty code points, repeated"
    docs = [(None, line), (None, line), (None, f"{line}\n{line}"), (1, line), (2, f"{line}\nend"), (2, line), (2, f"{line}\n{line}"),
            (3, None), (4, ""), (5, "\n"), (6, "é" * 39), (7, "é" * 39), (8, "é" * 39), (9, "é" * 39), (10, "é" * 39),
            (11, " " * 100), (12, " " * 100), (13, "y" * 2_000_000 + "\n" + "z\n" * 200_000)]
    assert _found(spark, docs) == _expected(docs)
    # Only rows without an id: nobody is the largest, so nothing goes.
    lost = [(None, line)] * 6
    assert _found(spark, lost) == _expected(lost)
    assert _found(spark, []) == []
    assert _found(spark, [(1, None)] * 3) == [(1, "", 1, 0)] * 3


def test_runs_are_merged_by_level_and_first_batch_keeps(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    for batch in ([(9, b"a"), (8, b"a"), (8, b"b")], [(7, b"a"), (7, b"c")], [(6, b"c"), (5, b"d")], [(4, b"a")], [(None, b"e")]):
        runs.add(spark.createDataFrame([(i, bytearray(x)) for i, x in batch], "doc_id long, line binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = {bytes(r.line): (r.n_docs, r.keeper) for r in runs.totals().collect()}
    assert found == {b"a": (4, 9), b"b": (1, 8), b"c": (2, 7), b"d": (1, 5), b"e": (1, None)}
    # Runs of two levels meet as they lie.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    merged = runs.totals()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in merged and "Exchange" not in merged
    runs.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
