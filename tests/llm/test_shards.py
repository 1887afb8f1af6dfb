"""Stratified interleaving against a plain numbering of all rows, and odd inputs."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from roadtrace.llm.shards import SEED, interleave, write_shards

ROWS = "doc_id long, source string, extra string"


def _expected(rows, shards):
    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    groups = defaultdict(list)
    for row in rows:
        groups["" if row[1] is None else f"={row[1]}"].append(row)
    line = []
    for own, members in groups.items():
        phase = int(md5(f"{SEED}|{own}")[:4], 16) / 65536.0
        members.sort(key=lambda row: md5(f"{SEED}|{'' if row[0] is None else row[0]}"))
        line += [((rank + phase) / len(members), own, rank, row) for rank, row in enumerate(members)]
    line.sort(key=lambda x: x[:3])
    return [(row[0], i * shards // len(line)) for i, (_, _, _, row) in enumerate(line)]


def test_same_as_numbering_everything(spark):
    rows = [(i, None if i % 11 == 0 else f"s{min(i % 7, 3)}", "x") for i in range(500)] + [(None, "lonely", None)]
    found = interleave(spark.createDataFrame(rows, ROWS), 7, F.col("source"), F.col("doc_id").cast("string")).collect()
    assert Counter((r.doc_id, r.shard) for r in found) == Counter(_expected(rows, 7))
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(size))
    hot = Counter(r.shard for r in found if r.source == "s3")
    assert max(hot.values()) - min(hot.values()) <= 2


def test_repeated_rows_and_few_rows(spark):
    rows = [(1, "a", None)] * 5
    found = interleave(spark.createDataFrame(rows, ROWS), 40, F.col("source"), F.col("doc_id").cast("string")).collect()
    assert len({r.shard for r in found}) == 5 and all(r.slot == 0 for r in found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert interleave(empty, 3, F.col("source"), F.col("doc_id").cast("string")).columns == ["doc_id", "source", "extra", "shard", "slot"]
    assert interleave(empty, 3, F.col("source"), F.col("doc_id").cast("string")).count() == 0


def test_written_shards_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 3}", "") for i in range(60)], ROWS)
    write_shards(interleave(rows, 4, F.col("source"), F.col("doc_id").cast("string")), str(tmp_path / "out"))
    for shard in range(4):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / f"out/shard={shard}")).collect()]
        assert slots == list(range(15))
