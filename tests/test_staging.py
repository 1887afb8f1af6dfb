"""Where interim tables go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from roadtrace.staging import Written, shared_folder, staged


def test_written_tables_are_read_by_partition_and_removed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "k int, v string")
    table = Written(rows, partition_by=["k"])
    assert {(r.k, r.v) for r in table.read().where("k = 2").collect()} == {(2, "b"), (2, None)}
    assert table.read().columns == ["k", "v"]
    path = table.path.removeprefix("file:")
    assert os.path.isdir(path)
    table.remove()
    assert not os.path.exists(path)


def test_an_empty_table_keeps_its_columns(spark):
    table = Written(spark.createDataFrame([], "k int, v array<long>"))
    assert table.read().dtypes == [("k", "int"), ("v", "array<bigint>")] and table.read().count() == 0
    assert staged(table.read()).count() == 0


def test_a_cluster_must_name_a_folder():
    unset = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(_jsc=unset, master=master)
        with pytest.raises(ValueError):
            shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda _, other: other)))
