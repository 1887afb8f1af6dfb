import pytest

from roadtrace.jobs import run_load
from roadtrace.operators.select import quality_trajectories
from roadtrace.sources.readers import (
    NODE_SCHEMA,
    TRAJECTORY_SCHEMA,
    WAY_SCHEMA,
    read_nodes,
    read_pings,
    read_trajectories,
    read_ways,
)
from roadtrace.sources.sinks import write_csv, write_daily, write_matches, write_segments
from roadtrace.sources.text import Counts, checked_text, load_text, write_checked_text
from roadtrace.staging import shared_folder, staged

WAYS = """ways.id,ways.userid,ways.timestamp,ways.isvisible,ways.version,ways.changesetid,ways.tags,ways.nodes
way-7,31,2021-02-03T04:05:06Z,true,3,99,{"lit":"yes","name":"Long Lane, part 2","highway":"tertiary"},["p1","p22","p9"]
way-8,32,2022-01-01T00:00:00Z,false,1,100,{},["p5"]
"""
NODES = """id,userid,timestamp,isvisible,version,changesetid,tags,latitude,longitude
p1,5,2020-06-07T08:09:10Z,true,2,7,{},-12.5,130.25
p2,5,2020-06-07T08:09:11Z,true,4,7,{"kind":"gate","name":"East, upper"},-12.625,130.375
p3,5,2020,true,?,7,{},north,130.5
"""
TRAJECTORIES = """rider,3,100,-12.5,130.25,7,21.5,11.25,{"type":"Point","coordinates":[130.25,-12.5]}
rider,3,109,-12.625,130.375,9,36.75,14.5,{"type":"Point","coordinates":[130.375,-12.625]}
"""


def written(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_ways_text(spark, tmp_path):
    df = load_text(spark, written(tmp_path, WAYS), "ways")
    assert df.schema.simpleString() == spark.createDataFrame([], WAY_SCHEMA).schema.simpleString()
    got = {r.id: r for r in df.collect()}
    assert set(got) == {"way-7", "way-8"}
    assert got["way-7"].tags == {"lit": "yes", "name": "Long Lane, part 2", "highway": "tertiary"}
    assert got["way-7"].nodes == ["p1", "p22", "p9"]
    assert (got["way-7"].version, got["way-7"].changesetid, got["way-7"].isvisible) == (3, 99, True)
    assert got["way-8"].tags == {} and got["way-8"].isvisible is False


def test_nodes_text(spark, tmp_path):
    df = load_text(spark, written(tmp_path, NODES), "nodes")
    assert df.schema.simpleString() == spark.createDataFrame([], NODE_SCHEMA).schema.simpleString()
    got = {r.id: r for r in df.collect()}
    assert (got["p2"].latitude, got["p2"].longitude) == (-12.625, 130.375)
    assert got["p2"].tags["name"] == "East, upper"
    assert (got["p3"].version, got["p3"].latitude) == (None, None)


def test_trajectories_text(spark, tmp_path):
    df = load_text(spark, written(tmp_path, TRAJECTORIES), "trajectories")
    assert df.schema.simpleString() == spark.createDataFrame([], TRAJECTORY_SCHEMA).schema.simpleString()
    rows = df.orderBy("timest").collect()
    assert [r.speed for r in rows] == [11.25, 14.5]
    assert rows[0].geojson == '{"type":"Point","coordinates":[130.25,-12.5]}'


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        load_text(spark, "/nowhere", "relations")


def test_readers_take_frames_files_and_tables(spark, tmp_path):
    ways = load_text(spark, written(tmp_path, WAYS), "ways")
    path = str(tmp_path / "ways.parquet")
    ways.write.parquet(path)
    ways.createOrReplaceTempView("some_ways")
    for source in (ways, path, "some_ways"):
        assert read_ways(spark, source).count() == 2
    nodes = spark.createDataFrame([], NODE_SCHEMA + ", extra int")
    assert "extra" not in read_nodes(spark, nodes).columns
    assert len(read_trajectories(spark, spark.createDataFrame([], TRAJECTORY_SCHEMA)).columns) == 9
    pings = spark.createDataFrame(
        [], "customid string, timestamp int, latitude double, longitude double, accuracy int, other int"
    )
    assert len(read_pings(spark, pings).columns) == 5


def test_sinks_replace_the_table(spark):
    rows = spark.createDataFrame(
        [("u", 0, 1, "r", 0)], "customid string, trajid int, timest int, roadID string, seq int"
    )
    write_matches(rows, "matched_roads")
    write_matches(rows.union(rows), "matched_roads")
    assert spark.table("matched_roads").count() == 2
    segments = spark.createDataFrame(
        [("u", 1, 45.0, 9.0, 1, 1, 1.0, 1.0, 1.0, 0, 0.5, 1, 1, "{}", "in")],
        "customid string, timest int, latitude double, longitude double, accuracy int, timediff int, "
        "spacediff double, speed double, speeddiff double, trajid int, rnd double, weekday int, dayhour int, "
        "geojson string, status string",
    )
    write_segments(segments, "segmented_points")
    write_segments(segments, "segmented_points")
    assert spark.table("segmented_points").count() == 1


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("u", ["a", "b"])], "customid string, roads array<string>")
    path = str(tmp_path / "out")
    write_csv(df, path)
    got = spark.read.option("header", True).option("escape", "\\").csv(path).collect()
    assert [tuple(r) for r in got] == [("u", '["a","b"]')]


def test_staged_tables_lie_in_the_shared_folder(spark):
    rows = staged(spark.range(10))
    assert rows.count() == 10
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named.rstrip("/") in shared_folder(spark)


def test_load_job_makes_a_table(spark, tmp_path):
    run_load(spark, ["nodes", written(tmp_path, NODES), "loaded_nodes"])
    assert read_nodes(spark, "loaded_nodes").count() == 3


DAMAGED = WAYS + """way-9,33,2022-01-01T00:00:00Z,perhaps,1,x,{"lit":"no"},["p7"]
way-10,34

way-11,35,2022-01-01T00:00:00Z,true,2,101,{"lit":"no",["p7"]
,36,2022-01-01T00:00:00Z,true,2,101,{},[]
"""
FAULTS = {
    "way-9": ["isvisible", "changesetid"],
    "way-10": ["timestamp", "isvisible", "version", "changesetid", "tags", "nodes"],
    "way-11": ["tags", "nodes"],
}


def test_faulty_lines_are_named_and_counted(spark, tmp_path):
    counts = Counts("ways")
    checked = checked_text(spark.read.text(written(tmp_path, DAMAGED)), "ways", counts)
    rows = checked.collect()
    assert {r.id: r.faults for r in rows if r.faults} == FAULTS
    assert [r.value for r in rows if r.id == "way-10"] == ["way-10,34"]
    got = counts.get()
    assert (got["lines"], got["faulty_lines"], got["tags"], got["isvisible"], got["userid"]) == (6, 3, 2, 2, 0)


def test_good_and_faulty_lines_become_two_tables(spark, tmp_path):
    got = write_checked_text(spark.read.text(written(tmp_path, DAMAGED)), "ways", "some_checked_ways")
    assert (got["lines"], got["faulty_lines"]) == (6, 3)
    assert {r.id for r in read_ways(spark, "some_checked_ways").collect()} == {"way-7", "way-8", ""}
    rejects = spark.table("some_checked_ways_rejects").collect()
    assert {r.value.split(",")[0]: r.faults for r in rejects} == FAULTS
    run_load(spark, ["ways", written(tmp_path, ""), "some_checked_ways", "checked"])
    assert spark.table("some_checked_ways").count() == spark.table("some_checked_ways_rejects").count() == 0


POINTS = "customid string, trajid int, timest int, latitude double, longitude double, timediff int, spacediff double, " \
    "speed double, geojson string"


def test_a_day_is_replaced_alone(spark):
    day = 86400
    columns = [c.split()[0] for c in POINTS.split(", ")]

    def rows(*points):
        return spark.createDataFrame([(u, 0, t, 45.0, 9.0, 1, 1.0, s, "{}") for u, t, s in points], POINTS)

    def table():
        return sorted((r.customid, r.timest, r.speed, str(r.day)) for r in spark.table("daily_points").collect())

    spark.sql("DROP TABLE IF EXISTS daily_points")
    write_daily(rows(("a", day - 1, 1.0), ("a", day, 2.0), ("b", day + 5, 3.0), ("c", 3 * day, 4.0)), "daily_points", columns, 4)
    write_daily(rows(("a", day + 1, 9.0)), "daily_points", columns, 4)
    expected = [("a", day - 1, 1.0, "1970-01-01"), ("a", day + 1, 9.0, "1970-01-02"), ("c", 3 * day, 4.0, "1970-01-04")]
    assert table() == expected
    write_daily(rows(), "daily_points", columns)
    assert table() == expected
    plan = spark.table("daily_points").where("day = date'1970-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    good = quality_trajectories(spark.table("daily_points"))._jdf.queryExecution().executedPlan().toString()
    # Bucketed by trajectory, the limits meet their points where they lie.
    assert "Exchange hashpartitioning" not in good
