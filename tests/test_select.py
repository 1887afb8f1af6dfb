from roadtrace.operators.select import centre_counts, quality_trajectories, top_trajectories
from roadtrace.sources.readers import TRAJECTORY_SCHEMA


def trajectory(n, user="u", number=0, speed=40.0, space=50.0, lat=45.45, lon=9.15):
    return [
        (user, number, k, lat, lon, 5, space, speed, f'{{"type":"Point","coordinates":[{lon},{lat}]}}')
        for k in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, TRAJECTORY_SCHEMA)


def test_twenty_six_points_are_enough(spark):
    rows = trajectory(25, "short") + trajectory(26, "long")
    assert {r.customid for r in quality_trajectories(frame(spark, rows)).collect()} == {"long"}


def test_standing_points_do_not_count(spark):
    rows = trajectory(25, "u") + [r[:7] + (0.0, r[8]) for r in trajectory(5, "u")]
    assert quality_trajectories(frame(spark, rows)).count() == 0


def test_slow_or_crowded_trajectories_are_dropped(spark):
    rows = trajectory(30, "slow", speed=25.0) + trajectory(30, "crowded", space=0.01) + trajectory(30, "ok", speed=25.1)
    assert {r.customid for r in quality_trajectories(frame(spark, rows)).collect()} == {"ok"}


def test_top_by_points_in_the_centre_with_ties_by_id(spark):
    rows = (
        trajectory(3, "c")
        + trajectory(3, "b")
        + trajectory(5, "a", number=1)
        + trajectory(9, "out", lat=45.52)
        + trajectory(2, "out", lat=45.4370, lon=9.2344)
    )
    df = frame(spark, rows)
    top = top_trajectories(df, 2)
    assert {(r.customid, r.trajid) for r in top.collect()} == {("a", 1), ("b", 0)}
    counts = {r.customid: r.n_inside for r in centre_counts(df).collect()}
    assert counts == {"a": 5, "b": 3, "c": 3, "out": 2}
    assert top_trajectories(df, 4).count() == df.count()


def test_incomplete_rows_are_not_counted(spark):
    rows = trajectory(3, "a") + [("b", 0, 1, 45.45, 9.15, None, 1.0, 1.0, "x")] * 5
    counts = {r.customid: r.n_inside for r in centre_counts(frame(spark, rows)).collect()}
    assert counts == {"a": 3, "b": 0}
