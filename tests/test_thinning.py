"""Rallies with more thinned points than any limit."""
from courtlake.operators import thinning


def _points(spark, n):
    return spark.createDataFrame([(1, 0, k, k / 8) for k in range(n)], "job_id int, rally_index int, pid long, t double")


def test_a_long_rally_is_thinned_whole(spark):
    got = thinning.thin(_points(spark, 3000), hz=8.0, gap=0.25, tie=["pid"]).collect()
    base = thinning.thin(_points(spark, 3000), hz=8.0, gap=0.25, max_points=10**9, tie=["pid"]).collect()
    assert len(got) > 2400 and sorted(got) == sorted(base)
    assert max(r.t for r in got) == 374.875


def test_a_limit_widens_the_interval_and_cuts_nothing_off(spark):
    got = thinning.thin(spark.createDataFrame([(1, 0, k, k * 1.0) for k in range(50)], "job_id int, rally_index int, pid long, t double"), gap=0.25, max_points=20, tie=["pid"]).collect()
    assert sorted(r.pid for r in got) == list(range(50))       # each point is a flight of its own
    assert len(thinning.thin(_points(spark, 3000), hz=8.0, max_points=100, tie=["pid"]).collect()) < 110
