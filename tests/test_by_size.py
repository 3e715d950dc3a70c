"""Rows of small groups lie together before they are widened; large groups are spread as before."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtlake.operators import identity
from courtlake.operators.court import corner_medians
from courtlake.operators.identity import accept_worker_ids
from courtlake.operators.segments import flight_segments
from courtlake.operators.tiles import by_size, shared, tile_scan
from courtlake.plans import q_court, q_identity, q_sources
from courtlake.plans.q_quality import hits
from courtlake.sources import tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def noisy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for job, n in ((1, 40), (2, 1), (3, 301), (4, 6), (None, 5)):
        for _ in range(n):
            quad = [[float(x) for x in rng.integers(0, 30, 2) / 7] for _ in range(4)]
            if rng.random() < 0.2:
                quad[1][0] = None
            rows.append((job, quad))
    rows.append((5, [[None, None]] * 4))
    return spark.createDataFrame(rows, "job_id long, corners array<array<double>>")


def test_medians_of_small_groups_equal_those_of_large_ones(spark):
    d = noisy(spark)
    small, large = by_size(d, "job_id", 100)
    assert {r.job_id for r in small.select("job_id").collect()} == {1, 2, 4, 5} and {r.job_id for r in large.select("job_id").collect()} == {3}
    assert by_size(d, "job_id")[1] is None
    want = {r.job_id: r for r in corner_medians(d).collect()}
    got = corner_medians(small, small=True).unionByName(corner_medians(large)).collect()
    assert {r.job_id for r in got} == {j for j in want if j is not None}
    for r in got:
        w = want[r.job_id]
        assert (r.corners, r.found) == (w.corners, w.found) and r.spread == pytest.approx(w.spread)


def test_corner_consensus_ships_order_lines_instead_of_values(spark, sf_dir):
    for name in ("corner_consensus", "corner_consensus_cv"):
        assert "Explode" not in plan(entry.queries()[name](spark, sf_dir)) and "explode" not in plan(entry.queries()[name](spark, sf_dir))


def test_whole_scans_equal_tiled_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k) if k else None, float(t) / 4 if t else None, i, float(v) if v > 0.2 else None) for i, (k, t, v) in enumerate(zip(rng.integers(0, 4, 600), rng.integers(0, 300, 600), rng.random(600)))]
    d = spark.createDataFrame(rows, "k long, t double, i long, v double")
    v = F.col("v")
    how = dict(tie=["i"], prev={"p": v}, nxt={"n": v}, csum={"c": v}, total={"all": v}, cmax={"m": v}, ffill={"f": v}, bfill={"b": v}, break_on=["t", "v"], breaks=lambda c, p: (c("t") - p("t") > 0.5) | (c("v") > p("v")))
    tiled, whole = (sorted((r.asDict() for r in tile_scan(d, ["k"], "t", **how, **more).collect()), key=lambda r: r["i"]) for more in ({}, {"whole": True}))
    assert len(tiled) == len(whole) and [list(r) for r in tiled] == [list(r) for r in whole]
    for a, b in zip(tiled, whole):
        assert b == {c: x if x is None or isinstance(x, int) else pytest.approx(x) for c, x in a.items()}


def test_flights_and_verdicts_of_small_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), i, float(t) / 20, float(x), float(y), float(c), int(n) if n else None) for i, (k, t, x, y, c, n) in enumerate(zip(
        rng.integers(0, 3, 500), rng.integers(0, 900, 500), rng.random(500), rng.random(500), rng.random(500), rng.integers(0, 3, 500)))]
    d = spark.createDataFrame(rows, "job_id long, det_id long, t double, x double, y double, confidence double, track_id long").selectExpr("*", "x as cx", "y as cy")
    for f in (lambda **a: flight_segments(d, ["job_id"], tie=["det_id"], **a), lambda **a: accept_worker_ids(d, ["job_id"], tie=["det_id"], **a)):
        assert sorted(map(str, f(small=True).collect())) == sorted(map(str, f().collect())) != []


def test_player_ids_store_only_what_merging_reads(spark, sf_dir, monkeypatch):
    given, real = [], identity.stored_rows
    monkeypatch.setattr(identity, "stored_rows", lambda df, name: (given.append(df), real(df, name))[1])
    entry.queries()["assign_player_ids"](spark, sf_dir)
    assert [set(d.columns) for d in given] == [{"job_id", "det_id", "track_id", "t", "cx", "cy", "h", "accepted", "raw_id"}]


def test_hits_of_laid_lines_shuffle_nothing(spark, sf_dir):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        p = hits(spark, sf_dir, shared(lines, ["l_suppkey", "l_orderkey"], lines.count()))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in p and "ENSURE_REQUIREMENTS" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_reports_can_be_compressed(spark, tmp_path):
    d = spark.createDataFrame([(i, "n" * i) for i in range(1, 9)], "job_id long, note string")
    for tag, some in (("v1", d), ("v2", d.where("job_id < 4")), ("v2", d)):
        tables.write_reports(some, f"{tmp_path}/r", tag, buckets=2, compression="gzip")
    found = spark.read.schema("job_id long, note string, schema_tag string").json(f"{tmp_path}/r").drop("job_bucket").collect()
    assert sorted(map(tuple, found)) == [(i, "n" * i, "v2") for i in range(1, 9)]
    assert {p.suffix for p in tmp_path.rglob("part-*")} == {".gz"}
    tables.write_reports(d.where("job_id < 3").withColumn("note", F.lit("new")), f"{tmp_path}/r", "v2", buckets=2, refresh=True)
    again = spark.read.schema("job_id long, note string, schema_tag string").json(f"{tmp_path}/r").drop("job_bucket").collect()
    assert sorted(map(tuple, again)) == [(i, "new" if i < 3 else "n" * i, "v2") for i in range(1, 9)]


@pytest.mark.parametrize("name, most", [("corner_consensus", 600), ("assign_player_ids", 600), ("match_reports", 4)])
def test_large_groups_give_the_same_rows(spark, sf_dir, monkeypatch, name, most):
    rows = lambda: sorted(map(str, entry.queries()[name](spark, sf_dir).collect()))
    want, made = rows(), []
    monkeypatch.setattr(by_size, "__defaults__", (most,))
    for m in (q_court, q_identity, q_sources):
        monkeypatch.setattr(m, "by_size", lambda *a: made.append(by_size(*a)) or made[-1])
    assert rows() == want
    small, large = made[-1]
    assert small.count() and large.count()
