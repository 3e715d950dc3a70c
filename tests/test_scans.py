"""Each logical input is read once: what several steps need comes from one exchange. Static plans, without adaptive execution,
so that reuse shows."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtlake.operators.tiles import TILE, lay_out, quantiles, shared, tile_scan, value_tile

#: Scans of queries that chain ordered scans: one per input table, adapter or derived table they are given.
MOST = {"flight_segments": 1, "split_shots": 1, "sharpest_turn": 1, "teleports": 1, "exact_quantiles": 1, "merge_overlaps": 1, "path_smoothness": 1,
        "trim_list": 2, "shot_gates": 2, "action_band": 2, "jerk_audit": 2, "nearest_time": 2, "interpolate_asof": 2, "eval_camera_plan": 2,
        "interpolate_boxes_by_id": 4, "interpolate_poses_by_id": 4, "map_reel_to_source": 4, "map_source_to_reel": 4, "slice_keyframes": 4, "shuttle_f1": 4,
        "ramp_and_switch": 3, "ema_and_rate_limit": 3, "one_euro": 2, "timeline": 4, "refine_with_audio": 5, "corner_consensus": 7}


@pytest.fixture
def static(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_queries(static, sf_dir):
    scans = {name: plan(entry.queries()[name](static, sf_dir)).count("FileScan") for name in MOST}
    assert {n: k for n, k in scans.items() if k > MOST[n]} == {}


def test_chained_scans_read_once(static, sf_dir):
    d = lay_out(static.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.floor(F.col("event_id") / 1000))
    d = tile_scan(d, ["user_id"], "event_id", cmax={"m": F.col("value")}, nxt={"n": F.col("value")})
    d = tile_scan(d, ["user_id"], "event_id", csum={"c": (F.col("value") > F.col("m")).cast("int")}, total={"all": F.lit(1)})
    p = plan(d.drop(TILE).select("event_id", "c"))                  # whatever is selected later
    assert p.count("FileScan") == 1 and p.count("REPARTITION_BY_COL") == 1 + len(re.findall(r"ReusedExchange.*REPARTITION_BY_COL", p))
    got = d.groupBy("user_id").agg(F.max("c").alias("c"), F.max("all").alias("n"))
    rows = {}
    for r in static.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        rows.setdefault(r.user_id, []).append(r.value)
    want = {u: (sum(v > max(vs[:i]) for i, v in enumerate(vs) if i), len(vs)) for u, vs in rows.items()}
    assert {r.user_id: (r.c, r.n) for r in got.collect()} == want


def test_shared_rows_are_read_once_by_all(static, sf_dir):
    d = shared(static.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderkey"])
    g = d.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    p = plan(d.join(g, "o_custkey").select("o_orderkey", (F.col("o_totalprice") == F.col("top")).alias("is_top")))
    assert p.count("FileScan") == 1 and "ReusedExchange" in p


def test_rows_without_key_or_time_go(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (None, 1.0, 3.0), (1, None, 4.0), (1, 2.0, None)], "k long, t double, v double")
    got = tile_scan(d, ["k"], "t", csum={"c": F.col("v")}, ffill={"f": F.col("v")}).collect()
    assert sorted((r.t, r.c, r.f) for r in got) == [(1.0, 2.0, 2.0), (2.0, 2.0, 2.0)]


def test_small_values_spread(spark):
    """A hot group of tiny values: no tile, and so no task of the last step, holds more than a small share of them."""
    d = spark.range(200_000).select(F.lit(1).alias("k"), (F.xxhash64("id") / 2.0**63 * 5e-4 + 5e-4).alias("v"))
    share = d.groupBy(value_tile("v")).count().agg(F.max("count") / F.sum("count"), F.count("*")).first()
    assert share[0] < 0.005 and share[1] > 1000
    v = np.sort([r.v for r in d.select("v").collect()])
    got = quantiles(d, ["k"], "v", {"lo": 0.0, "mid": 0.5, "p99": 0.99, "hi": 1.0, "up": "upper", "n": "count"}).first()
    assert [got.lo, got.mid, got.p99, got.hi] == pytest.approx([v[0], *np.percentile(v, [50, 99]), v[-1]], rel=1e-14)
    assert got.up == v[len(v) // 2] and got.n == len(v)


def test_tiles_keep_the_order_of_values(spark):
    v = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, 1.0000001, -1.0, -2.5, 3.5e9, -1e300, 1.7e308, 0.1, 0.2, 0.30000000000000004]
    got = spark.createDataFrame([(x,) for x in v], "v double").select("v", value_tile("v").alias("i")).orderBy("v").collect()
    assert [r.i for r in got] == sorted(r.i for r in got)


def test_several_columns_at_once(static):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(a) if a > 0.1 else None, float(b), None if k == 2 else 7.0) for k, a, b in zip(rng.integers(0, 4, 900), rng.random(900), rng.integers(-3, 4, 900) / 7)]
    d = static.createDataFrame(rows, "k long, a double, b double, c double")
    q = quantiles(d, ["k"], {"a": {"a5": 0.05, "na": "count"}, "b": {"b50": 0.5, "bu": "upper"}, "c": {"c1": 0.3, "nc": "count"}})
    for r in q.collect():
        a, b, c = ([x[i] for x in rows if x[0] == r.k and x[i] is not None] for i in (1, 2, 3))
        assert r.na == len(a) and r.a5 == pytest.approx(np.percentile(a, 5)) and r.b50 == pytest.approx(np.median(b)) and r.bu == sorted(b)[len(b) // 2]
        assert r.nc == len(c) and r.c1 == (7.0 if c else None)
    assert plan(q).count("Scan ExistingRDD") == 1
