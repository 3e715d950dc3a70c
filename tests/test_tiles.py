"""Tiled scans equal plain windows, whatever the tiles, the partitioning or the skew."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtlake.operators.folds import tiled_fold
from courtlake.operators.tiles import quantiles, row_index, sessionize, tile_scan, top_n


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    d = spark.range(6000).selectExpr("case when id % 3 = 0 then 0 else id % 41 + 1 end as k", "id as pid", "(id * 7919 % 6007) / 7e0 as t", "(id * 31 % 101) / 10e0 as v")
    return d.cache()


def test_all_scans_equal_plain_windows(skewed):
    w = Window.partitionBy("k").orderBy("t", "pid")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.when(F.col("v") > 5, F.col("v"))
    plain = skewed.select("k", "pid", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("pid").over(up).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                          F.last(v, True).over(up).alias("f"), F.first(v, True).over(down).alias("b"), F.sum("pid").over(Window.partitionBy("k")).alias("z"))
    tiled = tile_scan(skewed, ["k"], "t", tie=["pid"], prev={"p": F.col("v")}, nxt={"n": F.col("v")}, csum={"s": F.col("pid")}, cmax={"m": F.col("v")}, ffill={"f": v}, bfill={"b": v},
                      total={"z": F.col("pid")}, tile=F.floor(F.col("t") / 13)).select(*plain.columns)
    assert plain.exceptAll(tiled).count() == 0 and tiled.exceptAll(plain).count() == 0


@pytest.mark.parametrize("width", [0.5, 40.0, 1e9])
def test_segments_do_not_depend_on_tiles(skewed, width):
    w = Window.partitionBy("k").orderBy("t", "pid")
    d = skewed.withColumn("b", (F.col("t") - F.lag("t").over(w) > 0.4).cast("int"))
    plain = d.select("k", "pid", F.coalesce(F.sum("b").over(w), F.lit(0)).alias("seg"))
    tiled = sessionize(skewed, ["k"], "t", 0.4, tie=["pid"], tile=F.floor(F.col("t") / width)).select("k", "pid", "seg")
    assert plain.exceptAll(tiled).count() == 0


def test_partitioning_does_not_matter(skewed):
    one, many = (sessionize(skewed.repartition(n), ["k"], "t", 0.4, tie=["pid"]).select("k", "pid", "seg") for n in (1, 200))
    assert one.exceptAll(many).count() == 0


def test_hot_key_spreads_over_tasks(skewed):
    skewed.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # which merges partitions as small as these
    d = sessionize(skewed, ["k"], "t", 0.4, tie=["pid"], tile=F.floor(F.col("t") / 20)).filter("k = 0")
    parts = d.select(F.spark_partition_id().alias("p")).distinct().count()
    skewed.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 3


def test_quantiles_equal_builtin(skewed):
    q = quantiles(skewed, ["k"], "v", {"up": "upper", "p50": 0.5, "p92": 0.92})
    b = skewed.groupBy("k").agg(F.get(F.sort_array(F.collect_list("v")), F.floor(F.count("v") / 2).cast("int")).alias("up"), F.expr("percentile(v, 0.5)").alias("p50"), F.expr("percentile(v, 0.92)").alias("p92"))
    j = q.join(b.withColumnsRenamed({"up": "bu", "p50": "b5", "p92": "b9"}), "k")
    assert j.filter("up <> bu or abs(p50 - b5) > 1e-9 or abs(p92 - b9) > 1e-9").count() == 0 and j.count() == b.count()


def test_quantiles_of_negative_and_constant_values(spark):
    d = spark.createDataFrame([(1, -5.0), (1, -0.5), (1, 0.0), (1, 3.0), (2, 7.0), (2, 7.0)], "k int, v double")
    got = {r.k: (r.up, r.mid) for r in quantiles(d, ["k"], "v", {"up": "upper", "mid": 0.5}).collect()}
    assert got == {1: (0.0, -0.25), 2: (7.0, 7.0)}


def test_row_index_and_top_n(skewed):
    assert row_index(skewed, ["k"], "t", tie=["pid"]).groupBy("k").agg((F.max("idx") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0
    assert top_n(skewed, ["k"], [F.desc("v"), F.asc("pid")], 2).groupBy("k").count().filter("count > 2").count() == 0


def test_tiled_fold_equals_one_walk(skewed):
    d = row_index(skewed, ["k"], "t", tie=["pid"], out="i")
    args = dict(idx="i", summarize=lambda rs: [sum(v for _, v in rs)], advance=lambda s, f: [s[0] + f[0]], walk=lambda s, r: ([s[0] + r[1]], (r[0], s[0] + r[1])),
                start=lambda r: [0.0], state="array<double>", schema="pid long, run double", cols=["pid", "v"])
    small, whole = (tiled_fold(d, ["k"], size=n, **args) for n in (7, 10**9))
    assert small.join(whole.withColumnRenamed("run", "w"), ["k", "pid"]).filter("abs(run - w) > 1e-6").count() == 0
