"""Connected components as joins: edges become stars around the smallest node, round by round."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "edges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """``a`` and its component's smallest node ``b`` for every node but the smallest. ``edges`` are pairs a, b of any
    type that has an order.

    Each round links all larger neighbours of a node to its smallest one, then all smaller ones, until nothing
    changes. Only minima travel by node, so a node with many edges is aggregated before it is shuffled."""
    e = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(e)
    while before.n:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = _written(small.union(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e
