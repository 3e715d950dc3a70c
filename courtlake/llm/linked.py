"""Components of linked nodes, as joins: every round hangs each node's larger neighbours on its smallest one, then its
smaller ones, until only stars are left."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _hung(pairs: DataFrame, on: str) -> DataFrame:
    """``node, low``: the smallest of each node's partners in ``on`` and itself. Minima are taken map-side."""
    return pairs.groupBy(F.col(on).alias("node")).agg(F.min("low").alias("low"))


def _print(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``high, low`` for every node but the smallest of its component: the node and that smallest one."""
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    seen = _print(edges)
    while seen.n:
        both = edges.select(F.col("high").alias("node"), "low", F.lit(False).alias("up")).union(edges.select(F.col("low").alias("node"), F.col("high").alias("low"), F.lit(True).alias("up")))
        least = both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("least"))
        up = both.where("up").join(least, "node").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()
        down = _hung(up, "high")
        edges = stored(up.join(down.withColumnsRenamed({"node": "high", "low": "least"}), "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
                       .union(down.select(F.col("node").alias("high"), "low")).distinct(), "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges
