"""Bounded public views of dense tracks."""
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold
from .identity import stride
from .tiles import as_list, sessionize, tile_scan, with_totals

RALLY = ("job_id", "rally_index")

__all__ = ["thin", "stride", "flatten_tracks", "public_view"]


def thin(points: DataFrame, keys: Sequence[str] = RALLY, hz: float = 12.5, gap: float = 0.25, max_points: int | None = None,
         tie: Sequence[str] = ()) -> DataFrame:
    """WIN-21: thin flights to ``hz`` but keep their first and last points, so dropouts stay visible. Above
    ``max_points``, off by default, the interval widens; no flight is cut off. The next due time depends on the
    last emitted point, and every flight emits its first, so the walk runs per flight."""
    keys = as_list(keys)
    d = tile_scan(points, keys, "t", tie=tie, break_on=["t"], breaks=lambda c, p: c("t") - p("t") > gap, seg="_piece", nxt={"_nt": F.col("t")})
    d = d.withColumn("_last", F.coalesce(F.col("_nt") - F.col("t") > gap, F.lit(True))).drop("_nt")
    cols = [c for c in points.columns if c not in keys]
    it, schema = cols.index("t"), ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in cols)

    def walk(rows):
        due_from = None
        for *r, last, every in rows:
            if due_from is None or last or r[it] - due_from >= every:
                due_from = r[it]
                yield tuple(r)

    def emit(d: DataFrame) -> DataFrame:
        return ordered_fold(d, [*keys, "_piece"], ["t", *tie], walk, schema, [*cols, "_last", "_every"])

    base = emit(d.withColumn("_every", F.lit(1.0 / max(hz, 1.0))))
    if max_points is None:
        return base.select(*points.columns)
    size = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    over = size.filter(F.col("_n") > max_points).select(
        *keys, F.greatest(F.lit(1.0 / max(hz, 1.0)), F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1e-6)) / max_points).alias("_every"))
    wide = emit(d.join(over, keys))
    return base.join(over, keys, "left_anti").select(*points.columns).union(wide.select(*points.columns))


def flatten_tracks(points: DataFrame, boxes: DataFrame, people: DataFrame, keys: Sequence[str] = RALLY) -> DataFrame:
    """JOIN-21: shuttle points, people and, for rallies without people, boxes as one table."""
    keys = as_list(keys)
    shuttle = points.select(*keys, "t", F.lit("shuttle").alias("kind"), F.lit(None).cast("long").alias("id"), "x", "y", "confidence")
    pose = people.select(*keys, "t", F.lit("person").alias("kind"), F.col("id").cast("long").alias("id"), "x", "y", "confidence")
    spare = boxes.join(people.select(*keys).distinct(), keys, "left_anti").select(
        *keys, "t", F.lit("box").alias("kind"), F.col("id").cast("long").alias("id"), "x", "y", "confidence")
    return shuttle.unionByName(pose).unionByName(spare)


def public_view(rallies: DataFrame, light: bool = False, heavy: Sequence[str] = ("shuttle", "players", "poses", "racquets")) -> DataFrame:
    """PRJ-8: list views drop the track arrays, which Catalyst then never reads."""
    return rallies.drop(*heavy) if light else rallies


def sessions(points: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    return sessionize(points, keys, "t", gap)
