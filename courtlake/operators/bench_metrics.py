"""Scores against labelled clips, and the release gates."""
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import nearest_within, greedy_match, nearest_time
from .tiles import as_list, quantiles, rows_of, shared, tile_scan, with_totals

RALLY = ("job_id", "rally_index")

# Gate name, threshold, whether higher is better.
RELEASE_GATES = [
    ("shuttle_f1", 0.87, True),
    ("shuttle_teleports_per_1000", 1.0, False),
    ("player_exact_count_frac", 0.90, True),
    ("player_overcount_frac", 0.02, False),
    ("player_id_switches_per_track", 1.0, False),
    ("pose_pck05_near", 0.85, True),
    ("pose_pck05_far", 0.70, True),
    ("d3_below_floor_accepted", 0.0, False),
    ("d3_landing_median_m", 0.35, False),
    ("d3_speed_mape", 0.15, False),
]


def shuttle_f1(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = RALLY, tol_px: float = 10.0, wh: tuple[int, int] = (512, 288),
               fps: float = 30.0, id: str = "id") -> DataFrame:
    """AGG-15: precision, recall, F1 of points matched in time and within ``tol_px``."""
    keys = as_list(keys)
    pred = shared(pred.select(*keys, "t", id, "x", "y"), [*keys, "t"])
    vis = shared(gt.filter(F.coalesce("visible", F.lit(True))).select(*keys, "t", id, "x", "y"), [*keys, "t"])
    m = greedy_match(pred, vis, keys, 0.5 / max(fps, 1.0), id)
    m = m.join(pred.select(*keys, F.col(id).alias("pred_id"), F.struct("x", "y").alias("_p")), [*keys, "pred_id"])
    m = m.join(vis.select(*keys, F.col(id).alias("gt_id"), F.struct("x", "y").alias("_g")), [*keys, "gt_id"])
    near = F.hypot((F.col("_p.x") - F.col("_g.x")) * wh[0], (F.col("_p.y") - F.col("_g.y")) * wh[1]) <= tol_px
    tp = m.filter(near).groupBy(*keys).agg(F.count("*").alias("tp"))
    n = pred.groupBy(*keys).agg(rows_of("x").alias("n_pred")).join(vis.groupBy(*keys).agg(rows_of("x").alias("n_visible")), keys, "full")
    d = n.join(tp, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "n_pred", "n_visible")})
    p = F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "n_visible"), F.lit(0.0))
    return d.select(*keys, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "tp", "n_pred", "n_visible")


def paired_frames(pred: DataFrame, gt: DataFrame, keys: list, tol: float) -> DataFrame:
    """Labelled frame times and the predicted frame time nearest to each (null beyond ``tol``)."""
    g, p = (d.select(*keys, "t").distinct() for d in (gt, pred))
    return nearest_time(g, p, keys, tol).select(*keys, "t", F.col("r_t").alias("pt"))


def count_metrics(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = RALLY, tol: float = 0.12) -> DataFrame:
    """AGG-16: share of labelled frames with the exact and with too high a player count."""
    keys = as_list(keys)
    pairs = paired_frames(pred, gt, keys, tol)
    gn = gt.groupBy(*keys, "t").agg(F.count("*").alias("gn"))
    pn = pred.groupBy(*keys, F.col("t").alias("pt")).agg(F.count("*").alias("pn"))
    d = pairs.join(gn, [*keys, "t"]).join(pn, [*keys, "pt"], "left").withColumn("pn", F.coalesce("pn", F.lit(0)))
    return d.groupBy(*keys).agg(F.avg((F.col("pn") == F.col("gn")).cast("double")).alias("exact_count_frac"),
                                F.avg((F.col("pn") > F.col("gn")).cast("double")).alias("overcount_frac"), F.count("*").alias("n_frames"))


def _paired_boxes(pred: DataFrame, gt: DataFrame, keys: list, tol: float, dist: float) -> DataFrame:
    pairs = paired_frames(pred, gt, keys, tol).filter("pt is not null")
    g = gt.withColumnRenamed("id", "gt_id").join(pairs, [*keys, "t"])
    return nearest_within(g, pred.withColumnRenamed("t", "pt"), [*keys, "pt"], dist, ["t", "gt_id"], "id")


def id_switches(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = RALLY, tol: float = 0.12, dist: float = 0.12) -> DataFrame:
    """AGG-16: how often the predicted id on a labelled player changes."""
    keys = as_list(keys)
    m = _paired_boxes(pred, gt, keys, tol, dist).select(*keys, "gt_id", "t", F.col("p.id").alias("pid"))
    m = tile_scan(m, [*keys, "gt_id"], "t", prev={"_p": F.struct("pid")})
    per = m.groupBy(*keys, "gt_id").agg(F.count_if(F.col("_p").isNotNull() & ~F.col("_p.pid").eqNullSafe(F.col("pid"))).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("switches"), F.count("*").alias("tracks_matched")).withColumn(
        "switches_per_track", F.col("switches") / F.col("tracks_matched"))


def pck(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = RALLY, thr: float = 0.05, tol: float = 0.12, dist: float = 0.2) -> DataFrame:
    """AGG-16: share of joints within ``thr`` body heights, near and far half. People carry id, x, y, h and
    keypoints; near means at least the upper median labelled height."""
    keys = as_list(keys)
    m = _paired_boxes(pred, gt, keys, tol, dist).join(quantiles(gt, keys, "h", {"_mid": "upper"}), keys)
    side = F.when(F.col("h") >= F.col("_mid"), "near").otherwise("far")
    scale = F.greatest(F.col("h"), F.lit(1e-6))
    joints = F.filter(F.arrays_zip("keypoints", F.col("p.keypoints").alias("q")), lambda z: z["keypoints"].isNotNull() & z["q"].isNotNull())
    hit = F.filter(joints, lambda z: F.hypot(z["q"]["x"] - z["keypoints"]["x"], z["q"]["y"] - z["keypoints"]["y"]) <= thr * scale)
    d = m.groupBy(*keys, side.alias("side")).agg(F.sum(F.size(hit)).alias("hits"), F.sum(F.size(joints)).alias("total"))
    return d.withColumn("pck", F.try_divide("hits", "total"))


def d3_health(shots: DataFrame, samples: DataFrame, keys: Sequence[str] = ("job_id",), shot: str = "shot_id") -> DataFrame:
    """AGG-17: accepted shots, and those that dip below the floor."""
    keys = as_list(keys)
    low = samples.groupBy(*keys, shot).agg((F.min("z") < -0.05).alias("_low"))
    d = shots.filter(F.col("gate").isNull()).join(low, [*keys, shot], "left")
    return d.groupBy(*keys).agg(F.count("*").alias("accepted"), F.count_if("_low").alias("below_floor_accepted"))


def match_shots(shots: DataFrame, labels: DataFrame, keys: Sequence[str] = ("job_id",), tol: float = 0.4) -> DataFrame:
    """JOIN-19: nearest shot to each labelled hit. ``shots``: t, shot_id, speed_kmh, last_x, last_y;
    ``labels``: t, label_id, speed, land_x, land_y."""
    return nearest_time(labels, shots, keys, tol, order=["shot_id"]).filter("dt is not null")


def d3_error(matched: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """AGG-17: upper-median landing error and mean relative speed error of matched shots."""
    keys = as_list(keys)
    d = matched.withColumns({
        "_land": F.when(F.col("land_x").isNotNull(), F.hypot(F.col("r_last_x") - F.col("land_x"), F.col("r_last_y") - F.col("land_y"))),
        "_ape": F.when(F.col("speed") != 0, F.abs(F.col("r_speed_kmh") - F.col("speed")) / F.greatest(F.col("speed"), F.lit(1e-6)))})
    d = cut_lineage(d.select(*keys, "_land", "_ape"))       # a row per label, read three times
    g = d.groupBy(*keys).agg(F.avg("_ape").alias("speed_mape"), F.count("_ape").alias("_a"), F.count("_land").alias("_l"))
    return g.join(quantiles(d, keys, "_land", {"landing_median_m": "upper"}), keys, "left").select(
        *keys, "landing_median_m", "speed_mape", F.coalesce(F.nullif("_a", F.lit(0)), "_l").alias("matched"))


def gate_report(metrics: DataFrame, keys: Sequence[str] = ("clip", "rally"), gates: list = RELEASE_GATES) -> DataFrame:
    """AGG-18: one row per gate (null without labels) and whether everything measured passed."""
    keys = as_list(keys)
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(float(v)).alias("threshold"),
                                        F.lit(up).alias("higher")) for n, v, up in gates]))
    d = metrics.select(*keys, cells)
    passed = F.when(F.col("higher"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    d = d.withColumn("passed", passed).drop("higher")
    return with_totals(d, keys, all_passed=F.coalesce(F.bool_and("passed"), F.lit(True)))
