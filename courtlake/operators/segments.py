"""Point tracks cut into flights and shots, and their kinematics."""
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import centroid, turn_cos
from .tiles import TILE, as_list, lay_out, quantiles, row_index, sessionize, sorted_upper, tile_scan, with_totals

RALLY = ("job_id", "rally_index")


def flight_segments(points: DataFrame, keys: Sequence[str] = RALLY, gap: float = 0.25, min_conf: float = 0.3,
                    min_speed: float = 0.15, min_dur: float = 0.4, tie: Sequence[str] = (), min_points: int = 3, small: bool = False) -> DataFrame:
    """WIN-4: contiguous flights with median and top speed, and whether the shuttle was in play. ``small``: each track fits into a task."""
    keys = as_list(keys)
    d = points.filter(F.coalesce("confidence", F.lit(1.0)) >= min_conf).select(*dict.fromkeys([*keys, "t", "x", "y", *tie]))
    d = tile_scan(d, keys, "t", tie=tie, break_on=["t"], breaks=lambda c, p: c("t") - p("t") > gap,
                  prev={"_p": F.struct("t", "x", "y")}, whole=small)
    dt = F.col("t") - F.col("_p.t")
    step = F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y"))
    d = d.select(*keys, "seg", "t", F.when((dt <= gap) & (dt > 1e-3), step / dt).alias("speed"))
    stats = d.groupBy(*keys, "seg").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("points"),
                                        F.max("speed").alias("max_speed"), *([sorted_upper("speed").alias("median_speed")] if small else []))
    out = stats.filter(F.col("points") >= min_points)
    if small:
        out = out.filter(F.col("median_speed").isNotNull())
    else:
        out = out.join(quantiles(d, [*keys, "seg"], "speed", {"median_speed": "upper"}), [*keys, "seg"])
    return out.withColumn("in_play", (F.col("median_speed") >= min_speed) & (F.col("end_s") - F.col("start_s") >= min_dur))


def split_shots(points: DataFrame, keys: Sequence[str] = RALLY, gap: float = 0.5, cos_max: float = 0.35, min_speed: float = 0.05,
                min_pts: int = 5, min_dur: float = 0.22, max_segs: int | None = None, min_conf: float = 0.3,
                tie: Sequence[str] = ()) -> DataFrame:
    """WIN-6: cut a track at detector gaps and at sharp turns; keep the long enough pieces, or the first
    ``max_segs`` of them."""
    keys = as_list(keys)
    d = lay_out(points.filter(F.coalesce("confidence", F.lit(1.0)) >= min_conf), keys, "t")
    d = tile_scan(d, keys, "t", tie=tie, prev={"_p": F.struct("t", "x", "y")})
    dt = F.col("t") - F.col("_p.t")
    within = dt <= gap
    per_s = F.greatest(dt, F.lit(1e-3))
    d = d.withColumns({"_dt": dt, "_vx": F.when(within, (F.col("x") - F.col("_p.x")) / per_s),
                       "_vy": F.when(within, (F.col("y") - F.col("_p.y")) / per_s)})

    def cut(c, p):
        moving = (F.hypot(c("_vx"), c("_vy")) > min_speed) & (F.hypot(p("_vx"), p("_vy")) > min_speed)
        turn = moving & (turn_cos(c("_vx"), c("_vy"), p("_vx"), p("_vy")) < cos_max)
        return (c("_dt") > gap) | F.coalesce(turn, F.lit(False))

    d = tile_scan(d, keys, "t", tie=tie, break_on=["_dt", "_vx", "_vy"], breaks=cut)
    segs = d.groupBy(*keys, "seg").agg(F.count("*").alias("_n"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    segs = segs.filter((F.col("_n") >= min_pts) & (F.col("_t1") - F.col("_t0") >= min_dur))
    shots = row_index(segs, keys, "seg", out="shot", tile=F.floor(F.col("seg") / 4096)).select(*keys, "seg", "shot")
    if max_segs is not None:
        shots = shots.filter(F.col("shot") < max_segs)
    return d.join(shots, [*keys, "seg"]).drop("_p", "_dt", "_vx", "_vy", "seg", TILE)


def sharpest_turn(points: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """WIN-7: position of the strongest direction change strictly inside each group (0 without one)."""
    keys = as_list(keys)
    d = tile_scan(points.select(*dict.fromkeys([*keys, "t", "x", "y", *tie])), keys, "t", tie=tie, prev={"_p": F.struct("x", "y")}, nxt={"_n": F.struct("x", "y")},
                  csum={"_i": F.lit(1)})
    ax, ay = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")
    bx, by = F.col("_n.x") - F.col("x"), F.col("_n.y") - F.col("y")
    still = (F.hypot(ax, ay) < 1e-6) | (F.hypot(bx, by) < 1e-6)
    d = d.withColumn("_cos", F.when(~still, turn_cos(ax, ay, bx, by)))
    best = F.min_by(F.struct((F.col("_i") - 1).alias("i"), F.col("_cos").alias("c")),
                    F.when(F.col("_cos").isNotNull(), F.struct("_cos", "_i")))
    return d.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("points")).select(
        *keys, "points", F.coalesce("b.i", F.lit(0)).alias("turn_index"), F.col("b.c").alias("turn_cos"))


def teleports(points: DataFrame, keys: Sequence[str] = RALLY, fps: float = 30.0, jump: float = 0.22,
              tie: Sequence[str] = ()) -> DataFrame:
    """WIN-11: impossible jumps per 1000 points."""
    keys = as_list(keys)
    d = tile_scan(points.select(*dict.fromkeys([*keys, "t", "x", "y", *tie])), keys, "t", tie=tie, prev={"_p": F.struct("t", "x", "y")})
    hop = (F.col("t") - F.col("_p.t") <= 2.5 / max(fps, 1.0)) & (F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")) > jump)
    return d.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(hop).alias("teleports")).withColumn(
        "per_1000", F.when(F.col("points") < 2, 0.0).otherwise(1000.0 * F.col("teleports") / F.col("points")))


def trail(points: DataFrame, at: DataFrame, keys: Sequence[str] = RALLY, window: float = 0.7, max_dt: float = 0.35,
          max_jump: float = 0.22, min_conf: float = 0.3, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-37: the unbroken run of points that ends at each asked time."""
    from .intervals import events_in

    keys = as_list(keys)
    spans = at.withColumns({"_lo": F.col("at") - window, "_hi": F.col("at") + 1e-3})
    near = events_in(spans, points.filter(F.col("confidence") >= min_conf), keys, start="_lo", end="_hi", width=max(4 * window, 1.0))
    w = Window.partitionBy(*keys, "at").orderBy(F.desc("t"), *[F.desc(c) for c in tie])
    newer = F.lag(F.struct("t", "x", "y")).over(w)
    near = near.withColumn("_n", newer)
    broken = (F.col("_n.t") - F.col("t") > max_dt) | (F.hypot(F.col("_n.x") - F.col("x"), F.col("_n.y") - F.col("y")) > max_jump)
    near = near.withColumn("_cut", F.sum(F.coalesce(broken.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return near.filter(F.col("_cut") == 0).drop("_lo", "_hi", "_n", "_cut")


def wrist_series(poses: DataFrame, keys: Sequence[str] = RALLY, min_conf: float = 0.15) -> DataFrame:
    """WIN-38: wrist positions per player, from people rows with a keypoint array (COCO 9 left, 10 right)."""
    keys = as_list(keys)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.get("keypoints", F.lit(i)).alias("kp")) for s, i in (("l", 9), ("r", 10))]))
    d = poses.filter(F.col("player_id").isNotNull() & (F.size("keypoints") >= 11)).select(*keys, "player_id", "t", sides.alias("s"))
    return d.filter(F.col("s.kp.confidence") >= min_conf).select(
        *keys, "player_id", "t", "s.side", F.col("s.kp.x").alias("x"), F.col("s.kp.y").alias("y"))


def side_court_gate(points: DataFrame, courts: DataFrame, keys: Sequence[str] = RALLY, court_key: str = "job_id",
                    expand: float = 1.35, margin: float = 0.03, min_inside: float = 0.5, gap: float = 0.35,
                    no_opinion: float = 0.9, tie: Sequence[str] = ()) -> DataFrame:
    """PRJ-17: drop flights mostly beside the main court. No corners, or a court across the frame: no opinion."""
    keys = as_list(keys)
    cx, _ = centroid("corners")
    xs = F.transform("corners", lambda p: cx + (p[0] - cx) * expand)
    lo = F.greatest(F.lit(0.0), F.array_min(xs) - margin)
    hi = F.least(F.lit(1.0), F.array_max(xs) + margin)
    bounds = courts.select(court_key, lo.alias("_lo"), hi.alias("_hi")).filter(F.col("_hi") - F.col("_lo") < no_opinion)
    d = sessionize(points, keys, "t", gap, tie=tie, seg="_seg").join(bounds, court_key, "left")
    inside = F.col("x").between(F.col("_lo"), F.col("_hi"))
    d = with_totals(d, [*keys, "_seg"], _share=F.avg(inside.cast("double")))
    return d.filter(F.col("_lo").isNull() | (F.col("_share") >= min_inside)).select(*points.columns)


def distinct_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET-4."""
    return df.select(*cols).distinct()
