"""Court geometry consensus, and players on the court plane."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import COURT_L, COURT_W, court_project, quad_homography, valid_corners, valid_quad
from ..functions.scalar import clamp
from .folds import ordered_fold
from .tiles import as_list, quantiles, sorted_median, tile_scan

RALLY = ("job_id", "rally_index")


def effective_corners(jobs: DataFrame, prior: DataFrame, key: str = "job_id") -> DataFrame:
    """PRJ-24: user corners from the options, else the prior result's if it was drawn by hand."""
    old = prior.filter(F.col("source") == "manual").select(key, valid_corners("corners").alias("_old"))
    return jobs.join(old, key, "left").withColumn("court_corners", F.coalesce(valid_corners("court_corners"), "_old")).drop("_old")


def court_positions(boxes: DataFrame, poses: DataFrame, courts: DataFrame, keys: Sequence[str] = RALLY, court_key: str = "job_id",
                    min_conf: float = 0.15) -> DataFrame:
    """JOIN-9: players in court metres; the ankle midpoint when both ankles are confident, else the box foot."""
    keys = as_list(keys)
    la, ra = F.get("keypoints", F.lit(15)), F.get("keypoints", F.lit(16))
    ankles = poses.filter((la["confidence"] >= min_conf) & (ra["confidence"] >= min_conf)).select(
        *keys, "player_id", "t", ((la["x"] + ra["x"]) / 2).alias("_ax"), ((la["y"] + ra["y"]) / 2).alias("_ay"))
    d = boxes.filter(F.col("player_id").isNotNull()).join(ankles, [*keys, "player_id", "t"], "left")
    d = d.join(courts.select(court_key, "homography"), court_key)
    p = court_project("homography", F.coalesce("_ax", (F.col("x1") + F.col("x2")) / 2), F.coalesce("_ay", "y2"))
    d = d.withColumn("_p", p)
    return d.select(*keys, "player_id", "t", F.col("_p.u").alias("x_m"), F.col("_p.v").alias("y_m"),
                    F.when(F.col("_ax").isNotNull(), "ankles").otherwise("box_foot").alias("src"))


def _cell(c: Column, span: float, n: int) -> Column:
    return F.floor(clamp(c / span, 0.0, 0.99) * n)


def movement_stats(positions: DataFrame, keys: Sequence[str] = RALLY, player: str = "player_id", max_step: float = 3.0,
                   grid: tuple[int, int] = (10, 22), court_space: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """AGG-8: per player of a job, distance run and share of the court visited. A point off the court breaks
    the chain, as does a new rally; jumps of ``max_step`` or more do not count.

    Chains run per player; without a pinned player the reference chains whichever boxes follow each
    other, which measures jumps between people."""
    keys = as_list(keys)
    out = [keys[0], player]
    if not court_space:
        cells = positions.select(*out, _cell(F.col("x"), 1.0, grid[0]).alias("cx"), _cell(F.col("y"), 1.0, grid[1]).alias("cy"))
        d = cells.groupBy(*out, "cx", "cy").agg(F.count("*").alias("n"))
        return d.groupBy(*out).agg(F.sum("n").alias("points"), F.lit(None).cast("double").alias("distance_m"),
                                   (F.count("*") / (grid[0] * grid[1]) * 100.0).alias("coverage_pct"), F.lit(False).alias("court_space"))
    on = F.col("x_m").between(-1.0, COURT_W + 1.0) & F.col("y_m").between(-1.5, COURT_L + 1.5)
    d = tile_scan(positions.withColumn("_on", on), [*keys, player], "t", tie=tie, prev={"_p": F.struct("_on", "x_m", "y_m")})
    step = F.hypot(F.col("x_m") - F.col("_p.x_m"), F.col("y_m") - F.col("_p.y_m"))
    counts = F.col("_on") & F.col("_p._on") & (step < max_step)
    d = d.withColumns({"_step": F.when(counts, step).otherwise(0.0),
                       "_cx": F.when(F.col("_on"), _cell(F.col("x_m"), COURT_W, grid[0])), "_cy": F.when(F.col("_on"), _cell(F.col("y_m"), COURT_L, grid[1]))})
    # cells are pre-aggregated, so distinct counting never gathers a player's points
    cells = d.groupBy(*out, "_cx", "_cy").agg(F.count("*").alias("n"), F.sum("_step").alias("s"))
    return cells.groupBy(*out).agg(F.sum("n").alias("points"), F.sum("s").alias("distance_m"),
                                   (F.count("_cx") / (grid[0] * grid[1]) * 100.0).alias("coverage_pct"), F.lit(True).alias("court_space"))


AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _splats(gx: int, gy: int):
    """A player's grid from the sums that its cells give to those around them, scaled to the hottest cell."""

    def walk(rows):
        heat = {}
        for ix, iy, *sums in rows:
            for (a, b), w in zip(AROUND, sums):
                if 0 <= ix + a < gx and 0 <= iy + b < gy:
                    heat[ix + a, iy + b] = heat.get((ix + a, iy + b), 0.0) + w
        hottest = max(1e-6, *heat.values())
        for (x, y), h in heat.items():
            yield x, y, h / hottest

    return walk


def heatmap(positions: DataFrame, keys: Sequence[str] = ("job_id",), player: str = "player_id", court_space: bool = True,
            grid: tuple[int, int] = (18, 38), fallback: tuple[int, int] = (30, 17), sigma: float = 1.2, ids: int | None = None) -> DataFrame:
    """AGG-9: soft 3x3 splats on a grid, scaled to the hottest cell of each of a job's players, or of its first ``ids``."""
    from .tiles import top_n

    keys = as_list(keys)
    gx, gy = grid if court_space else fallback
    d = positions
    if court_space:
        d = d.filter(F.col("x_m").between(-1.2, 7.3) & F.col("y_m").between(-1.5, 14.9))
    x, y = (("x_m", COURT_W), ("y_m", COURT_L)) if court_space else (("x", 1.0), ("y", 1.0))
    if ids is not None:
        d = d.join(top_n(positions.select(*keys, player).distinct(), keys, [F.asc(player)], ids).drop("rn"), [*keys, player])
    d = d.select(*keys, player, (clamp(F.col(x[0]) / x[1], 0.0, 1.0) * (gx - 1)).alias("_cx"),
                                              (clamp(F.col(y[0]) / y[1], 0.0, 1.0) * (gy - 1)).alias("_cy"))
    # a point counts towards the nine cells around its own: nine sums per own cell leave the first aggregate, at most a grid per player,
    # and the cells are added up from those. Spreading the points themselves makes the aggregate's table nine times their number in each task
    d = d.withColumns({"_ix": F.floor(F.col("_cx") + 0.5), "_iy": F.floor(F.col("_cy") + 0.5)})
    off = [(F.col("_ix") + a - F.col("_cx"), F.col("_iy") + b - F.col("_cy")) for a, b in AROUND]
    sums = [F.sum(F.exp(-(dx * dx + dy * dy) / sigma)).alias(f"_w{i}") for i, (dx, dy) in enumerate(off)]
    own = d.groupBy(*keys, player, "_ix", "_iy").agg(*sums)
    return ordered_fold(own, [*keys, player], ["_ix", "_iy"], _splats(gx, gy), "ix long, iy long, heat double")


def source_share(positions: DataFrame, keys: Sequence[str] = ("job_id",), margin: float = 1.0) -> DataFrame:
    """AGG-31: positions near the court, and how many came from ankles."""
    on = F.col("x_m").between(-margin, COURT_W + margin) & F.col("y_m").between(-margin, COURT_L + margin)
    d = positions.filter(on).groupBy(*as_list(keys)).agg(F.count("*").alias("total"), F.count_if(F.col("src") == "ankles").alias("_a"))
    return d.withColumn("ankle_pct", 100.0 * F.col("_a") / F.col("total")).drop("_a")


def corner_medians(detections: DataFrame, keys: Sequence[str] = ("job_id",), small: bool = False) -> DataFrame:
    """Per coordinate the median over frames, and the mean spread. ``detections``: keys, frame_no, corners. ``small``: each group's
    rows fit into a task; where they lie together, as those of :func:`by_size`, nothing is shuffled."""
    keys = as_list(keys)
    at = {f"_{i}{a}": F.get(F.get("corners", F.lit(i)), F.lit(a)).cast("double") for i in range(4) for a in range(2)}
    pts = detections.select(*keys, *[c.alias(n) for n, c in at.items()])
    # one row per job and task leaves the first aggregate, one per distinct value the counts behind the medians: frames themselves never travel
    middle = [sorted_median(n).alias(f"_m{n}") for n in at] if small else []
    per = pts.groupBy(*keys).agg(*[F.stddev_pop(n).alias(f"_s{n}") for n in at], F.greatest(*[F.count(n) for n in at]).alias("found"), *middle).filter("found > 0")
    per = per if small else per.join(quantiles(pts, keys, {n: {f"_m{n}": 0.5} for n in at}), keys)
    sds = F.filter(F.array(*[f"_s{n}" for n in at]), lambda s: s.isNotNull())
    quad = F.array(*[F.array(*[F.round(f"_m_{i}{a}", 4) for a in range(2)]) for i in range(4)])
    out = per.withColumn("spread", F.aggregate(sds, F.lit(0.0), lambda x, s: x + s) / F.size(sds))
    return out.select(*keys, quad.alias("corners"), F.when(F.col("found") > 1, F.col("spread")).otherwise(0.0).alias("spread"), "found")


def corner_consensus(detections: DataFrame, samples: int = 5, model: DataFrame | None = None, keys: Sequence[str] = ("job_id",),
                     strong: float = 0.5, floor: float = 0.35, max_spread: float = 0.08, small: bool = False) -> DataFrame:
    """AGG-14: one court per job from per-frame line detections (with ``score``), helped by a second set of
    corners where the lines are weak. ``small``: see :func:`corner_medians`."""
    keys = as_list(keys)
    best = detections.groupBy(*keys).agg(F.max("score").alias("best"))
    cv = corner_medians(detections, keys, small).join(best, keys).withColumn("confidence", F.round(F.least(
        F.lit(1.0), F.col("found") / samples * F.col("best") * F.greatest(F.lit(0.2), 1.0 - F.col("spread") * 12)), 3))
    cv = cv.select(*keys, "corners", "spread", "confidence")
    weak = F.when(F.col("confidence") < floor, "low_confidence").otherwise("ok")
    if model is None:
        return cv.withColumns({"source": F.lit("cv"), "status": weak})
    ok = model.filter(valid_quad("corners"))
    g = corner_medians(ok, keys, small).filter((F.col("spread") <= max_spread) & valid_quad("corners")).select(*keys, F.col("corners").alias("_g"))
    d = cv.join(g, keys, "full")
    has_cv, has_g = F.col("corners").isNotNull(), F.col("_g").isNotNull()
    mid = F.zip_with("corners", "_g", lambda a, b: F.zip_with(a, b, lambda p, q: (p + q) / 2))
    sure = has_cv & (F.col("confidence") >= strong)
    return d.select(
        *keys, F.when(sure | ~has_g, F.col("corners")).when(has_cv, mid).otherwise(F.col("_g")).alias("corners"), "spread",
        F.when(sure | ~has_g, F.col("confidence")).when(has_cv, F.greatest("confidence", F.lit(0.65))).otherwise(0.6).alias("confidence"),
        F.when(sure | ~has_g, "cv").when(has_cv, "cv+gemini").otherwise("gemini").alias("source"),
        F.when(sure | has_g, "ok").otherwise(weak).alias("status"))


def with_homography(courts: DataFrame) -> DataFrame:
    return courts.withColumn("homography", quad_homography("corners"))
