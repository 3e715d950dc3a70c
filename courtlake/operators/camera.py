"""Reel clock, camera plans and follow targets."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, num
from ..session import cut_lineage
from .asof import bracket, fill_unseen
from .intervals import events_in
from .smoothing import hann, hann_short
from .tiles import as_list, quantiles, shared, tile_scan, with_totals

RALLY = ("job_id", "rally_index")


def reel_offsets(clips: DataFrame, xfade: float = 0.45, key: str = "job_id", pos: str = "pos") -> DataFrame:
    """WIN-22: each clip's span on the reel clock and the cut after it (null for the last)."""
    d = tile_scan(clips, [key], pos, csum={"_acc": F.col("clip_dur")}, nxt={"_next": F.col(pos)}, tile=F.floor(F.col(pos) / 4096))
    t0 = F.greatest(F.lit(0.0), F.col("_acc") - F.col("clip_dur") - F.col(pos) * xfade)
    cut = F.when(F.col("_next").isNotNull(), F.col("_acc") - (F.col(pos) + 1) * xfade + xfade / 2)
    return d.withColumns({"t0_reel": t0, "t1_reel": t0 + F.col("clip_dur"), "cut": cut}).drop("_acc", "_next")


def map_time(points: DataFrame, clips: DataFrame, src: str = "reel", key: str = "job_id", id: str = "pid") -> DataFrame:
    """JOIN-17: reel clock to source clock (``src="reel"``) or back. Inside a clip the offset is linear.
    Outside, a reel time clamps to the clip that started last; a source time snaps to the next cut."""
    length = F.col("t1_reel") - F.col("t0_reel")
    clips, points = shared(clips.select(key, "pos", "t0_reel", "t1_reel", "source_start"), [key, "pos"]), shared(points, [key, "t"])
    c = clips.select(key, "pos", "t0_reel", "t1_reel", "source_start", (F.col("source_start") + length).alias("source_end"))
    lo, hi = ("t0_reel", "t1_reel") if src == "reel" else ("source_start", "source_end")
    offset = F.col("source_start") + F.col("t") - F.col("t0_reel") if src == "reel" else F.col("t0_reel") + F.col("t") - F.col("source_start")
    inside = events_in(c, points.select(key, id, "t"), key, start=lo, end=hi).groupBy(key, id).agg(F.min_by(offset, "pos").alias("_in"))
    marks = c.select(key, F.col(lo).alias("t"), F.col("pos").alias("_p"), "t0_reel", "t1_reel", "source_start")
    # reel: the last clip starting at or before t; source: the first starting after t
    d = bracket(points, marks, [key], ["_p", "t0_reel", "t1_reel", "source_start"], order=["_p"], grid_first=False)
    if src == "reel":
        near = F.coalesce("a", "b")
        out = near["source_start"] + F.greatest(F.lit(0.0), F.least(F.col("t"), near["t1_reel"]) - near["t0_reel"])
    else:
        out = F.coalesce(F.col("b.t0_reel"), F.lit(0.0))
    return d.join(inside, [key, id], "left").withColumn("t_mapped", F.coalesce("_in", out)).drop("a", "b", "_in")


def clean_camera_plan(plans: DataFrame, col: str = "plan") -> DataFrame:
    """PRJ-11: enabled plans with well-formed keyframes; unknown targets follow the shuttle."""
    def frame(k: Column) -> Column:
        target = F.when(k["target"].isin("shuttle", "player", "point"), k["target"]).otherwise("shuttle")
        return F.struct(
            F.coalesce(k["t"], F.lit("0")).try_cast("double").alias("t"), target.alias("target"),
            F.coalesce(k["targetPlayer"], k["target_player"], F.lit("0")).try_cast("double").cast("int").alias("target_player"),
            F.coalesce(k["zoom"], F.lit("1.4")).try_cast("double").alias("zoom"),
            F.when(k["point"].isNotNull(), F.struct(num(k["point"]["x"], 0.5).alias("x"), num(k["point"]["y"], 0.45).alias("y"))).alias("point"))

    kfs = F.filter(F.transform(F.col(f"{col}.keyframes"), frame), lambda k: k["t"].isNotNull() & k["zoom"].isNotNull() & k["target_player"].isNotNull())
    return plans.filter(F.col(f"{col}.enabled")).withColumn("keyframes", kfs).filter(F.size("keyframes") > 0)


def valid_order(df: DataFrame, order: str = "picks", pool_size: str = "pool_size") -> DataFrame:
    """PRJ-12: unique 1-based positions within the pool."""
    a = F.col(order)
    ok = (F.size(a) > 0) & (F.size(F.array_distinct(a)) == F.size(a)) & F.forall(a, lambda i: i.between(1, F.col(pool_size)))
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def pick_in_order(pool: DataFrame, order: DataFrame, key: str = "job_id", index: str = "rally_index", picks: str = "picks") -> DataFrame:
    """JOIN-22: pool rallies at the asked 1-based positions, in the asked order."""
    wanted = order.select(key, F.posexplode(picks).alias("pos", index))
    return pool.join(wanted, [key, index])


def order_clips(clips: DataFrame, key: str = "job_id", recorded: str = "recorded_at", upload: str = "upload_no") -> DataFrame:
    """WIN-39: by recording time only when every clip has a distinct one, else by upload order."""
    d = with_totals(clips, [key], _n=F.count("*"), _d=F.countDistinct(recorded), _h=F.count(recorded))
    use = (F.col("_n") == F.col("_d")) & (F.col("_n") == F.col("_h"))
    w = Window.partitionBy(key).orderBy(F.when(use, F.col(recorded)), F.col(upload))
    return d.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "order_source": F.when(use, "recording time").otherwise("upload order")}).drop("_n", "_d", "_h")


def slice_keyframes(clips: DataFrame, keyframes: DataFrame, key: str = "job_id", clip: str = "pos",
                    cols: Sequence[str] = ("target", "zoom"), id: str = "kf_id") -> DataFrame:
    """JOIN-18: a clip's keyframes on the source clock: the one active at its start, then those strictly inside."""
    clips, keyframes = shared(clips.select(key, clip, "t0_reel", "t1_reel", "source_start"), [key, clip]), shared(keyframes.select(key, "t", id, *cols), [key, "t"])
    starts = clips.select(key, clip, F.col("t0_reel").alias("t"), "source_start")
    seeded = bracket(starts, keyframes.select(key, "t", id, *cols), [key], [id, *cols], order=[id], grid_first=False)
    seed = seeded.withColumn("k", F.coalesce("a", "b")).filter("k is not null").select(
        key, clip, F.col("source_start").alias("t"), *[F.col(f"k.{c}").alias(c) for c in (id, *cols)])
    inside = events_in(clips.select(key, clip, "t0_reel", "t1_reel", "source_start"), keyframes.select(key, "t", id, *cols), key,
                       start="t0_reel", end="t1_reel").filter((F.col("t") > F.col("t0_reel")) & (F.col("t") < F.col("t1_reel")))
    return seed.unionByName(inside.select(key, clip, (F.col("source_start") + F.col("t") - F.col("t0_reel")).alias("t"), id, *cols))


def _in_frame(d: DataFrame, cw, ch) -> DataFrame:
    hw, hh = cw / (2 * F.col("z")), ch / (2 * F.col("z"))
    return d.withColumns({"x": clamp(F.col("x"), hw, 1 - hw), "y": clamp(F.col("y"), hh, 1 - hh)})


def eval_camera_plan(grid: DataFrame, keyframes: DataFrame, keys: Sequence[str] = RALLY, cw: float = 0.31640625, ch: float = 1.0,
                     z_max: float = 2.5, win: int = 15, id: str = "kf_id") -> DataFrame:
    """WIN-30: camera centre and zoom per frame from keyframes. The grid carries frame_no, t and the frame's
    shu_x, shu_y, near_x, near_y, far_x, far_y (null = absent); keyframes carry t, target,
    target_player, px, py, zoom."""
    keys = as_list(keys)
    cols = ["target", "target_player", "px", "py", "zoom"]
    d = bracket(grid, keyframes.select(*keys, "t", id, *cols), keys, [id, *cols], order=[id], grid_first=False)
    a, started = F.coalesce("a", "b"), F.col("a").isNotNull()
    d = d.withColumn("_k", a).filter("_k is not null")
    za = F.coalesce(F.nullif(F.col("_k.zoom"), F.lit(0.0)), F.lit(1.4))
    zb = F.coalesce(F.nullif(F.col("b.zoom"), F.lit(0.0)), za)
    f = clamp((F.col("t") - F.col("_k.t")) / F.nullif(F.col("b.t") - F.col("_k.t"), F.lit(0.0)), 0.0, 1.0)
    z = F.when(started & (F.col("b.t") > F.col("_k.t")), za + (zb - za) * f).otherwise(za)

    def target(axis: str) -> Column:
        near, far = F.col(f"near_{axis}"), F.col(f"far_{axis}")
        player = F.when(F.col("_k.target_player") == 1, F.coalesce(far, near)).otherwise(F.coalesce(near, far))
        point = F.coalesce(F.col(f"_k.p{axis}"), F.lit(0.5 if axis == "x" else 0.45))
        return F.when(F.col("_k.target") == "point", point).when(F.col("_k.target") == "player", player).otherwise(F.col(f"shu_{axis}"))

    d = d.withColumns({"z": clamp(z, 1.0, z_max), "_cx": target("x"), "_cy": target("y")})
    d = tile_scan(d, keys, "frame_no", ffill={"x": F.col("_cx"), "y": F.col("_cy")}, tile=F.floor(F.col("frame_no") / 20000))
    d = d.withColumns({"x": F.coalesce("x", F.lit(0.5)), "y": F.coalesce("y", F.lit(0.55))}).select(*keys, "frame_no", "t", "x", "y", "z")
    return _in_frame(hann(_in_frame(d, cw, ch), keys, "frame_no", ["x", "y", "z"], win), cw, ch)


def follow_targets(grid: DataFrame, rallies: DataFrame, keys: Sequence[str] = RALLY, cw: float = 0.31640625, ch: float = 1.0,
                   min_player_q: float = 0.28, min_shuttle_q: float = 0.22, min_seen: float = 0.15, win: int = 17) -> DataFrame:
    """WIN-31: where the camera should look, frame by frame, at one constant zoom per rally.

    The grid carries frame_no, shu_x, shu_y and near_/far_ cx, cy, hw, hh (null = absent); ``rallies``
    carries player_quality, shuttle_quality, z_rally and band_lo. Untrusted or mostly unseen rallies
    give no rows."""
    keys = as_list(keys)
    q = rallies.withColumns({"_sq": F.col("shuttle_quality") >= min_shuttle_q, "_pq": F.col("player_quality") >= min_player_q}).filter("_sq or _pq")
    d = grid.join(q.select(*keys, "_sq", "_pq", "z_rally", "band_lo"), keys)
    led = F.col("_sq") & ~F.col("_pq")
    sx, sy = (F.when(F.col("_sq"), F.col(c)) for c in ("shu_x", "shu_y"))
    d = d.withColumns({"_sx": sx, "_sy": F.greatest(sy, F.col("band_lo")), "_led": led})

    def ext(p: str, axis: str) -> tuple[Column, Column]:
        c, h = (F.col(f"{p}_cx"), F.col(f"{p}_hw")) if axis == "x" else (F.col(f"{p}_cy"), F.col(f"{p}_hh"))
        before, after = (0.05, 0.05) if axis == "x" else (0.10, 0.13)
        return c - h - before, c + h + after

    has_near, has_far = F.col("near_cx").isNotNull(), F.col("far_cx").isNotNull()
    for axis in "xy":
        n, f = ext("near", axis), ext("far", axis)
        d = d.withColumns({f"_{axis}lo": F.coalesce(n[0], f[0]), f"_{axis}hi": F.coalesce(n[1], f[1]), f"_f{axis}lo": f[0], f"_f{axis}hi": f[1]})
    vlo, vhi = F.least("_ylo", "_sy"), F.greatest("_yhi", "_sy")
    anchor = F.col("_xlo").isNotNull()
    d = d.withColumns({"_vlo": F.when(anchor, vlo), "_vhi": F.when(anchor, vhi)}).withColumn("_half", (F.col("_vhi") - F.col("_vlo")) / 2)

    def fit(half: Column) -> Column:
        return F.least(F.lit(cw / (2 * 0.085)), ch / (2 * F.greatest(half, F.lit(0.135))))

    span = quantiles(d, keys, "_half", {"_span": 0.92})
    d = d.join(span, keys, "left").withColumn("z", F.coalesce(F.greatest(F.lit(1.0), F.least(fit(F.col("_span")), F.col("z_rally"))), F.col("z_rally")))
    hw, hh = cw / (2 * F.col("z")), ch / (2 * F.col("z"))
    both = has_near & has_far
    flo, fhi = F.least("_vlo", "_fylo"), F.greatest("_vhi", "_fyhi")
    join_far = both & (fit((fhi - flo) / 2) >= F.col("z") * 0.85)
    blend_x = 0.62 * F.col("_sx") + 0.38 * (F.col("_xlo") + F.col("_xhi")) / 2
    blend_y = F.when(join_far, (flo + fhi) / 2).otherwise((F.col("_vlo") + F.col("_vhi")) / 2)
    wide = [F.least("_xlo", "_fxlo"), F.greatest("_xhi", "_fxhi"), F.least("_ylo", "_fylo"), F.greatest("_yhi", "_fyhi")]
    both_fit = F.least(cw / F.greatest(wide[1] - wide[0], F.lit(0.12)), ch / F.greatest(wide[3] - wide[2], F.lit(0.18)))
    pair = both & (both_fit >= F.col("z") * 0.85)
    body = [F.when(pair, (wide[i] + wide[i + 1]) / 2).otherwise((F.col(f"_{a}lo") + F.col(f"_{a}hi")) / 2) for i, a in ((0, "x"), (2, "y"))]
    seen_s = F.col("_sx").isNotNull()
    x = F.when(seen_s & anchor & ~F.col("_led"), blend_x).when(seen_s, F.col("_sx")).when(anchor, body[0])
    y = F.when(seen_s & anchor & ~F.col("_led"), blend_y).when(seen_s, 0.5 * F.col("_sy") + 0.5 * 0.55).when(anchor, body[1])
    d = d.withColumns({"x": x, "y": y}).withColumns({"x": clamp(F.col("x"), hw, 1 - hw), "y": clamp(F.col("y"), hh, 1 - hh)})
    d = d.withColumns({c: F.when(x.isNotNull(), F.col(c)) for c in ("x", "y")})
    d = cut_lineage(d.select(*keys, "frame_no", "x", "y", "z"))          # filling and smoothing read it several times
    d = with_totals(d, keys, _seen=F.avg(F.col("x").isNotNull().cast("double"))).filter(F.col("_seen") >= min_seen)
    d = fill_unseen(d.drop("_seen"), keys, "frame_no", ["x", "y"], {"x": 0.5, "y": 0.55})
    long = with_totals(d, keys, _n=F.count("*")).filter(F.col("_n") >= win).select(*d.columns)
    return hann(long, keys, "frame_no", ["x", "y"], win).select(*d.columns).union(hann_short(d, keys, "frame_no", ["x", "y"], win))


def static_framing(path: DataFrame, keys: Sequence[str] = RALLY) -> DataFrame:
    """AGG-30: one safe framing per rally: median centre, no zoom."""
    keys = as_list(keys)
    return quantiles(path, keys, {c: {c: 0.5} for c in "xy"}).withColumn("z", F.lit(1.0))
