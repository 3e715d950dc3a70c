"""Scores, audits and gates over tracks, paths and shots."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import NET_Y
from ..functions.scalar import basename, clamp, clamp01, short_text
from .folds import ordered_fold
from .tiles import as_list, lay_out, quantiles, rows_of, shared, tile_scan, top_n, with_totals

RALLY = ("job_id", "rally_index")


def sample_quality(df: DataFrame, durations: DataFrame, keys: Sequence[str] = RALLY, fps_goal: float = 5.0) -> DataFrame:
    """AGG-1: mean confidence times coverage of the expected samples."""
    keys = as_list(keys)
    d = df.groupBy(*keys).agg(F.avg(clamp01("confidence", 1.0)).alias("_c"), F.count("*").alias("_n")).join(durations, keys)
    cover = F.least(F.lit(1.0), F.col("_n") / F.greatest(F.lit(3.0), F.col("dur") * fps_goal))
    return d.select(*keys, (F.col("_c") * cover).alias("quality"))


def worker_quality(df: DataFrame, expected: DataFrame, keys: Sequence[str] = RALLY, value: str = "confidence") -> DataFrame:
    """AGG-1, worker form: mean of the positive values times their coverage."""
    keys = as_list(keys)
    d = df.filter(F.col(value) > 0).groupBy(*keys).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    d = expected.join(d, keys, "left")
    cover = F.least(F.lit(1.0), F.col("_n") / F.greatest(F.lit(1), F.col("expected")))
    return d.select(*keys, F.coalesce(clamp(F.col("_m") * cover, 0.0, 1.0), F.lit(0.0)).alias("quality"))


def shuttle_quality(points: DataFrame, durations: DataFrame, keys: Sequence[str] = RALLY, fps: float | None = None,
                    jump: float = 0.22, tie: Sequence[str] = ()) -> DataFrame:
    """AGG-2: coverage x longest gap x teleports. Without ``fps`` the track's own median step sets it."""
    keys = as_list(keys)
    d = tile_scan(points.select(*dict.fromkeys([*keys, "t", "x", "y", *tie])), keys, "t", tie=tie, prev={"_p": F.struct("t", "x", "y")})
    d = d.select(*keys, (F.col("t") - F.col("_p.t")).alias("_dt"), F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")).alias("_hop"))
    if fps is None:
        step = quantiles(d.filter("_dt > 0"), keys, "_dt", {"_step": "upper"})
        d = d.join(step, keys, "left").withColumn("_fps", F.coalesce(clamp(1.0 / F.col("_step"), 4.0, 30.0), F.lit(30.0)))
    else:
        d = d.withColumn("_fps", F.lit(float(fps)))
    hop = (F.col("_dt") <= 2.5 / F.greatest(F.col("_fps"), F.lit(1.0))) & (F.col("_hop") > jump)
    g = d.groupBy(*keys).agg(F.max("_fps").alias("fps"), F.count("*").alias("n"), F.coalesce(F.max("_dt"), F.lit(0.0)).alias("longest_gap"),
                             F.count_if(hop).alias("teleports")).join(durations, keys).filter(F.col("dur") > 0)
    expected = F.greatest(F.lit(2), F.floor(F.col("dur") * F.greatest(F.col("fps"), F.lit(1.0)) * 0.35))
    cover = F.least(F.lit(1.0), F.col("n") / expected)
    gap = clamp(1.0 - F.greatest(F.lit(0.0), F.col("longest_gap") - 0.5) / F.col("dur"), 0.0, 1.0)
    jumps = clamp(1.0 - 8.0 * F.col("teleports") / F.greatest(F.col("n") - 1, F.lit(1)), 0.0, 1.0)
    return g.select(*keys, cover.alias("coverage"), "longest_gap", "teleports", clamp(cover * gap * jumps, 0.0, 1.0).alias("quality"))


def track_health(rows: DataFrame, cadence: DataFrame, keys: Sequence[str] = RALLY, track: str = "track_id", top: int | None = None,
                 tie: Sequence[str] = ()) -> DataFrame:
    """AGG-3: per tracker id its span, longest gap, coverage against the cadence and confidence."""
    keys = as_list(keys)
    d = tile_scan(rows.filter(F.col(track).isNotNull()), [*keys, track], "t", tie=tie, prev={"_pt": F.col("t")})
    g = d.groupBy(*keys, track).agg(
        F.count("*").alias("samples"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.coalesce(F.max(F.col("t") - F.col("_pt")), F.lit(0.0)).alias("longest_gap"), F.avg(clamp01("confidence")).alias("mean_conf"))
    g = top_n(g, keys, [F.desc("samples"), F.asc(track)], top, out="_rn").drop("_rn").join(cadence, keys)
    expected = F.greatest(F.lit(1.0), (F.col("t1") - F.col("t0")) * F.greatest(F.col("fps"), F.lit(0.1)) + 1.0)
    return g.withColumn("coverage", F.least(F.lit(1.0), F.col("samples") / expected)).drop("fps")


def sampling_cadence(frames: DataFrame, keys: Sequence[str] = RALLY) -> DataFrame:
    """AGG-4: distinct frame times and the rate their median spacing implies."""
    keys = as_list(keys)
    ts = frames.select(*keys, F.round("t", 3).alias("t")).distinct()
    d = tile_scan(ts, keys, "t", prev={"_p": F.col("t")}).withColumn("_dt", F.col("t") - F.col("_p"))
    n = d.groupBy(*keys).agg(F.count("*").alias("sample_count"))
    mid = quantiles(d.filter("_dt > 1e-4"), keys, "_dt", {"_step": "upper"})
    return n.join(mid, keys, "left").select(*keys, "sample_count", (1.0 / F.col("_step")).alias("measured_fps"))


def rally_flags(df: DataFrame, player_q: float = 0.35, mask_q: float = 0.65) -> DataFrame:
    """PRJ-7: status, camera mode, mask and engine of a rally from its counts and qualities."""
    seen = (F.col("shuttle_samples") > 0) | (F.col("player_samples") > 0) | (F.col("pose_quality") > 0) | (F.col("racquet_quality") > 0)
    return df.withColumns({
        "status": F.when(seen, "ok").otherwise("empty"),
        "camera_mode": F.when(F.col("player_quality") >= player_q, "gpu_pose_shuttle").otherwise("cpu_motion"),
        "mask_enabled": F.col("shuttle_quality") >= mask_q,
        "shuttle_engine": F.when((F.col("tracknet_status") == "ok") | F.col("any_tracknet"), "tracknetv3").otherwise("motion")})


QUALITIES = ("shuttle_quality", "player_quality", "pose_quality", "racquet_quality")


def job_signal_summary(rallies: DataFrame, player_q: float = 0.35) -> DataFrame:
    """AGG-5: a job's mean of positive rally qualities, camera mode, mask and engine."""
    d = rallies.groupBy("job_id").agg(
        *[F.coalesce(F.avg(F.when(F.col(q) > 0, F.col(q))), F.lit(0.0)).alias(q) for q in QUALITIES],
        F.bool_or("mask_enabled").alias("shuttle_mask"),
        F.when(F.bool_or(F.col("shuttle_engine") == "tracknetv3"), "tracknetv3").otherwise("motion").alias("shuttle_engine"))
    return d.withColumn("camera_mode", F.when(F.round("player_quality", 3) >= player_q, "gpu_pose_shuttle").otherwise("cpu_motion"))


def action_band(boxes: DataFrame, points: DataFrame, keys: Sequence[str] = RALLY, ch: float = 1.0, pad_t: float = 0.10,
                pad_b: float = 0.13, z: tuple[float, float] = (1.40, 2.25)) -> DataFrame:
    """AGG-21: one zoom per rally from the vertical band the play lives in; the least zoom and the whole height for a
    rally without boxes."""
    keys = as_list(keys)
    d = quantiles(boxes, keys, {"y1": {"_lo": 0.05}, "y2": {"_hi": 0.95}}).join(quantiles(points, keys, "y", {"_sh": 0.15, "_n": "count"}), keys, "full")
    low = F.col("_lo") - pad_t
    low = F.when(F.col("_n") >= 8, F.least(low, F.col("_sh") - 0.02)).otherwise(low)
    high = F.col("_hi") + pad_b
    band = F.greatest(high - F.least(low, high), F.lit(0.18))
    seen = F.col("_hi").isNotNull()
    return d.select(*keys, F.when(seen, clamp(ch / (band * 1.12), *z)).otherwise(z[0]).alias("z_rally"), F.when(seen, F.greatest(F.lit(0.0), low)).otherwise(0.0).alias("band_lo"))


def path_smoothness(path: DataFrame, keys: Sequence[str] = RALLY, cw: float = 0.31640625, ch: float = 1.0,
                    limits: tuple[float, float, float] = (0.05, 0.05, 0.006), tie: Sequence[str] = ()) -> DataFrame:
    """AGG-22: 99th percentile of camera acceleration relative to the crop."""
    keys = as_list(keys)
    laid = lay_out(path.select(*dict.fromkeys([*keys, "t", "x", "y", "z", *tie])), keys, "t")
    d = tile_scan(laid, keys, "t", tie=tie, prev={"_p": F.struct("x", "y", "z")}, nxt={"_n": F.struct("x", "y", "z")})

    def accel(c: str, unit: Column) -> Column:
        return F.abs((F.col(f"_n.{c}") - 2 * F.col(c) + F.col(f"_p.{c}")) / unit)

    z = F.col("z")
    d = d.withColumns({"_ax": accel("x", cw / (2 * z)), "_ay": accel("y", ch / (2 * z)), "_az": accel("z", z)})
    n = laid.groupBy(*keys).agg(rows_of("x").alias("_n"))
    n = n.join(quantiles(d, keys, {f"_{c}": {f"_{c}": 0.99} for c in ("ax", "ay", "az")}), keys, "left")
    short = F.col("_n") < 5
    out = {f"{c}99": F.when(short, 0.0).otherwise(F.col(f"_{c}")) for c in ("ax", "ay", "az")}
    d = n.withColumns(out)
    ok = (F.col("ax99") < limits[0]) & (F.col("ay99") < limits[1]) & (F.col("az99") < limits[2])
    return d.withColumn("ok", short | ok).drop("_n", "_ax", "_ay", "_az")


def frame_audit(stats: DataFrame, keys: Sequence[str] = ("clip_id",), fps: int = 4) -> DataFrame:
    """AGG-23: black, flat and frozen frames. ``stats``: keys, frame_no, mean, sd, absdiff (null on the first)."""
    keys = as_list(keys)
    d = stats.withColumn("_still", F.coalesce(F.col("absdiff") < 0.22, F.lit(False)))
    d = tile_scan(d, keys, "frame_no", break_on=["_still"], breaks=lambda c, p: c("_still") != p("_still"), tile=F.floor(F.col("frame_no") / 20000))
    runs = d.groupBy(*keys, "seg").agg(F.count_if("_still").alias("run"), F.count("*").alias("n"), F.count_if(F.col("mean") < 14).alias("black"),
                                       F.count_if((F.col("mean") >= 14) & (F.col("sd") < 7)).alias("flat"))
    g = runs.groupBy(*keys).agg(F.sum("n").alias("frames"), F.sum("black").alias("black"), F.sum("flat").alias("flat"), F.max("run").alias("frozen"))
    hard = F.col("black") + F.col("flat") + F.when(F.col("frozen") >= fps, 1).otherwise(0)
    return g.withColumns({"frozen_s": F.when(F.col("frozen") >= fps, F.col("frozen") / fps), "issues": hard, "ok": (F.col("frames") > 0) & (hard == 0)})


def pov_by_motion(shifts: DataFrame, keys: Sequence[str] = ("clip_id",), limit: float = 1.0) -> DataFrame:
    """Whether the camera itself moves: median per-frame shift above ``limit``."""
    d = shifts.withColumn("_m", F.greatest(F.abs("dx"), F.abs("dy")))
    return quantiles(d, as_list(keys), "_m", {"shift": 0.5}).withColumn("pov", F.col("shift") > limit)


def jerk_audit(shifts: DataFrame, cuts: DataFrame, keys: Sequence[str] = ("clip_id",), fps: float = 15.0, limit: float = 3.0,
               pov_limit: float = 30.0, near: float = 0.3) -> DataFrame:
    """AGG-24: change of global motion between frames, away from intended cuts. Moving cameras get a
    wider limit. ``shifts``: keys, frame_no (0-based), dx, dy; ``cuts``: keys, t."""
    from .intervals import events_in

    keys = as_list(keys)
    shifts = lay_out(shifts.select(*keys, "frame_no", "dx", "dy"), keys, "frame_no", F.floor(F.col("frame_no") / 20000))
    d = tile_scan(shifts, keys, "frame_no", prev={"_p": F.struct("dx", "dy")})
    d = d.filter("_p is not null").select(*keys, "frame_no", (F.col("frame_no") / fps).alias("t"),
                                          F.greatest(F.abs(F.col("dx") - F.col("_p.dx")), F.abs(F.col("dy") - F.col("_p.dy"))).alias("jerk"))
    d = shared(d, [*keys, "frame_no"])                 # one narrow row per frame, read several times below
    spans = cuts.select(*keys, F.col("t").alias("_c")).withColumns({"_lo": F.col("_c") - near, "_hi": F.col("_c") + near})
    hit = events_in(spans, d.select(*keys, "frame_no", "t"), keys, start="_lo", end="_hi").filter(F.abs(F.col("t") - F.col("_c")) < near)
    d = d.join(hit.select(*keys, "frame_no").distinct().withColumn("_cut", F.lit(True)), [*keys, "frame_no"], "left")
    d = with_totals(d, keys, _free=F.count_if(F.col("_cut").isNull()))
    d = d.filter(F.col("_cut").isNull() | (F.col("_free") == 0))
    n = shifts.groupBy(*keys).agg(F.count("*").alias("_n"))
    g = quantiles(d, keys, "jerk", {"jerk99": 0.99}).join(d.groupBy(*keys).agg(F.max("jerk").alias("jerk_max")), keys)
    g = n.join(g, keys, "left").join(pov_by_motion(shifts, keys), keys)
    short = F.col("_n") < 6
    lim = F.when(F.col("pov"), F.lit(pov_limit)).otherwise(F.lit(limit))
    return g.select(*keys, F.when(short, 0.0).otherwise(F.col("jerk99")).alias("jerk99"), F.when(~short, F.col("jerk_max")).alias("jerk_max"), "pov",
                    (short | (F.round("jerk99", 2) <= lim)).alias("ok"))


def framing_verdict(frames: DataFrame, keys: Sequence[str] = ("clip_id",), mode: str = "strict") -> DataFrame:
    """AGG-25: tolerate up to a third empty frames (half when lenient) and half with a cut player."""
    g = frames.groupBy(*as_list(keys)).agg(
        F.count("*").alias("frames"), F.count_if(F.col("framing") == "empty").alias("empty"), F.count_if(F.col("framing") == "player_cut").alias("cuts"),
        F.count_if((F.col("framing") == "empty") | (F.coalesce("players_visible", F.lit(0)) == 0)).alias("unseen"))
    third, half = (F.greatest(F.lit(1), F.floor(F.col("frames") / k)) for k in (3, 2))
    if mode == "pov":
        return g.withColumn("ok", F.col("empty") <= third)
    empty = F.col("empty") <= half if mode == "lenient" else F.col("unseen") <= third
    return g.withColumn("ok", empty & (F.col("cuts") <= half))


def failure_reason(df: DataFrame) -> DataFrame:
    """PRJ-22: the first failing audit in words. Reads issues array<string>, heuristics_ok, motion_ok, jerk99,
    bad_frames array<struct<framing, t>>."""
    kinds = F.array_join(F.sort_array(F.array_distinct("issues")), "+")
    shown = F.array_join(F.transform(F.slice("bad_frames", 1, 3), lambda f: F.concat(f["framing"], F.lit("@"), f["t"].cast("string"), F.lit("s"))), ", ")
    return df.withColumn("reason", F.when(~F.col("heuristics_ok"), F.when(kinds == "", "heuristics").otherwise(kinds))
                         .when(~F.col("motion_ok"), F.concat(F.lit("jerky motion (p99="), F.col("jerk99").cast("string"), F.lit("px)")))
                         .otherwise(F.when(shown == "", "gemini").otherwise(shown)))


def first_ok(attempts: DataFrame, keys: Sequence[str] = RALLY) -> DataFrame:
    """SRT-7: the first attempt that passed; without one the rally is dropped with the last reason."""
    g = attempts.groupBy(*as_list(keys)).agg(
        F.min_by("pass", F.when(F.col("ok"), F.col("attempt"))).alias("chosen"), F.max_by("detail", "attempt").alias("_why"))
    return g.select(*as_list(keys), "chosen", F.col("chosen").isNull().alias("dropped"), F.when(F.col("chosen").isNull(), F.col("_why")).alias("reason"))


# -- 3D shots ------------------------------------------------------------------------------------
def _crossings(samples: DataFrame, keys: list) -> DataFrame:
    """Sample steps that cross the net plane, with the next sample ``_n``."""
    w = Window.partitionBy(*keys).orderBy("t", "k")             # a shot has a dozen samples
    d = samples.withColumn("_n", F.lead(F.struct("x", "y", "z")).over(w))
    da, db = F.col("y") - NET_Y, F.col("_n.y") - NET_Y
    crosses = ((da <= 0) & (db >= 0)) | ((db <= 0) & (da >= 0))
    share = F.abs(da) / F.greatest(F.abs(da) + F.abs(db), F.lit(1e-9))
    return d.filter(crosses).withColumn("_z", F.col("z") + (F.col("_n.z") - F.col("z")) * share)


def shot_gates(shots: DataFrame, samples: DataFrame, keys: Sequence[str] = ("job_id", "shot_id"), max_residual: float = 35.0, laid: bool = False) -> DataFrame:
    """WIN-34: the first physical law a fitted shot breaks, or null. ``shots`` carries p0_z, launch_ms and
    residual_px; ``samples`` t, k, x, y, z. ``laid``: both lie by shot already, so nothing is shuffled."""
    keys = as_list(keys)
    samples = samples.select(*keys, "t", "k", "x", "y", "z")
    samples = samples if laid else shared(samples, keys)
    s = samples.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    net = _crossings(samples, keys).groupBy(*keys).agg(F.min("_z").alias("net_z"))
    d = shots.join(s, keys).join(net, keys, "left")
    out = ~F.col("min_x").between(-2.0, 8.1) | ~F.col("max_x").between(-2.0, 8.1) | ~F.col("min_y").between(-3.0, 16.4) | ~F.col("max_y").between(-3.0, 16.4)
    gate = (F.when(F.col("max_z") < 0.15, "peak").when(F.col("min_z") < -0.05, "floor").when(~F.col("p0_z").between(0.02, 3.6), "contact_height")
            .when(F.col("launch_ms") > 55.0, "speed").when(out, "bounds").when(F.col("net_z") < 1.0, "net")
            .when(F.col("residual_px") > max_residual, "residual"))
    return d.select(*shots.columns, gate.alias("gate"))


def speed_at_net(samples: DataFrame, keys: Sequence[str] = ("job_id", "shot_id"), fps: float = 12.0) -> DataFrame:
    """WIN-35: km/h over the first step that crosses the net plane."""
    d = _crossings(samples, as_list(keys))
    dx, dy, dz = (F.col(f"_n.{c}") - F.col(c) for c in "xyz")
    d = d.withColumn("_v", F.sqrt(dx * dx + dy * dy + dz * dz) * fps * 3.6)
    return d.groupBy(*as_list(keys)).agg(F.min_by("_v", F.struct("t", "k")).alias("speed_kmh"))


def _hand_off(dt: float, dist: float):
    def walk(rows):
        shots = list(rows)                     # one row per shot of a rally, its first and last sample only
        at = 0
        while at + 1 < len(shots):
            a, b = shots[at], shots[at + 1]
            apart = sum((p - q) ** 2 for p, q in zip(a[4:7], b[7:10])) ** 0.5
            if b[1] - a[2] <= dt and apart > dist:
                shots.pop(at if a[3] >= b[3] else at + 1)
                at = max(0, at - 1)
            else:
                at += 1
        yield from ((s[0],) for s in shots)

    return walk


def prune_discontinuous(shots: DataFrame, keys: Sequence[str] = RALLY, dt: float = 0.4, dist: float = 2.0) -> DataFrame:
    """WIN-36: adjacent shots close in time must meet in space; the worse fit of a pair that does not is
    dropped until all agree. ``shots``: shot_id, t0, t1, residual_px, end_x.., start_x...

    Shots more than ``dt`` after everything before them can never form a bad pair with it, so long
    rallies are cut there."""
    keys = as_list(keys)
    d = tile_scan(lay_out(shots, keys, "t0"), keys, "t0", tie=["shot_id"], cmax={"_reach": F.col("t1")})
    d = d.withColumn("_new", F.coalesce((F.col("t0") - F.col("_reach") > dt).cast("int"), F.lit(0)))
    d = tile_scan(d, keys, "t0", tie=["shot_id"], csum={"_piece": F.col("_new")})
    cols = ["shot_id", "t0", "t1", "residual_px", "end_x", "end_y", "end_z", "start_x", "start_y", "start_z"]
    kept = ordered_fold(d, [*keys, "_piece"], ["t0", "shot_id"], _hand_off(dt, dist), "shot_id long", cols)
    return shots.join(kept.select(*keys, "shot_id"), [*keys, "shot_id"], "left_semi")


def hits(shots: DataFrame) -> DataFrame:
    """WIN-41: one hit per accepted shot."""
    return shots.filter(F.col("gate").isNull()).select("job_id", "shot_id", F.col("t0").alias("t"), "speed_kmh", "speed_at_net_kmh")


def rejection_histogram(shots: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """AGG-27: counts per gate reason and the 3D status they imply."""
    keys = as_list(keys)
    n = shots.groupBy(*keys, "gate").agg(F.count("*").alias("n"))
    g = n.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("gate").isNotNull(), F.struct("gate", "n")))).alias("r"),
                             F.coalesce(F.sum(F.when(F.col("gate").isNull(), F.col("n"))), F.lit(0)).alias("accepted"))
    status = F.when(F.col("accepted") > 0, "ok").when(F.size("r") > 0, "implausible").otherwise("no_fit")
    return g.select(*keys, F.map_from_entries("r").alias("rejected"), "accepted", status.alias("status"))


def public_rally_3d(df: DataFrame) -> DataFrame:
    """PRJ-20: full 3D only for ok rallies; others keep a short status and the rejection map."""
    slim = F.struct(F.coalesce("r3_status", F.lit("failed")).alias("status"), F.coalesce("r3_message", F.lit("")).alias("message"),
                    F.when(F.size("rejected") > 0, F.col("rejected")).alias("rejected"), F.lit(None).cast("long").alias("shots"))
    full = F.struct(F.lit("ok").alias("status"), F.lit("").alias("message"), F.when(F.size("rejected") > 0, F.col("rejected")).alias("rejected"),
                    F.col("n_shots").cast("long").alias("shots"))
    return df.withColumn("rally_3d", F.when(F.col("r3_status") == "ok", full).otherwise(slim))


def model_status(df: DataFrame, col: str = "model_status") -> DataFrame:
    """PRJ-21: loaded models by short name. ``col`` is a struct of strings (SRC-2 schema)."""
    s = F.col(col)

    def text(name: str) -> Column:
        return F.coalesce(s[name], F.lit(""))

    pose = F.struct((text("pose_model") != "").alias("enabled"), basename(s["pose_model"]).alias("model"), basename(s["pose_requested_model"]).alias("requested_model"),
                    text("pose_backend").alias("backend"),
                    F.coalesce(F.nullif(s["pose_load_status"], F.lit("")), F.when(text("pose_model") != "", "loaded").otherwise("not_loaded")).alias("load_status"))
    racquet = F.struct((text("racquet_model") != "").alias("enabled"), basename(s["racquet_model"]).alias("model"),
                       F.when(text("racquet_model") != "", "measured_boxes").otherwise("not_configured").alias("mode"))
    tracknet = F.struct((text("tracknet_model") != "").alias("enabled"), basename(s["tracknet_model"]).alias("model"), short_text(s["tracknet_error"], 140).alias("error"))
    return df.withColumns({"pose": pose, "racquet": racquet, "tracknet": tracknet, "fallback": F.coalesce(s["fallback"].try_cast("boolean"), F.lit(False)),
                           "error": short_text(s["error"], 140)})


def contract_check(canonical: DataFrame, rallies: DataFrame, required: Sequence[str], contract: str, keys: Sequence[str] = RALLY) -> DataFrame:
    """PRJ-25: per requested rally the required fields that are missing, and whether the row is usable."""
    keys = as_list(keys)
    d = rallies.select(*keys).join(canonical.withColumn("_here", F.lit(True)), keys, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    ok = F.col("_here") & (F.col("status") == "ok") & (F.col("contract") == contract) & (F.size(missing) == 0)
    return d.select(*keys, missing.alias("missing"), F.coalesce(ok, F.lit(False)).alias("ok"))


def cell_activity(cells: DataFrame, keys: Sequence[str] = RALLY, floor: float = 6.0, sigmas: float = 2.0, flicker: float = 0.45,
                  sky: float = 0.08) -> DataFrame:
    """AGG-28: moving cells of a motion grid (keys, frame_no, row, col, rows, energy), minus flickering ones.
    The top ``sky`` share of rows counts as still."""
    keys = as_list(keys)
    d = cells.withColumn("energy", F.when(F.col("row") < F.floor(sky * F.col("rows")), 0.0).otherwise(F.col("energy")))
    d = with_totals(d, [*keys, "frame_no"], _m=F.avg("energy"), _s=F.stddev_pop("energy"))
    d = d.withColumn("_hot", F.col("energy") > F.greatest(F.lit(floor), F.col("_m") + sigmas * F.col("_s")))
    d = with_totals(d, [*keys, "row", "col"], _f=F.avg(F.col("_hot").cast("double")))
    return d.withColumn("active", F.col("_hot") & ~(F.col("_f") > flicker)).drop("_m", "_s", "_hot", "_f")


def camera_motion(active: DataFrame, keys: Sequence[str] = RALLY, share: float = 0.30) -> DataFrame:
    """AGG-28: share of frames with more than ``share`` of their cells moving."""
    keys = as_list(keys)
    f = active.groupBy(*keys, "frame_no").agg(F.avg(F.col("active").cast("double")).alias("_a"))
    return f.groupBy(*keys).agg(F.avg((F.col("_a") > share).cast("double")).alias("camera_motion"))
