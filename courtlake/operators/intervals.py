"""Rally intervals: merging, dead time, audio refinement, reel selection."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import TILE, as_list, lay_out, sessionize, shared, tile_scan, top_n, with_totals

BUCKET_S = 60.0


def _islands(iv: DataFrame, keys: list, slack: float, closed: bool, tie: Sequence[str]) -> DataFrame:
    """Number runs of intervals that touch: a new one starts past the furthest earlier end + slack."""
    d = tile_scan(lay_out(iv, keys, "start_s"), keys, "start_s", tie=tie, cmax={"_reach": F.col("end_s")})
    past = F.col("start_s") > F.col("_reach") + slack if closed else F.col("start_s") >= F.col("_reach") + slack
    d = d.withColumn("_new", F.coalesce(past.cast("int"), F.lit(0)))
    return tile_scan(d, keys, "start_s", tie=tie, csum={"island": F.col("_new")}).drop("_new", "_reach", TILE)


def merge_overlaps(iv: DataFrame, keys: Sequence[str] = ("job_id",), slack: float = -0.5,
                   tie: Sequence[str] = ("end_s",)) -> DataFrame:
    """WIN-1: merge intervals that overlap by more than ``-slack``; furthest end, highest intensity, first note."""
    keys = as_list(keys)
    first = F.struct("start_s", *tie)
    iv = iv.select(*dict.fromkeys([*keys, "start_s", "end_s", "intensity", "note", *tie]))
    return (_islands(iv, keys, slack, False, tie).groupBy(*keys, "island")
            .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("intensity").alias("intensity"),
                 F.min_by("note", first).alias("note"))
            .withColumn("dur", F.col("end_s") - F.col("start_s")).drop("island"))


def clean_rallies(raw: DataFrame, durations: DataFrame, min_s: float = 3.0, tie: Sequence[str] = ("end_s",)) -> DataFrame:
    """SRC-3 core: clamp to the game, drop short windows, merge overlaps."""
    d = raw.join(durations, "job_id").withColumns({
        "start_s": F.greatest(F.lit(0.0), F.col("start_s")), "end_s": F.least(F.col("duration"), F.col("end_s")),
        "intensity": F.coalesce(F.nullif(F.col("intensity"), F.lit(0)), F.lit(3)),
        "note": F.coalesce("note", F.lit(""))})
    return merge_overlaps(d.filter(F.col("end_s") - F.col("start_s") >= min_s), "job_id", tie=tie)


def trim_list(iv: DataFrame, durations: DataFrame, pad: float = 0.4, join: float = 0.2, min_s: float = 1.0) -> DataFrame:
    """WIN-2: the cut list that removes dead time: padded rallies, clamped and merged."""
    d = iv.select("job_id", (F.col("start_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
    d = d.filter(F.col("end_s") - F.col("start_s") >= min_s).join(durations, "job_id").select(
        "job_id", F.greatest(F.lit(0.0), "start_s").alias("start_s"),
        F.when(F.col("duration") > 0, F.least("duration", "end_s")).otherwise(F.col("end_s")).alias("end_s"))
    out = _islands(d, ["job_id"], join, True, ("end_s",)).groupBy("job_id", "island").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return out.filter(F.col("end_s") - F.col("start_s") >= min_s).drop("island")


def with_gaps(play: DataFrame, gaps: DataFrame) -> DataFrame:
    """SET-1: play rows and explicit dead-time rows in one table."""
    return play.unionByName(gaps, allowMissingColumns=True)


def timeline(all_rallies: DataFrame, selected: DataFrame, durations: DataFrame, min_gap: float = 1.0,
             tie: Sequence[str] = ("rally_id",)) -> DataFrame:
    """WIN-5: every rally plus explicit no-play rows of at least ``min_gap`` seconds."""
    key = F.round("start_s", 2)
    sel = selected.select("job_id", key.alias("_key")).distinct().withColumn("in_reel", F.lit(True))
    given = all_rallies.select(*dict.fromkeys(["job_id", "start_s", "end_s", "intensity", "note", *tie])).filter(F.col("end_s") > F.col("start_s"))
    laid = lay_out(given.withColumn("_key", key), ["job_id"], "start_s")
    rows = tile_scan(laid, ["job_id"], "start_s", tie=tie, cmax={"_reach": F.col("end_s")})
    rows = rows.withColumn("_cursor", F.greatest(F.coalesce("_reach", F.lit(0.0)), F.lit(0.0)))
    play = rows.join(sel, ["job_id", "_key"], "left").select(
        "job_id", F.lit("rally").alias("kind"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("dur"),
        "intensity", "note", F.coalesce("in_reel", F.lit(False)).alias("in_reel"))
    between = rows.select("job_id", F.col("_cursor").alias("start_s"), F.col("start_s").alias("end_s"))
    reach = laid.groupBy("job_id").agg(F.max("end_s").alias("_end"))
    tail = durations.join(reach, "job_id", "left").select(
        "job_id", F.greatest(F.coalesce("_end", F.lit(0.0)), F.lit(0.0)).alias("start_s"), F.col("duration").alias("end_s"))
    gaps = between.union(tail).withColumn("dur", F.col("end_s") - F.col("start_s")).filter(F.col("dur") >= min_gap)
    return with_gaps(play, gaps.withColumn("kind", F.lit("no_play")))


def timeline_shares(tl: DataFrame, durations: DataFrame) -> DataFrame:
    """AGG-32: each segment's share of its game."""
    return tl.join(durations, "job_id").withColumn("share", F.try_divide("dur", "duration"))


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def events_in(intervals: DataFrame, events: DataFrame, on: Sequence[str] = ("job_id",), pad: float = 0.0,
              start: str = "start_s", end: str = "end_s", t: str = "t", width: float = BUCKET_S) -> DataFrame:
    """JOIN-5: events inside [start - pad, end + pad].

    Both sides carry a time bucket next to the equality key, so the join hashes on (key, bucket):
    no nested loop, and a long game spreads over its buckets."""
    on = as_list(on)
    lo, hi = F.col(start) - pad, F.col(end) + pad
    iv = intervals.filter(hi >= lo).withColumn("_bucket", _buckets(lo, hi, width))
    ev = events.withColumn("_bucket", F.floor(F.col(t) / width))
    return iv.join(ev, [*on, "_bucket"]).filter(F.col(t).between(lo, hi)).drop("_bucket")


def mark_selected(all_rallies: DataFrame, selected: DataFrame, tol: float = 0.5,
                  id_cols: Sequence[str] = ("job_id", "rally_id")) -> DataFrame:
    """JOIN-16: ``used`` when a selected start is closer than ``tol``; ``in_reel`` when starts agree to 2 places."""
    id_cols = as_list(id_cols)
    sel = selected.select("job_id", F.col("start_s").alias("_s"))
    near = sel.withColumn("_bucket", _buckets(F.col("_s") - tol, F.col("_s") + tol, 1.0))
    used = (all_rallies.select(*id_cols, "start_s", F.floor("start_s").alias("_bucket")).join(near, ["job_id", "_bucket"])
            .filter(F.abs(F.col("_s") - F.col("start_s")) < tol).select(*id_cols).distinct().withColumn("used", F.lit(True)))
    exact = sel.select("job_id", F.round("_s", 2).alias("_key")).distinct().withColumn("in_reel", F.lit(True))
    out = all_rallies.withColumn("_key", F.round("start_s", 2)).join(used, id_cols, "left").join(exact, ["job_id", "_key"], "left")
    return out.drop("_key").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("used", "in_reel")})


def refine_with_audio(rallies: DataFrame, peaks: DataFrame, durations: DataFrame, coverage_max: float = 0.70,
                      min_peaks: int = 2, split: float = 5.0, pads: tuple[float, float] = (2.0, 2.0), min_s: float = 3.0,
                      thin: int = 10) -> DataFrame:
    """WIN-13: when rallies tile the game implausibly, shrink them to their impact clusters. A game with
    too little audio, a healthy coverage, or no surviving window keeps its rallies unchanged."""
    rallies, peaks = shared(rallies, ["job_id", "start_s"]), shared(peaks.select("job_id", "t", "peak_id"), ["job_id", "t"])
    cover = rallies.groupBy("job_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_play"))
    heard = peaks.groupBy("job_id").agg(F.count("t").alias("_n"))
    suspect = (cover.join(heard, "job_id").join(durations, "job_id")
               .filter((F.col("_n") >= thin) & (F.col("duration") > 0) & (F.col("_play") / F.col("duration") > coverage_max))
               .select("job_id"))
    windows = rallies.join(suspect, "job_id", "left_semi")
    hits = events_in(windows, peaks.select("job_id", "t", "peak_id"), pad=0.5)
    hits = sessionize(hits, ["job_id", "rally_id"], "t", split, tie=["peak_id"], seg="_cluster")
    kept = [c for c in rallies.columns if c not in ("job_id", "rally_id", "start_s", "end_s")]
    refined = (hits.groupBy("job_id", "rally_id", "_cluster")
               .agg(F.first("start_s").alias("_s"), F.first("end_s").alias("_e"), F.min("t").alias("_t0"), F.max("t").alias("_t1"),
                    F.count("*").alias("audio_hits"), *[F.first(c).alias(c) for c in kept])
               .filter(F.col("audio_hits") >= min_peaks)
               .withColumns({"start_s": F.greatest(F.col("_s"), F.col("_t0") - pads[0]),
                             "end_s": F.least(F.col("_e"), F.col("_t1") + pads[1])})
               .filter(F.col("end_s") - F.col("start_s") >= min_s)
               .select(*rallies.columns, "audio_hits"))
    unchanged = rallies.join(refined.select("job_id").distinct(), "job_id", "left_anti").withColumn("audio_hits", F.lit(None).cast("long"))
    return refined.unionByName(unchanged)


def longest_ok_window(frames: DataFrame, clips: DataFrame, keys: Sequence[str] = ("clip_id",), min_s: float = 4.5,
                      min_cut: float = 0.5) -> DataFrame:
    """WIN-23: longest stretch of good frames, cut midway to its bad neighbours."""
    keys = as_list(keys)
    d = tile_scan(frames, keys, "t", tie=["frame_no"], break_on=["ok"], breaks=lambda c, p: c("ok") != p("ok"),
                  prev={"_pt": F.col("t")}, nxt={"_nt": F.col("t")})
    rank = F.struct("t", "frame_no")
    runs = d.filter("ok").groupBy(*keys, "seg").agg(
        F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.min_by("_pt", rank).alias("_before"), F.max_by("_nt", rank).alias("_after"))
    runs = runs.join(clips, keys).select(
        *keys, "clip_dur",
        F.coalesce((F.col("_before") + F.col("_t0")) / 2, F.lit(0.0)).alias("lo"),
        F.coalesce((F.col("_t1") + F.col("_after")) / 2, F.col("clip_dur")).alias("hi"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("lo", "hi", "clip_dur"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("b"))
    width = F.col("b.hi") - F.col("b.lo")
    return best.filter((width >= min_s) & (width < F.col("b.clip_dur") - min_cut)).select(*keys, "b.lo", "b.hi")


def select_for_reel(rallies: DataFrame, top: int = 5, max_s: float = 90.0, pad: float = 2.6) -> DataFrame:
    """SRT-2: longest first, up to ``top`` clips; a clip that would pass ``max_s`` is skipped, unless it is the first.

    Only rallies that can matter reach the fold: the ``top`` best per distinct (2-decimal) duration,
    and of those too long to ever be second, the longest. That bounds a game's array by the number
    of distinct durations below ``max_s`` whatever the number of rallies."""
    d = rallies.withColumn("dur", F.round("dur", 2))
    order = [F.desc("dur"), F.desc("intensity"), F.asc("rally_id")]
    long = F.col("dur") + pad > max_s
    cand = top_n(d.filter(~long), ["job_id", "dur"], order, top).union(top_n(d.filter(long), ["job_id"], order, 1))
    item = F.struct((-F.col("dur")).alias("d"), (-F.col("intensity")).alias("i"), "rally_id")
    picked = F.aggregate(
        F.sort_array(F.col("c")),
        F.struct(F.lit(0.0).alias("total"), F.array().cast("array<bigint>").alias("ids")),
        lambda s, r: F.when(
            (F.size(s["ids"]) < top) & ((s["total"] + (pad - r["d"]) <= max_s) | (F.size(s["ids"]) == 0)),
            F.struct((s["total"] + (pad - r["d"])).alias("total"), F.array_append(s["ids"], r["rally_id"]).alias("ids")),
        ).otherwise(s),
        lambda s: s["ids"],
    )
    ids = cand.groupBy("job_id").agg(F.collect_list(item).alias("c")).select("job_id", F.posexplode(picked).alias("pick", "rally_id"))
    return rallies.join(ids, ["job_id", "rally_id"])


def match_summary(jobs: DataFrame, all_rallies: DataFrame, reel: DataFrame, peaks: DataFrame) -> DataFrame:
    """AGG-6: one summary row per job."""
    found = all_rallies.groupBy("job_id").agg(F.count("*").alias("rallies_found"), F.sum("dur").alias("_all"))
    used = reel.groupBy("job_id").agg(F.count("*").alias("rallies_in_reel"), F.sum("dur").alias("play_time_s"))
    heard = peaks.groupBy("job_id").agg(F.count("*").alias("audio_peaks"))
    d = jobs.join(found, "job_id", "left").join(used, "job_id", "left").join(heard, "job_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("rallies_found", "rallies_in_reel", "audio_peaks")}
    return d.withColumns({**zero, "play_time_s": F.coalesce("play_time_s", F.lit(0.0)),
                          "no_play_time_s": F.greatest(F.lit(0.0), F.col("duration") - F.coalesce("_all", F.lit(0.0)))}).drop("_all")
