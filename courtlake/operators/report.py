"""Coach evidence, notes and the nested match report."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp01, clean_moments, clean_texts, num, short_text
from .tiles import top_n

SCHEMA_TAG = "courtlake.report.v1"

# Claims per evidence mode, caveat texts and their thresholds.
NO_TECHNIQUE = ["grip", "swing path", "contact point", "racquet speed", "stroke classification"]
CLAIMS = {
    "measured": (["racquet presence from measured boxes",
                  "limited swing/contact observations when visible and consistent with measurements"], ["exact racquet speed"]),
    "pose_guided_candidate": (["racquet candidate regions from pose-guided line evidence", "visible racquet context only"], NO_TECHNIQUE),
    "frame_context_only": (["racquet visibility in representative frames only",
                            "broad movement timing when supported by pose and shuttle signals"], NO_TECHNIQUE),
    "none": (["no racquet-specific claims"], NO_TECHNIQUE),
}
CAVEAT_POSE = "Pose quality is low, so form notes must stay conservative."
CAVEAT_CANDIDATE = "Racquet candidates are pose-guided and need Gemini/frame confirmation."
CAVEAT_FRAME = "No measured racquet boxes yet; racquet notes are limited to visible frame context."
CAVEAT_RACQUET = "Racquet quality is low, so swing/contact notes are unreliable."
CAVEAT_SHUTTLE = "Shuttle tracking is not reliable enough for flight-path coaching."
CAVEAT_PLAYER = "Player boxes are sparse, so movement coverage may be incomplete."
NOTE_CANDIDATE = "Racquet guidance uses weak pose-guided candidates until a detector is active."
NOTE_FRAME = "Racquet guidance is frame-context only until a racquet detector is active."
DEFAULT_STRENGTH = "The selected reel favors longer exchanges with sustained movement."
DEFAULT_WORK_ON = "Improve tracking quality before using technique-specific feedback."
DEFAULT_HEADLINE = "Grounded coach notes are ready."


def tracking_confidence(player: Column, pose: Column, racquet: Column, shuttle: Column) -> Column:
    return F.least(F.lit(1.0), player * 0.5 + pose * 0.25 + racquet * 0.15 + shuttle * 0.1)


def evidence_summary(rallies: DataFrame, frame_count: int = 4, mask_q: float = 0.65, key: str = "job_id") -> DataFrame:
    """AGG-26: what the tracking supports saying, per job. ``rallies`` carries the job's qualities (one value per
    job), racquet_samples, racquet_candidate_samples and has_frame."""
    q = {n: F.max(clamp01(n)).alias(n) for n in ("player_quality", "pose_quality", "racquet_quality", "racquet_candidate_quality", "shuttle_quality")}
    d = rallies.groupBy(key).agg(*q.values(), F.sum("racquet_samples").alias("measured"), F.sum("racquet_candidate_samples").alias("candidates"),
                                 F.least(F.lit(frame_count), F.count_if("has_frame")).alias("frames"), F.count("*").alias("n"))
    mode = (F.when((F.col("measured") > 0) | (F.col("racquet_quality") >= 0.45), "measured")
            .when((F.col("candidates") > 0) | (F.col("racquet_candidate_quality") > 0), "pose_guided_candidate")
            .when(F.col("frames") > 0, "frame_context_only").otherwise("none"))
    score = F.least(F.lit(1.0), F.col("frames") / F.greatest(F.lit(1), F.least(F.lit(frame_count), "n")))
    context = F.when((F.col("frames") > 0) | (F.col("racquet_candidate_quality") > 0), F.least(
        F.lit(0.55), F.col("pose_quality") * 0.38 + F.col("player_quality") * 0.22 + F.col("shuttle_quality") * 0.20
        + F.greatest(score, "racquet_candidate_quality") * 0.20)).otherwise(0.0)
    d = d.withColumns({"mode": mode, "visual_context": context,
                       "tracking_confidence": tracking_confidence(*[F.col(f"{n}_quality") for n in ("player", "pose", "racquet", "shuttle")])})
    racquet = (F.when(F.col("mode") == "pose_guided_candidate", CAVEAT_CANDIDATE).when(F.col("mode") == "frame_context_only", CAVEAT_FRAME)
               .when(F.col("racquet_quality") < 0.45, CAVEAT_RACQUET))
    caveats = F.array_compact(F.array(F.when(F.col("pose_quality") < 0.45, CAVEAT_POSE), racquet,
                                      F.when(F.col("shuttle_quality") < mask_q, CAVEAT_SHUTTLE), F.when(F.col("player_quality") < 0.35, CAVEAT_PLAYER)))

    def claims(i: int) -> Column:
        out = F.when(F.lit(False), F.array().cast("array<string>"))
        for m, lists in CLAIMS.items():
            out = out.when(F.col("mode") == m, F.array(*map(F.lit, lists[i])))
        return out

    return d.withColumns({"caveats": caveats, "allowed": claims(0), "forbidden": claims(1)})


def rank_evidence(rallies: DataFrame, n: int = 4, key: str = "job_id", tie: str = "rally_index") -> DataFrame:
    """SRT-4: the rallies worth a representative frame, best first, with the frame's time."""
    score = (clamp01("player_quality") * 0.30 + clamp01("pose_quality") * 0.30 + clamp01("shuttle_quality") * 0.22
             + F.greatest(clamp01("racquet_quality"), clamp01("racquet_candidate_quality") * 0.6) * 0.10
             + F.when((F.col("shuttle_engine") == "tracknetv3") | (F.col("tracknet_status") == "ok"), 0.08).otherwise(0.0)
             + F.when(F.col("mask_enabled"), 0.04).otherwise(0.0))
    mid = F.greatest(F.lit(0.0), F.col("start_s") + F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")) * 0.5)
    d = rallies.withColumns({"score": score, "frame_t": mid})
    return top_n(d, [key], [F.desc("score"), F.desc(num("dur")), F.asc(tie)], n, out="rank")


def sanitize_notes(notes: DataFrame, summary: DataFrame, key: str = "job_id", max_caveats: int | None = None) -> DataFrame:
    """PRJ-23: model notes made safe: confidence capped by the measured one, measured caveats added, defaults for
    empty lists. ``notes``: headline, confidence, strengths, work_on, caveats, moments, n_rallies."""
    d = notes.join(summary.select(key, "tracking_confidence", "mode", F.col("caveats").alias("_measured")), key)
    tc = F.round("tracking_confidence", 3)
    conf = F.round(F.least(clamp01(F.coalesce(F.col("confidence"), tc)), F.greatest(F.lit(0.2), tc)), 2)
    strengths, work_on = clean_texts("strengths", 2, 92), clean_texts("work_on", 2, 92)
    extra = F.array_compact(F.array(F.when(F.col("mode") == "pose_guided_candidate", NOTE_CANDIDATE), F.when(F.col("mode") == "frame_context_only", NOTE_FRAME)))
    caveats = F.array_distinct(F.concat(clean_texts("caveats", 2, 110), "_measured", extra))
    caveats = caveats if max_caveats is None else F.slice(caveats, 1, max_caveats)
    return d.select(
        key, short_text(F.coalesce(F.nullif("headline", F.lit("")), F.lit(DEFAULT_HEADLINE)), 110).alias("headline"), conf.alias("confidence"),
        F.when(F.size(strengths) > 0, strengths).otherwise(F.array(F.lit(DEFAULT_STRENGTH))).alias("strengths"),
        F.when(F.size(work_on) > 0, work_on).otherwise(F.array(F.lit(DEFAULT_WORK_ON))).alias("work_on"),
        clean_moments("moments", "n_rallies").alias("moments"), caveats.alias("caveats"))


def feature_payload(rallies: DataFrame, found: DataFrame, key: str = "job_id") -> DataFrame:
    """AGG-29: per rally a JSON feature row, next to its job's reel totals."""
    totals = rallies.groupBy(key).agg(F.count("*").alias("rallies_used"), F.sum("dur").alias("total_rally_s"))
    totals = totals.join(found, key, "left")
    row = F.to_json(F.struct("rally_index", F.round("dur", 2).alias("dur"), "intensity", short_text("note", 80).alias("note"),
                             *[F.round(clamp01(q), 3).alias(q) for q in ("player_quality", "pose_quality", "shuttle_quality")], "shuttle_samples", "player_samples"))
    return rallies.join(totals, key).select(key, "rally_index", row.alias("payload"), "rallies_used", "total_rally_s", "rallies_found")


def rally_report(rallies: DataFrame, flights: DataFrame, hits: DataFrame, peaks: DataFrame, max_items: int | None = None) -> DataFrame:
    """One nested row per rally: its flights, in-play spans, hits and audio peaks. The lists hold one rally's
    markers; rows of a whole job are nested only by the reader."""
    keys = ["job_id", "rally_index"]
    r2 = lambda c: F.round(c, 2)
    f = flights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        r2("start_s").alias("start"), r2("end_s").alias("end"), "points", F.round("median_speed", 3).alias("median_speed"),
        F.round("max_speed", 3).alias("max_speed"), "in_play"))).alias("shuttle_flight"))
    h = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "speed_kmh", "speed_at_net_kmh"))).alias("hits"))
    p = peaks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "prominence_db"))).alias("audio_peaks"))
    d = rallies
    for part in (f, h, p):
        d = d.join(part, keys, "left")
    in_play = F.transform(F.filter("shuttle_flight", lambda s: s["in_play"]), lambda s: F.struct(s["start"], s["end"]))
    return d.withColumn("in_play", in_play)
