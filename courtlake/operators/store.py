"""Jobs, schools and students: the relational side."""
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_corners
from .tiles import as_list, tile_scan, top_n, with_totals

# Pipeline stages in order, expected seconds per pipeline.
STAGES = ["combine", "probe", "proxy", "rallies", "vision", "tracking", "render", "validate", "coach", "stitch"]
EXPECTED_S = {"cpu": 1800, "gpu": 600}


def backfill_jobs(jobs: DataFrame) -> DataFrame:
    """SRC-6: legacy rows: error means failed, the pipeline follows the options, times follow created/updated."""
    status = F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    gpu = F.coalesce(F.col("options"), F.lit("")).contains("tracknetv3")
    ended = status.isin("done", "failed")
    return jobs.withColumns({
        "status": status,
        "pipeline": F.when(F.coalesce("pipeline", F.lit("")).isin("", "unknown"), F.when(gpu, "gpu").otherwise("cpu")).otherwise(F.col("pipeline")),
        "started_at": F.coalesce("started_at", F.when(status.isin("done", "failed", "processing"), F.col("created_at"))),
        "finished_at": F.coalesce("finished_at", F.when(ended, F.col("updated_at")))})


def normalize_options(df: DataFrame, col: str = "options", coach_default: bool = True) -> DataFrame:
    """PRJ-2: engines folded to the supported set; corners only when they can be a court. ``col`` is a struct of
    shuttle, pose, coach, court_corners."""
    o = F.col(col)
    shuttle = F.lower(F.coalesce(o["shuttle"], F.lit("off")))
    pose = F.trim(F.lower(F.coalesce(o["pose"], F.lit("off"))))
    return df.withColumns({
        "shuttle": F.when(shuttle.isin("off", "tracknetv3"), shuttle).otherwise("off"),
        "pose": F.when(pose.isin("yolo11", "pose", "on", "true", "1"), "yolo11").otherwise("off"),
        "coach": F.coalesce(o["coach"], F.lit(coach_default)), "court_corners": valid_corners(o["court_corners"])})


def route_pipeline(df: DataFrame, pose_gpu: bool = True, gpu_ready: bool = True) -> DataFrame:
    """PRJ-3: cpu or gpu from normalized options, and the seconds to expect."""
    gpu = (F.col("shuttle") == "tracknetv3") | ((F.col("pose") == "yolo11") & F.lit(pose_gpu and gpu_ready))
    return df.withColumn("pipeline", F.when(gpu, "gpu").otherwise("cpu")).withColumn("expected_s", expected_seconds("pipeline"))


def expected_seconds(pipeline: str) -> Column:
    c = F.col(pipeline)
    return F.when(c == "cpu", EXPECTED_S["cpu"]).when(c == "gpu", EXPECTED_S["gpu"])


def queue_meta(jobs: DataFrame) -> DataFrame:
    """PRJ-9: generation time where it makes sense; the error only on failed jobs."""
    span = F.col("finished_at") - F.col("started_at")
    return jobs.withColumns({"pipeline": F.coalesce("pipeline", F.lit("unknown"))}).withColumns({
        "gen_seconds": F.when(span >= 0, span), "expected_gen_seconds": expected_seconds("pipeline"),
        "error": F.when(F.col("status") == "failed", F.col("error"))})


def stage_progress(jobs: DataFrame, stages: Sequence[str] = STAGES, id: str = "id") -> DataFrame:
    """PRJ-10: every stage of every job as done, active, failed or pending."""
    names = F.array(*map(F.lit, stages))
    at = F.array_position(names, F.col("stage")) - 1
    cur = F.when(at >= 0, at).when(F.col("status") == "queued", -1).otherwise(0)
    d = jobs.withColumn("_cur", cur).select(id, "status", "_cur", F.posexplode(names).alias("pos", "stage"))
    before, here = F.col("pos") < F.col("_cur"), F.col("pos") == F.col("_cur")
    state = (F.when(F.col("status") == "done", "done").when(before, "done")
             .when(here & (F.col("status") == "failed"), "failed").when(here & (F.col("status") == "processing"), "active").otherwise("pending"))
    return d.select(id, "pos", "stage", state.alias("state"))


def list_jobs(jobs: DataFrame, status: Sequence[str] | str | None = None, by: str = "created_at", limit: int | None = 60, desc: bool = True,
              id: str = "id") -> DataFrame:
    """SRT-1: newest first (or oldest first for the queue), limited."""
    d = jobs if status is None else jobs.filter(F.col("status").isin(as_list(status)))
    d = d.orderBy(F.desc(by) if desc else F.asc(by), F.asc(id))
    return d if limit is None else d.limit(limit)


def membership_of(memberships: DataFrame, schools: DataFrame) -> DataFrame:
    """JOIN-10: each user's earliest membership of an existing school."""
    d = memberships.join(schools.select("school_id", F.col("name").alias("school_name")), "school_id")
    return d.groupBy("user_id").agg(F.min_by(F.struct("school_id", "role", "school_name"), F.struct("created_at", "school_id")).alias("m")).select("user_id", "m.*")


def roster(memberships: DataFrame, users: DataFrame, role: str | None = None) -> DataFrame:
    """JOIN-11: members with their names, optionally of one role."""
    d = memberships if role is None else memberships.filter(F.col("role") == role)
    return d.join(users, "user_id")


def student_sessions(assign: DataFrame, jobs: DataFrame) -> DataFrame:
    """JOIN-12: finished jobs assigned to each student."""
    return assign.join(jobs.filter(F.col("status") == "done"), "job_id")


def assignees(assign: DataFrame, users: DataFrame) -> DataFrame:
    return assign.join(users.select(F.col("user_id").alias("student_id"), "name"), "student_id")


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: float) -> DataFrame:
    """JOIN-13: users behind sessions that have not expired."""
    return sessions.filter(F.col("expires_at") > as_of).join(users, "user_id")


def purge_sessions(sessions: DataFrame, as_of: float) -> DataFrame:
    return sessions.filter(F.col("expires_at") >= as_of)


def assignable(assign: DataFrame, jobs: DataFrame, memberships: DataFrame) -> DataFrame:
    """JOIN-14: assignments whose student belongs to the job's school."""
    students = memberships.filter(F.col("role") == "student").select(F.col("user_id").alias("student_id"), "school_id")
    return assign.join(jobs.select("job_id", "school_id"), "job_id").join(students, ["student_id", "school_id"], "left_semi")


def resolve_code(schools: DataFrame, codes: DataFrame) -> DataFrame:
    """SET-3: a join code, trimmed and upper-cased, to its school and role; student codes win."""
    known = schools.select("school_id", F.col("student_code").alias("_c"), F.lit("student").alias("role"), F.lit(0).alias("_p")).union(
        schools.select("school_id", "coach_code", F.lit("coach"), F.lit(1)))
    d = codes.withColumn("_c", F.upper(F.trim("code"))).join(known, "_c")
    return d.groupBy("code").agg(F.min_by(F.struct("school_id", "role"), F.struct("_p", "school_id")).alias("m")).select("code", "m.*")


def latest(df: DataFrame, pk: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-40: last write per key. ``max_by`` combines map-side, so a hot key ships one row per task."""
    pk = as_list(pk)
    rest = [c for c in df.columns if c not in pk]
    return df.groupBy(*pk).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_r")).select(*pk, "_r.*").select(*df.columns)


def job_state(events: DataFrame, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """WIN-40: current status per job; ``started_at`` is the first start since the last requeue."""
    d = tile_scan(events, ["job_id"], "ts", tie=tie, csum={"_epoch": (F.col("status") == "queued").cast("int")})
    rank = F.struct("ts", *tie)
    per = d.groupBy("job_id", "_epoch").agg(
        F.max_by("status", rank).alias("status"), F.max("ts").alias("updated_at"),
        F.min(F.when(F.col("status") != "queued", F.col("ts"))).alias("started_at"),
        F.max_by(F.when(F.col("status").isin("done", "failed"), F.col("ts")), rank).alias("finished_at"))
    return per.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at", "started_at", "finished_at"), "_epoch").alias("s")).select("job_id", "s.*")


def union_pool(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-6: rally pool plus current rallies, each once; the pool's row wins."""
    return a.unionByName(b.join(a.select(*as_list(keys)), as_list(keys), "left_anti"))


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-2: frame-level and track-level points, not de-duplicated."""
    return a.unionByName(b, allowMissingColumns=True)


def usage_cost(calls: DataFrame, in_rate: float = 0.30, out_rate: float = 2.50, key: str = "job_id") -> DataFrame:
    """AGG-10: tokens, calls and dollars per job; rates are per million tokens."""
    g = calls.groupBy(key).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))
    return g.withColumn("cost_usd", F.col("prompt_tokens") / 1e6 * in_rate + F.col("output_tokens") / 1e6 * out_rate)


def student_profile(assign: DataFrame, jobs: DataFrame, rallies: DataFrame, movement: DataFrame | None = None) -> DataFrame:
    """AGG-11: one row per student and session. The rally list stays a table (:func:`session_rallies`), so a
    session of any length is aggregated, never gathered."""
    per = rallies.groupBy("job_id").agg(F.count("*").alias("n_rallies"), F.max("dur").alias("longest_rally"), F.sum("dur").alias("play_s"))
    d = student_sessions(assign, jobs).join(per, "job_id", "left").withColumns(
        {"n_rallies": F.coalesce("n_rallies", F.lit(0)), "longest_rally": F.coalesce("longest_rally", F.lit(0.0)), "play_s": F.coalesce("play_s", F.lit(0.0))})
    if movement is not None:
        d = d.join(movement.withColumnRenamed("player_id", "_pid"), (d.job_id == movement.job_id) & (d.player_id == F.col("_pid")), "left").drop(movement.job_id).drop("_pid")
    return d


def session_rallies(assign: DataFrame, jobs: DataFrame, rallies: DataFrame) -> DataFrame:
    return student_sessions(assign, jobs).select("student_id", "job_id").join(rallies, "job_id")


def student_totals(profile: DataFrame, keys: Sequence[str] = ("student_id",), rollup: bool = False, rollup_keys: Sequence[str] = ("school_id", "student_id", "job_id"),
                   distance: str = "distance_m") -> DataFrame:
    """AGG-12: totals per student, or a school / student / session rollup."""
    aggs = [F.count("*").alias("sessions"), F.sum("n_rallies").alias("total_rallies"), F.max("longest_rally").alias("longest_ever"), F.sum(distance).alias("total_distance")]
    return profile.rollup(*rollup_keys).agg(*aggs) if rollup else profile.groupBy(*as_list(keys)).agg(*aggs)


def scaled_series(profile: DataFrame, value: str, keys: Sequence[str] = ("student_id",)) -> DataFrame:
    """AGG-12: a value scaled to its student's minimum and maximum."""
    d = with_totals(profile, keys, _lo=F.min(value), _hi=F.max(value))
    return d.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def school_overview(jobs: DataFrame, assign: DataFrame, users: DataFrame, limit: int = 120) -> DataFrame:
    """AGG-13: newest ``limit`` sessions per school, a row per assignee (one row without any) and their count. The
    assignees stay rows: a session shared by very many students is joined, never gathered."""
    listed = top_n(jobs, ["school_id"], [F.desc("created_at"), F.asc("job_id")], limit, out="_rn").drop("_rn")
    who = assignees(assign, users).join(listed.select("job_id"), "job_id", "left_semi")
    n = who.groupBy("job_id").agg(F.count("*").alias("n_assignees"))
    out = listed.join(n, "job_id", "left").withColumn("n_assignees", F.coalesce("n_assignees", F.lit(0)))
    return out.join(who.withColumnRenamed("name", "assignee"), "job_id", "left")


def visible_codes(schools: DataFrame, viewers: DataFrame) -> DataFrame:
    """AGG-13: the coach code shows to admins only."""
    d = viewers.filter(F.col("role").isin("admin", "coach")).join(schools, "school_id")
    return d.withColumn("coach_code", F.when(F.col("role") == "admin", F.col("coach_code")))


def quality_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Table constraints as counts of violating rows."""
    g = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return g.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])))


def admit(requests: DataFrame, n: int = 8, window_s: float = 600.0, key: str = "client", id: str = "req_id") -> DataFrame:
    """STR-3, batch form: admit a request unless ``n`` admitted ones lie within the window before it. A pause of a
    whole window empties the memory, so clients are cut there."""
    from .folds import ordered_fold
    from .tiles import sessionize

    d = tile_scan(requests, [key], "t", tie=[id], break_on=["t"], breaks=lambda c, p: c("t") - p("t") >= window_s, seg="_piece")

    def walk(rows):
        hits = []
        for t, rid in rows:
            hits = [h for h in hits if t - h < window_s]
            ok = len(hits) < n
            if ok:
                hits.append(t)
            yield rid, t, ok

    return ordered_fold(d, [key, "_piece"], ["t", id], walk, f"{id} long, t double, admitted boolean", ["t", id]).drop("_piece")


def ordered_chunks(chunks: DataFrame, key: str = "upload_id", arrival: str = "arrival") -> DataFrame:
    """STR-5, batch form: accept the next chunk, ignore a repeat of the last one, refuse anything else."""
    from .folds import ordered_fold

    def walk(rows):
        done = 0
        for a, i in rows:
            state = "duplicate" if i == done - 1 else "accepted" if i == done else "gap"
            done += state == "accepted"
            yield a, i, state

    return ordered_fold(chunks, [key], [arrival], walk, f"{arrival} long, chunk_no long, verdict string", [arrival, "chunk_no"])


def budget_monitor(status: DataFrame, stall: float = 150.0, queue_max: float = 900.0, run_max: float = 1200.0, key: str = "run_id") -> DataFrame:
    """STR-6, batch form: queue time and run time have separate budgets. Reads t, state and active_workers per status
    event; the run clock starts at the first running state."""
    queued, ended = F.col("state") == "IN_QUEUE", F.col("state").isin("COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT")
    g = with_totals(status, [key], _t0=F.min("t"), _run=F.min(F.when(~queued & ~ended, F.col("t"))))
    waited, ran = F.col("t") - F.col("_t0"), F.col("t") - F.col("_run")
    verdict = (F.when(F.col("state") == "COMPLETED", "completed").when(ended, "failed")
               .when(queued & (waited > stall) & (F.col("active_workers") == 0), "no_workers").when(queued & (waited > queue_max), "queue_timeout")
               .when(~queued & (ran > run_max), "run_timeout"))
    d = g.withColumn("verdict", verdict)
    first = d.groupBy(key).agg(F.min_by(F.struct("verdict", "t"), F.when(F.col("verdict").isNotNull(), F.struct("t", "event_id"))).alias("v"), F.max("t").alias("_last"))
    return first.select(key, F.coalesce("v.verdict", F.lit("open")).alias("verdict"), F.coalesce("v.t", "_last").alias("t"))


def expire_uploads(chunks: DataFrame, as_of: float, hours: float = 24.0, key: str = "upload_id") -> DataFrame:
    """STR-7, batch form: uploads silent for longer than ``hours``."""
    g = chunks.groupBy(key).agg(F.max("t").alias("last_t"))
    return g.withColumn("expired", F.col("last_t") < as_of - hours * 3600.0)
