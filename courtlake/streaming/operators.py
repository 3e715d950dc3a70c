"""Online forms of the tracking and job operators. Each equals its batch form on in-order input.

State ends: every keyed operator drops a key's state when the watermark has passed the time from which it cannot matter any more. Rows
behind the watermark are left out."""
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import SHIFT_S, fold_stream

#: Seconds a job of each pipeline may take.
EXPECTED_S = {"gpu": 600.0, "cpu": 1800.0}


def event_time(t: str = "t"):
    """Seconds as a timestamp, for watermarks."""
    return F.timestamp_micros(F.round(F.col(t) * 1000000).cast("long"))


def _marked(df: DataFrame, delay: str, t: str = "t") -> DataFrame:
    moved = F.timestamp_micros(F.round((F.col(t) + SHIFT_S) * 1000000).cast("long"))
    return df.withColumn("_event_time", moved).withWatermark("_event_time", delay)


def flight_sessions(points: DataFrame, keys: Sequence[str], gap: float = 0.25, delay: str = "2 seconds", min_conf: float = 0.3,
                    min_speed: float = 0.15, min_dur: float = 0.4, min_points: int = 3) -> DataFrame:
    """STR-1: flights as they close, with the in-play verdict. The state of an open flight is its points; flights
    are cut by gaps, so it empties whenever the shuttle is out of sight."""
    d = points.filter(F.coalesce("confidence", F.lit(1.0)) >= min_conf).withColumn("ts", event_time()).withWatermark("ts", delay)
    g = d.groupBy(*keys, F.session_window("ts", f"{int(round(gap * 1e6))} microseconds").alias("w")).agg(F.sort_array(F.collect_list(F.struct("t", "pid", "x", "y"))).alias("p"))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    speed = F.transform(F.filter(pairs, lambda z: z["b"]["t"] - z["a"]["t"] > 1e-3),
                        lambda z: F.hypot(z["b"]["x"] - z["a"]["x"], z["b"]["y"] - z["a"]["y"]) / (z["b"]["t"] - z["a"]["t"]))
    g = g.filter(F.size("p") >= min_points).withColumn("v", F.sort_array(speed)).filter(F.size("v") > 0)
    d = g.select(*keys, F.get("p", F.lit(0))["t"].alias("start_s"), F.element_at("p", -1)["t"].alias("end_s"), F.size("p").alias("points"),
                 F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median_speed"), F.element_at("v", -1).alias("max_speed"))
    return d.withColumn("in_play", (F.col("median_speed") >= min_speed) & (F.col("end_s") - F.col("start_s") >= min_dur))


def one_euro_stream(points: DataFrame, key: str, cols: Sequence[str] = ("x", "y"), min_cutoff: float = 1.0, beta: float = 1.5, d_cutoff: float = 1.0,
                    reset: float = 1.5, min_conf: float = 0.15, id: str = "pid", delay: str = "2 seconds") -> DataFrame:
    """STR-2: the online smoother, one state per series; an absence over ``reset`` starts afresh, and ends the state."""
    cols = list(cols)

    def alpha(dt, cutoff):
        return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * max(cutoff, 1e-6)) / max(dt, 1e-6))

    def step(s, r):
        if r["confidence"] < min_conf:
            return s, [(r[id], *[r[c] for c in cols])]
        if s is None or r["t"] - s["t"] > reset or r["t"] <= s["t"]:
            s = {"t": r["t"], "y": [r[c] for c in cols], "v": [0.0] * len(cols)}
        else:
            dt = r["t"] - s["t"]
            for i, c in enumerate(cols):
                s["v"][i] += alpha(dt, d_cutoff) * ((r[c] - s["y"][i]) / dt - s["v"][i])
                s["y"][i] += alpha(dt, min_cutoff + beta * abs(s["v"][i])) * (r[c] - s["y"][i])
            s["t"] = r["t"]
        return s, [(r[id], *s["y"])]

    return fold_stream(_marked(points, delay), key, ["t", id], step, f"{key} bigint, {id} bigint, " + ", ".join(f"{c} double" for c in cols), time="t", idle=reset)


def admit(requests: DataFrame, n: int = 8, window_s: float = 600.0, key: str = "client", id: str = "req_id", delay: str = "1 minute") -> DataFrame:
    """STR-3: admit a request unless ``n`` admitted ones lie within the window before it. A client that is silent for a window is forgotten."""

    def step(s, r):
        hits = [h for h in (s or {}).get("hits", []) if r["t"] - h < window_s]
        ok = len(hits) < n
        return {"hits": [*hits, r["t"]] if ok else hits}, [(r[id], ok)]

    return fold_stream(_marked(requests, delay), key, ["t", id], step, f"{key} bigint, {id} bigint, admitted boolean", time="t", idle=window_s)


def job_state(events: DataFrame, expected_s: float = 1800.0, key: str = "job_id") -> DataFrame:
    """STR-4: per batch the current state of every touched job: status, times since the last requeue, and whether it
    runs longer than expected. ``version`` orders the rows of a job, so a reader keeps the latest."""

    def step(s, r):
        s = s or {"version": 0}
        if r["status"] == "queued":
            s = {"version": s["version"], "started_at": None}
        elif s.get("started_at") is None:
            s["started_at"] = r["ts"]
        s.update(status=r["status"], updated_at=r["ts"], version=s["version"] + 1, finished_at=r["ts"] if r["status"] in ("done", "failed") else None)
        return s, []

    def flush(s):
        late = s["status"] == "processing" and s.get("started_at") is not None and s["updated_at"] - s["started_at"] > expected_s
        return [(s["version"], s["status"], s["updated_at"], s.get("started_at"), s.get("finished_at"), late)]

    return fold_stream(events, key, ["ts", "event_id"], step, f"{key} bigint, version bigint, status string, updated_at double, started_at double, finished_at double, overdue boolean",
                       flush=flush, mode="update")


def overdue_jobs(events: DataFrame, jobs: DataFrame, expected: Mapping[str, float] = EXPECTED_S, key: str = "job_id", delay: str = "5 seconds") -> DataFrame:
    """STR-4 with the budget of each job's pipeline: the stream is joined to the job table, and a job that is processing for longer
    than its pipeline may take is overdue until it is queued again, whether a later event or only the clock shows it.
    A job of an unknown pipeline has no budget. ``version`` orders the rows of a job."""
    budget = F.lit(None).cast("double")
    for name, seconds in expected.items():
        budget = F.when(F.col("pipeline") == name, float(seconds)).otherwise(budget)
    budgets = jobs.select(F.col("id").alias(key) if "id" in jobs.columns and key not in jobs.columns else F.col(key), budget.alias("expected_s"))

    def row(s):
        return [(s["version"], s["status"], s["at"], s["overdue"])]

    def step(s, r):
        s = s or {"version": 0, "started": None, "overdue": False, "status": None, "budget": r["expected_s"] if r["expected_s"] == r["expected_s"] else None}
        deadline = s.get("deadline")
        if deadline is not None and r["ts"] > deadline:
            s["overdue"] = True
        if r["status"] == "queued":
            s.update(started=None, overdue=False)
        elif s["started"] is None:
            s["started"] = r["ts"]
        s.update(status=r["status"], at=r["ts"], version=s["version"] + 1)
        runs = r["status"] == "processing" and s["budget"] is not None and not s["overdue"]
        s["deadline"] = s["started"] + s["budget"] if runs else None
        return s, []

    def fire(s):
        s.update(overdue=True, deadline=None, version=s["version"] + 1)
        return s, row(s)

    known = _marked(events, delay, "ts").join(budgets, key, "left")
    return fold_stream(known, key, ["ts", "event_id"], step, f"{key} bigint, version bigint, status string, updated_at double, overdue boolean",
                       on_timer=fire, flush=row, mode="update", time="ts")


def upsert_sink(path: str):
    """STR-4 sink for ``foreachBatch``: one folder per batch, overwritten on a retry, so replays change nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def ordered_chunks(chunks: DataFrame, key: str = "upload_id", arrival: str = "arrival", size: str | None = None, declared: str | None = None,
                   most: float = math.inf, hours: float = 24.0, delay: str = "1 minute") -> DataFrame:
    """STR-5: accept the next chunk, ignore a repeat of the last one, refuse anything else. With ``size`` (a column of bytes) an
    empty chunk is refused too, and one that would carry the upload past its ``declared`` size (a column) or past ``most``. An upload that is
    silent for ``hours`` is forgotten."""

    def step(s, r):
        s = s or {"done": 0, "bytes": 0}
        no, n = r["chunk_no"], 0 if size is None else int(r[size])
        if no != s["done"]:
            verdict = "duplicate" if no == s["done"] - 1 else "gap"
        elif size is not None and n <= 0:
            verdict = "empty"
        elif size is not None and s["bytes"] + n > min(most, math.inf if declared is None else r[declared]):
            verdict = "too_large"
        else:
            verdict, s = "accepted", {"done": no + 1, "bytes": s["bytes"] + n}
        return s, [(r[arrival], no, verdict)]

    return fold_stream(_marked(chunks, delay), key, [arrival], step, f"{key} bigint, {arrival} bigint, chunk_no bigint, verdict string", time="t", idle=hours * 3600.0)


def dedupe_chunks(chunks: DataFrame, key: str = "upload_id", delay: str = "10 minutes") -> DataFrame:
    """STR-5 without order: the first arrival of each chunk number within the watermark."""
    return _marked(chunks, delay).dropDuplicatesWithinWatermark([key, "chunk_no"]).drop("_event_time")


def budget_monitor(status: DataFrame, stall: float = 150.0, queue_max: float = 900.0, run_max: float = 1200.0, key: str = "run_id",
                   forget: float = 3600.0, delay: str = "5 seconds") -> DataFrame:
    """STR-6: separate budgets for queueing and running; one verdict per run, at the event that settles it. A run that is
    silent for ``forget`` seconds is forgotten."""

    def step(s, r):
        s = s or {"t0": r["t"], "run": None, "closed": False}
        if s["closed"]:
            return s, []
        t, state, verdict = r["t"], r["state"], None
        if state == "COMPLETED":
            verdict = "completed"
        elif state in ("FAILED", "CANCELLED", "TIMED_OUT"):
            verdict = "failed"
        elif state == "IN_QUEUE":
            if t - s["t0"] > stall and r["active_workers"] == 0:
                verdict = "no_workers"
            elif t - s["t0"] > queue_max:
                verdict = "queue_timeout"
        else:
            s["run"] = t if s["run"] is None else s["run"]
            if t - s["run"] > run_max:
                verdict = "run_timeout"
        s["closed"] = verdict is not None
        return s, [(verdict, t)] if verdict else []

    return fold_stream(_marked(status, delay), key, ["t", "event_id"], step, f"{key} bigint, verdict string, t double", time="t", idle=forget)


def run_deadlines(status: DataFrame, stall: float = 150.0, queue_max: float = 900.0, run_max: float = 1200.0, key: str = "run_id", forget: float = 3600.0,
                  delay: str = "5 seconds") -> DataFrame:
    """STR-6 for silent runs: one verdict per run, at its last state or when the clock passes a deadline without one.

    A queued run has until ``queue_max`` after its first event, but only until ``stall`` when no worker was there at its last one; a run
    that has started has ``run_max`` from then. An event later than the deadline comes too late, whether the timer
    has fired by then or both are in one batch, so verdicts do not depend on batches. A closed run is remembered for ``forget``
    seconds, so that what still comes of it is ignored."""

    def step(s, r):
        s = s or {"t0": r["t"], "run": None, "closed": False, "deadline": None}
        if s["closed"]:
            return s, []
        if s["deadline"] is not None and r["t"] > s["deadline"]:
            return fire(s)
        if r["state"] in ("COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT"):
            return {**s, "deadline": None, "closed": True}, [("completed" if r["state"] == "COMPLETED" else "failed", r["t"])]
        if r["state"] != "IN_QUEUE" and s["run"] is None:
            s["run"] = r["t"]
        if s["run"] is not None:
            s["deadline"], s["why"] = s["run"] + run_max, "run_timeout"
        else:
            s["deadline"], s["why"] = s["t0"] + queue_max, "queue_timeout"
            if r["active_workers"] == 0 and max(s["t0"] + stall, r["t"]) <= s["deadline"]:
                s["deadline"], s["why"] = max(s["t0"] + stall, r["t"]), "no_workers"
        return s, []

    def fire(s):
        return {**s, "deadline": None, "closed": True}, [(s["why"], s["deadline"])]

    return fold_stream(_marked(status, delay), key, ["t", "event_id"], step, f"{key} bigint, verdict string, t double", on_timer=fire, time="t", idle=forget)


def expire_uploads(chunks: DataFrame, hours: float = 24.0, key: str = "upload_id", delay: str = "1 minute") -> DataFrame:
    """STR-7: one row when an upload has been silent for ``hours``."""
    d = chunks.withColumn("ts", event_time()).withWatermark("ts", delay)
    return d.groupBy(key, F.session_window("ts", f"{int(hours * 3600 * 1000)} milliseconds").alias("w")).agg(F.max("t").alias("last_t")).select(key, "last_t")


def energy_max(series: DataFrame, win: str = "250 milliseconds", key: str = "job_id", delay: str = "1 second") -> DataFrame:
    """STR-8: loudest value per tumbling window."""
    d = series.withColumn("ts", event_time()).withWatermark("ts", delay)
    return d.groupBy(key, F.window("ts", win).alias("w")).agg(F.max("db").alias("db"), F.count("*").alias("n")).select(
        key, (F.unix_micros("w.start") / 1e6).alias("t"), "db", "n")


def energy_windows(samples: DataFrame, win: str = "100 milliseconds", hop: str = "50 milliseconds", key: str = "job_id", floor: float = -80.0, delay: str = "1 second") -> DataFrame:
    """STR-8: RMS energy in sliding windows; only the sums are kept as state."""
    from ..functions.scalar import to_db

    d = samples.withColumn("ts", event_time()).withWatermark("ts", delay)
    g = d.groupBy(key, F.window("ts", win, hop).alias("w")).agg(F.sum(F.col("s") * F.col("s")).alias("_sq"), F.count("*").alias("n"))
    return g.select(key, (F.unix_micros("w.start") / 1e6).alias("t"), to_db(F.sqrt(F.col("_sq") / F.col("n")), floor).alias("db"), "n")
