"""Online operators drained over whole tables, checked with their batch forms' SQL."""
from pyspark.sql import functions as F

from ..streaming import operators as st
from ..streaming.runner import drain, feed, fresh_root
from .adapters import load
from .q_quality import PCM, SERIES, pcm, series
from .q_store import CHUNKS, RUNS, STATUS, chunks, runs, statuses
from .adapters import ctes
from .registry import ORACLES, query
from . import q_segments, q_store  # noqa: F401  (their SQL is reused)


def _same(name: str) -> str:
    """The batch query's SQL, already shaped to its columns."""
    return ORACLES[name]


def _sentinel(df, key: str, t: str = "t"):
    """One row far after the table's last, under a key of its own."""
    row = df.agg(*[(F.max(c) + 1e6 if c == t else F.lit(-1).cast(df.schema[c].dataType) if c == key else F.max(c)).alias(c) for c in df.columns])
    return row.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def _late(df, key: str, t: str, value: int):
    """One row at the very start, of a key of its own, for the end of a stream."""
    row = df.agg(*[(F.min(c) if c == t else F.lit(value).cast(df.schema[c].dataType) if c == key else F.min(c)).alias(c) for c in df.columns])
    return row.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


@query("stream_flight_sessions", "STR-1", "track_id:i start_s:d end_s:d points:i median_speed:d max_speed:d in_play:b", f"SELECT * FROM ({_same('flight_segments')})")
def stream_flights(spark, sf):
    root = fresh_root(spark)
    p = load(spark, sf, "pts").select("track_id", "pid", "t", "x", "y", "confidence")
    s = _sentinel(p, "track_id").withColumn("confidence", F.lit(1.0))
    return drain(st.flight_sessions(feed(spark, p, root, sentinel=s), ["track_id"], gap=12.0), root)


@query("stream_one_euro", "STR-2", "rally_index:i pid:i x:d y:d", f"SELECT * FROM ({_same('one_euro')})")
def stream_one_euro(spark, sf):
    root = fresh_root(spark)
    d = load(spark, sf, "dense").select("rally_index", "pid", "t", "x", "y", "confidence")
    return drain(st.one_euro_stream(feed(spark, d, root), "rally_index"), root)


@query("stream_admission", "STR-3", "client:i req_id:i admitted:b", f"SELECT * FROM ({_same('admission_throttle')})")
def stream_admission(spark, sf):
    root = fresh_root(spark)
    r = load(spark, sf, "pts").selectExpr("track_id as client", "pid as req_id", "t")
    return drain(st.admit(feed(spark, r, root), 3, 60.0), root)


@query("stream_job_state", "STR-4 WIN-40", "job_id:i status:s updated_at:d started_at:d finished_at:d", f"SELECT * FROM ({_same('job_state')})")
def stream_job_state(spark, sf):
    from ..operators.store import latest

    root = fresh_root(spark)
    out = drain(st.job_state(feed(spark, statuses(spark, sf), root, order="ts")), root, "update", st.upsert_sink)
    return latest(out, ["job_id"], "version")


@query("stream_chunks", "STR-5", "upload_id:i arrival:i chunk_no:i verdict:s", f"SELECT * FROM ({_same('chunk_ingest')})")
def stream_chunks(spark, sf):
    root = fresh_root(spark)
    return drain(st.ordered_chunks(feed(spark, chunks(spark, sf), root, order="arrival")), root)


@query("stream_budget_monitor", "STR-6", "run_id:i verdict:s t:d", f"SELECT * FROM ({_same('budget_monitor')}) WHERE verdict <> 'open'")
def stream_budget(spark, sf):
    root = fresh_root(spark)
    return drain(st.budget_monitor(feed(spark, runs(spark, sf), root), 15.0, 90.0, 60.0), root)


# Every user's events are a job's; what pipeline a job has follows from its number, some have none.
@query("stream_overdue", "STR-4", "job_id:i status:s updated_at:d overdue:b", ctes("pts") + f""",
{STATUS},
budget AS (SELECT DISTINCT job_id, CASE job_id % 3 WHEN 0 THEN 6e0 WHEN 1 THEN 18e0 END AS expected FROM status),
e AS (SELECT *, sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS ep,
  lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM status),
s AS (SELECT *, min(ts) FILTER (status <> 'queued') OVER (PARTITION BY job_id, ep ORDER BY ts, event_id) AS started FROM e),
l AS (SELECT * FROM s JOIN budget USING (job_id) QUALIFY ep = max(ep) OVER (PARTITION BY job_id))
SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at,
  coalesce(bool_or(status = 'processing' AND expected IS NOT NULL AND (next_ts IS NULL OR next_ts > started + expected)), false) AS overdue FROM l GROUP BY job_id""")
def stream_overdue(spark, sf):
    from ..operators.store import latest

    root = fresh_root(spark)
    s = statuses(spark, sf)
    jobs = s.select("job_id").distinct().selectExpr("job_id", "case job_id % 3 when 0 then 'gpu' when 1 then 'cpu' end as pipeline")
    end = _sentinel(s, "job_id", "ts")
    late = _late(s, "job_id", "ts", -2)
    out = drain(st.overdue_jobs(feed(spark, s, root, order="ts", sentinel=end, late=late), jobs, {"gpu": 6.0, "cpu": 18.0}), root, "update", st.upsert_sink)
    return latest(out, ["job_id"], "version").filter("job_id <> -1")


@query("stream_run_deadlines", "STR-6", "run_id:i verdict:s t:d", ctes("pts") + f""",
{RUNS},
o AS (SELECT *, min(t) OVER (PARTITION BY run_id) AS t0, min(CASE WHEN state = 'RUNNING' THEN t END) OVER (PARTITION BY run_id ORDER BY t, event_id) AS run,
  lead(t) OVER (PARTITION BY run_id ORDER BY t, event_id) AS next_t FROM runs),
d AS (SELECT *, CASE WHEN run IS NOT NULL THEN run + 60 WHEN active_workers = 0 THEN least(t0 + 90, greatest(t0 + 15, t)) ELSE t0 + 90 END AS deadline,
  CASE WHEN run IS NOT NULL THEN 'run_timeout' WHEN active_workers = 0 AND greatest(t0 + 15, t) <= t0 + 90 THEN 'no_workers' ELSE 'queue_timeout' END AS why FROM o),
v AS (SELECT *, CASE state WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE why END AS verdict, CASE WHEN state IN ('COMPLETED', 'FAILED') THEN t ELSE deadline END AS at_t FROM d
  WHERE state IN ('COMPLETED', 'FAILED') OR next_t IS NULL OR next_t > deadline)
SELECT run_id, arg_min(verdict, (t, event_id)) AS verdict, arg_min(at_t, (t, event_id)) AS t FROM v GROUP BY run_id""")
def stream_run_deadlines(spark, sf):
    root = fresh_root(spark)
    r = runs(spark, sf)
    stream = feed(spark, r, root, parts=5, sentinel=_sentinel(r, "run_id"), late=_late(r, "run_id", "t", -2))
    return drain(st.run_deadlines(stream, 15.0, 90.0, 60.0), root).filter("run_id <> -1")


SIZES = "case when arrival % 17 = 3 then 0 else 1000 + arrival % 500 end as bytes"
CAP, DECLARED = 45000, "20000 + upload_id % 7 * 5000 as declared"


@query("stream_chunk_cap", "STR-5", "upload_id:i arrival:i chunk_no:i verdict:s", "WITH RECURSIVE" + ctes("pts")[4:] + f""",
{CHUNKS},
o AS (SELECT *, {SIZES}, {DECLARED}, row_number() OVER (PARTITION BY upload_id ORDER BY arrival) AS rn FROM ck),
j AS (SELECT *, CASE WHEN bytes <= 0 THEN 'empty' END AS why FROM o),
w AS (SELECT upload_id, 0::BIGINT AS rn, NULL::BIGINT AS arrival, NULL::BIGINT AS chunk_no, 0::BIGINT AS done, 0::BIGINT AS held, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT upload_id FROM o)
  UNION ALL SELECT upload_id, rn, arrival, chunk_no, done + CASE verdict WHEN 'accepted' THEN 1 ELSE 0 END, held + CASE verdict WHEN 'accepted' THEN bytes ELSE 0 END, verdict FROM
    (SELECT j.upload_id, j.rn, j.arrival, j.chunk_no, j.bytes, w.done, w.held, CASE WHEN j.chunk_no = w.done - 1 THEN 'duplicate' WHEN j.chunk_no <> w.done THEN 'gap' WHEN j.why IS NOT NULL THEN j.why
      WHEN w.held + j.bytes > least(j.declared, {CAP}) THEN 'too_large' ELSE 'accepted' END AS verdict FROM w JOIN j ON j.upload_id = w.upload_id AND j.rn = w.rn + 1))
SELECT upload_id, arrival, chunk_no, verdict FROM w WHERE arrival IS NOT NULL""")
def stream_chunk_cap(spark, sf):
    root = fresh_root(spark)
    c = chunks(spark, sf).selectExpr("*", SIZES, DECLARED)
    return drain(st.ordered_chunks(feed(spark, c, root, parts=4, order="arrival"), size="bytes", declared="declared", most=CAP, delay="1 hour"), root)


@query("stream_chunks_any_order", "STR-5", "upload_id:i chunk_no:i", ctes("pts") + f""",
{CHUNKS}
SELECT DISTINCT upload_id, chunk_no FROM ck""")
def stream_chunks_any_order(spark, sf):
    """Arrivals in an order of their own (by a hash), so that repeats of a chunk lie in different batches."""
    root = fresh_root(spark)
    c = chunks(spark, sf).withColumn("mixed", F.pmod(F.hash("arrival"), F.lit(100000)))
    return drain(st.dedupe_chunks(feed(spark, c, root, parts=4, order="mixed"), delay="1 hour"), root)


@query("stream_expired_uploads", "STR-7", "upload_id:i last_t:d", f"SELECT upload_id, last_t FROM ({_same('expire_uploads')})")
def stream_expiry(spark, sf):
    root = fresh_root(spark)
    c = load(spark, sf, "pts").selectExpr("track_id as upload_id", "t")
    return drain(st.expire_uploads(feed(spark, c, root, sentinel=_sentinel(c, "upload_id")), 24.0), root)


@query("stream_energy_max", "STR-8 AGG-20", "job_id:i t:d db:d n:i", ctes("pts") + f""",
{SERIES}
SELECT job_id, floor(floor(t * 1000000 + 5e-1) / 10000000) * 10 AS t, max(db) AS db, count(*) AS n FROM ser GROUP BY 1, 2""")
def stream_energy_max(spark, sf):
    root = fresh_root(spark)
    s = series(spark, sf)
    return drain(st.energy_max(feed(spark, s, root, sentinel=_sentinel(s, "job_id")), "10 seconds"), root).filter("job_id >= 0")


@query("stream_energy_windows", "STR-8 AGG-19", "job_id:i t:d db:d n:i", ctes("pts") + f""",
{PCM},
h AS (SELECT job_id, i // 2 AS h, sum(s * s) AS sq, count(*) AS n FROM pcm GROUP BY 1, 2),
w AS (SELECT job_id, unnest([h, h - 1]) AS w, sq, n FROM h)
SELECT job_id, w * 5e-2 AS t, 20 * log10(greatest(1e-4, sqrt(sum(sq) / sum(n)))) AS db, sum(n) AS n FROM w GROUP BY 1, 2""")
def stream_energy_windows(spark, sf):
    root = fresh_root(spark)
    d = pcm(spark, sf).selectExpr("job_id", "i / 40e0 as t", "s")
    return drain(st.energy_windows(feed(spark, d, root, sentinel=_sentinel(d, "job_id"))), root).filter("job_id >= 0")
