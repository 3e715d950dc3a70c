"""Queries over jobs, schools and students."""
from pyspark.sql import functions as F

from ..operators import store
from ..operators.court import movement_stats
from .adapters import ctes, load, table
from .registry import query


@query("list_jobs_gallery", "SRT-1", "id:i finished_at:i rank:i", ctes("jobs") + """
SELECT id, finished_at, row_number() OVER (ORDER BY finished_at DESC, id) AS rank FROM jobs WHERE status = 'done' ORDER BY finished_at DESC, id LIMIT 60""")
def gallery(spark, sf):
    from pyspark.sql import Window

    d = store.list_jobs(load(spark, sf, "jobs"), "done", "finished_at", 60)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("finished_at"), F.asc("id"))))   # 60 rows


@query("list_jobs_pending", "SRT-1", "id:i created_at:i", ctes("jobs") + """
SELECT id, created_at FROM jobs WHERE status IN ('queued', 'processing')""")
def pending(spark, sf):
    return store.list_jobs(load(spark, sf, "jobs"), ["queued", "processing"], "created_at", None, desc=False)


def legacy(spark, sf):
    return load(spark, sf, "jobs").selectExpr(
        "id", "case when status = 'failed' then 'error' else status end as status", "case when id % 3 = 0 then '{\"shuttle\": \"tracknetv3\"}' when id % 3 = 1 then '{}' end as options",
        "case when id % 4 = 0 then pipeline when id % 4 = 1 then 'unknown' when id % 4 = 2 then '' end as pipeline", "created_at", "finished_at as updated_at",
        "case when id % 5 = 0 then started_at end as started_at", "case when id % 7 = 0 then finished_at end as finished_at")


@query("backfill_jobs", "SRC-6 SRC-5", "id:i status:s pipeline:s started_at:i finished_at:i", ctes("jobs") + """,
l AS (SELECT id, status AS st, id % 3 = 0 AS tn, CASE WHEN id % 4 = 0 THEN pipeline END AS p, created_at, finished_at AS upd, CASE WHEN id % 5 = 0 THEN started_at END AS s, CASE WHEN id % 7 = 0 THEN finished_at END AS f FROM jobs)
SELECT id, st AS status, coalesce(p, CASE WHEN tn THEN 'gpu' ELSE 'cpu' END) AS pipeline, coalesce(s, CASE WHEN st <> 'queued' THEN created_at END) AS started_at, coalesce(f, CASE WHEN st <> 'queued' THEN upd END) AS finished_at FROM l""")
def backfill(spark, sf):
    return store.backfill_jobs(legacy(spark, sf))


@query("read_store", "SRC-5", "id:i user_name:s school:s sessions:i students:i", ctes("jobs", "members", "schools") + """,
s AS (SELECT user_id, count(*) AS n FROM members WHERE role = 'coach' GROUP BY 1)
SELECT j.id, u.name AS user_name, c.name AS school, coalesce(s.n, 0) AS sessions, CASE WHEN j.id % 3 = 0 THEN 1 ELSE 0 END AS students
FROM jobs j JOIN members u ON u.user_id = j.uploaded_by JOIN schools c ON c.school_id = u.school_id LEFT JOIN s ON s.user_id = u.user_id""")
def read_store(spark, sf):
    """The six tables, written as a store and read back, joined along their keys."""
    from ..session import scratch_dir
    from ..sources import tables

    root = scratch_dir(spark, "store")
    jobs, members, schools = (load(spark, sf, n) for n in ("jobs", "members", "schools"))
    parts = {
        "jobs": jobs.select("id", "uploaded_by", "status"), "users": members.select("user_id", "name"), "schools": schools.select("school_id", F.col("name").alias("school")),
        "memberships": members.select("user_id", "school_id", "role"), "auth_sessions": members.filter("role = 'coach'").select("user_id", F.expr("user_id * 31").alias("token")),
        "job_students": jobs.filter("id % 3 = 0").selectExpr("id as job_id", "uploaded_by as student_id")}
    for name, df in parts.items():
        df.write.parquet(f"{root}/{name}")
    t = tables.read_store(spark, root)
    live = t["auth_sessions"].groupBy("user_id").agg(F.count("*").alias("sessions"))
    assigned = t["job_students"].groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("students"))
    d = t["jobs"].withColumnRenamed("uploaded_by", "user_id").join(t["users"], "user_id").join(t["memberships"], "user_id").join(t["schools"], "school_id")
    d = d.join(live, "user_id", "left").join(assigned, "id", "left")
    return d.select("id", F.col("name").alias("user_name"), "school", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("students", F.lit(0)).alias("students"))


@query("queue_meta", "PRJ-9", "id:i gen_seconds:d expected_gen_seconds:i error:s", ctes("jobs") + """
SELECT id, CASE WHEN finished_at >= started_at THEN finished_at - started_at END AS gen_seconds, CASE pipeline WHEN 'cpu' THEN 1800 ELSE 600 END AS expected_gen_seconds, CASE WHEN status = 'failed' THEN priority END AS error FROM jobs""")
def queue_meta(spark, sf):
    return store.queue_meta(load(spark, sf, "jobs").withColumn("error", F.col("priority")))


_STAGE = "CASE WHEN status = 'queued' THEN 'queued' ELSE list_extract(['combine','probe','proxy','rallies','vision','tracking','render','validate','coach','stitch'], cast(id % 10 + 1 AS BIGINT)) END"


@query("stage_progress", "PRJ-10", "id:i pos:i stage:s state:s", ctes("jobs") + f""",
j AS (SELECT id, CASE WHEN id % 11 = 0 AND status = 'failed' THEN 'processing' ELSE status END AS status, {_STAGE} AS cur FROM jobs),
s AS (SELECT unnest(range(10)) AS pos, unnest(['combine','probe','proxy','rallies','vision','tracking','render','validate','coach','stitch']) AS stage),
k AS (SELECT j.id, j.status, s.pos, s.stage, CASE WHEN cur = 'queued' THEN CASE WHEN status = 'queued' THEN -1 ELSE 0 END ELSE id % 10 END AS c FROM j CROSS JOIN s)
SELECT id, pos, stage, CASE WHEN status = 'done' OR pos < c THEN 'done' WHEN pos = c AND status = 'failed' THEN 'failed' WHEN pos = c AND status = 'processing' THEN 'active' ELSE 'pending' END AS state FROM k""")
def stage_progress(spark, sf):
    names = F.array(*map(F.lit, store.STAGES))
    j = load(spark, sf, "jobs").withColumns({
        "stage": F.when(F.col("status") == "queued", "queued").otherwise(F.get(names, (F.col("id") % 10).cast("int"))),
        "status": F.when((F.col("id") % 11 == 0) & (F.col("status") == "failed"), "processing").otherwise(F.col("status"))})
    return store.stage_progress(j)


def optioned(spark, sf):
    box = "array(array(cast(0.1 as double), 0.2e0), array(0.1e0 + id % 90 / 100e0, 0.2e0), array(0.1e0 + id % 90 / 100e0, 0.2e0 + id % 40 / 100e0), array(0.1e0 - id % 200 / 200e0, 0.2e0 + id % 40 / 100e0))"
    o = f"named_struct('shuttle', upper(case when priority like '1%' then 'TrackNetV3' when priority like '2%' then 'laser' else 'off' end), 'pose', case when id % 3 = 0 then ' YOLO11 ' when id % 3 = 1 then 'Pose' else 'none' end, 'coach', case when id % 4 = 0 then false when id % 4 = 1 then true end, 'court_corners', case when id % 6 > 0 then {box} end)"
    return load(spark, sf, "jobs").selectExpr("id", "priority", f"{o} as options")


@query("normalize_options", "PRJ-2 PRJ-3 PRJ-4", "id:i shuttle:s pose:s coach:b has_corners:b corner_x:d pipeline:s expected_s:i", ctes("jobs") + """,
o AS (SELECT id, CASE WHEN priority LIKE '1%' THEN 'tracknetv3' ELSE 'off' END AS shuttle, CASE WHEN id % 3 < 2 THEN 'yolo11' ELSE 'off' END AS pose, CASE WHEN id % 4 = 0 THEN false ELSE true END AS coach,
  1e-1 + id % 90 / 100e0 AS xr, 1e-1 - id % 200 / 200e0 AS xl, 2e-1 + id % 40 / 100e0 AS yb FROM jobs),
v AS (SELECT *, id % 6 > 0 AND xl >= -0.75 AND round(xr, 4) - least(1e-1, round(xl, 4)) >= 15e-2 AND round(yb, 4) - 2e-1 >= 1e-1 AS ok FROM o)
SELECT id, shuttle, pose, coach, ok AS has_corners, CASE WHEN ok THEN round(xr, 4) END AS corner_x, CASE WHEN shuttle = 'tracknetv3' OR pose = 'yolo11' THEN 'gpu' ELSE 'cpu' END AS pipeline,
  CASE WHEN shuttle = 'tracknetv3' OR pose = 'yolo11' THEN 600 ELSE 1800 END AS expected_s FROM v""".replace("\n  CASE", " CASE"))
def normalize_options(spark, sf):
    d = store.route_pipeline(store.normalize_options(optioned(spark, sf)))
    return d.withColumns({"has_corners": F.col("court_corners").isNotNull(), "corner_x": F.col("court_corners")[1][0]})


@query("membership_of", "JOIN-10", "user_id:i school_id:i role:s school_name:s", ctes("members", "schools") + """,
m AS (SELECT user_id, school_id, role, created_at FROM members UNION ALL SELECT user_id, (school_id + 7) % 25, 'student', created_at + (user_id % 3 - 1) * 30 FROM members)
SELECT m.user_id, m.school_id, m.role, s.name AS school_name FROM m JOIN schools s USING (school_id) QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY m.created_at, m.school_id) = 1""")
def membership_of(spark, sf):
    m = load(spark, sf, "members")
    more = m.selectExpr("user_id", "(school_id + 7) % 25 as school_id", "'student' as role", "created_at + (user_id % 3 - 1) * 30 as created_at")
    return store.membership_of(m.select(*more.columns).union(more), load(spark, sf, "schools"))


@query("roster", "JOIN-11", "user_id:i name:s school_id:i role:s", ctes("members") + """
SELECT user_id, name, school_id, role FROM members WHERE role = 'student'""")
def roster(spark, sf):
    m = load(spark, sf, "members")
    return store.roster(m.drop("name", "bal"), m.select("user_id", "name"), "student")


# Assignments: each line gives its order's session to the customer of another order.
ASSIGN = "assign AS (SELECT DISTINCT l.l_orderkey AS job_id, o.o_custkey AS student_id, cast(l.l_linenumber % 4 AS BIGINT) AS player_id FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_partkey)"


def assign(spark, sf):
    who = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_partkey"), "o_custkey")
    return table(spark, sf, "lineitem").join(who, "l_partkey").selectExpr(
        "l_orderkey as job_id", "o_custkey as student_id", "cast(l_linenumber % 4 as bigint) as player_id").distinct()


@query("student_sessions", "JOIN-12", "student_id:i job_id:i player_id:i created_at:i", ctes("jobs") + f""",
{ASSIGN}
SELECT a.student_id, a.job_id, a.player_id, j.created_at FROM assign a JOIN jobs j USING (job_id) WHERE j.status = 'done'""")
def student_sessions(spark, sf):
    return store.student_sessions(assign(spark, sf), load(spark, sf, "jobs"))


@query("job_assignees", "JOIN-12", "job_id:i student_id:i name:s", ctes("members") + f""",
{ASSIGN}
SELECT a.job_id, a.student_id, m.name FROM assign a JOIN members m ON m.user_id = a.student_id""")
def job_assignees(spark, sf):
    return store.assignees(assign(spark, sf), load(spark, sf, "members"))


@query("live_sessions", "JOIN-13", "token:i user_id:i name:s", ctes("members", "pts") + """
SELECT p.pid AS token, m.user_id, m.name FROM pts p JOIN members m ON m.user_id = p.track_id WHERE p.t + 100 > 500""")
def live_sessions(spark, sf):
    s = load(spark, sf, "pts").selectExpr("pid as token", "track_id as user_id", "t + 100 as expires_at")
    return store.live_sessions(s, load(spark, sf, "members").select("user_id", "name"), 500.0)


@query("purge_sessions", "JOIN-13", "token:i", ctes("pts") + """
SELECT pid AS token FROM pts WHERE t + 100 >= 500""")
def purge_sessions(spark, sf):
    return store.purge_sessions(load(spark, sf, "pts").selectExpr("pid as token", "t + 100 as expires_at"), 500.0)


@query("assignable", "JOIN-14", "job_id:i student_id:i", ctes("jobs", "members") + f""",
{ASSIGN}
SELECT DISTINCT a.job_id, a.student_id FROM assign a JOIN jobs j USING (job_id) WHERE EXISTS (SELECT 1 FROM members m WHERE m.role = 'student' AND m.user_id = a.student_id AND m.school_id = j.school_id)""")
def assignable(spark, sf):
    return store.assignable(assign(spark, sf), load(spark, sf, "jobs"), load(spark, sf, "members")).select("job_id", "student_id").distinct()


@query("resolve_code", "SET-3", "code:s school_id:i role:s", ctes("schools", "members") + """,
codes AS (SELECT DISTINCT ' ' || lower(upper(substr(s.name, 1, 3)) || (m.user_id % 25)) AS code FROM members m JOIN schools s ON s.school_id = m.school_id),
k AS (SELECT student_code AS c, school_id, 'student' AS role, 0 AS p FROM schools UNION ALL SELECT coach_code, school_id, 'coach', 1 FROM schools)
SELECT code, school_id, role FROM codes JOIN k ON upper(trim(code)) = k.c QUALIFY row_number() OVER (PARTITION BY code ORDER BY p, school_id) = 1""")
def resolve_code(spark, sf):
    s = load(spark, sf, "schools")
    codes = load(spark, sf, "members").join(s.select("school_id", F.col("name").alias("n")), "school_id").selectExpr("' ' || lower(upper(substr(n, 1, 3)) || (user_id % 25)) as code").distinct()
    return store.resolve_code(s, codes)


@query("latest_upsert", "WIN-40", "track_id:i kind:s pid:i value:d", ctes("pts") + """
SELECT track_id, kind, pid, value FROM pts QUALIFY row_number() OVER (PARTITION BY track_id, kind ORDER BY t DESC, pid DESC) = 1""")
def latest_upsert(spark, sf):
    return store.latest(load(spark, sf, "pts").select("track_id", "kind", "pid", "t", "value"), ["track_id", "kind"], "t", ["pid"])


STATUS = "status AS (SELECT track_id AS job_id, pid AS event_id, t AS ts, CASE kind WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'queued' WHEN 'logout' THEN 'queued' ELSE 'processing' END AS status FROM pts)"


def statuses(spark, sf):
    return load(spark, sf, "pts").selectExpr(
        "track_id as job_id", "pid as event_id", "t as ts",
        "case kind when 'error' then 'failed' when 'purchase' then 'done' when 'signup' then 'queued' when 'logout' then 'queued' else 'processing' end as status")


@query("job_state", "WIN-40 STR-4", "job_id:i status:s updated_at:d started_at:d finished_at:d", ctes("pts") + f""",
{STATUS},
e AS (SELECT *, sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS ep FROM status),
l AS (SELECT * FROM e QUALIFY ep = max(ep) OVER (PARTITION BY job_id))
SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, min(ts) FILTER (status <> 'queued') AS started_at,
  CASE WHEN arg_max(status, (ts, event_id)) IN ('done', 'failed') THEN max(ts) END AS finished_at FROM l GROUP BY job_id""")
def job_state(spark, sf):
    return store.job_state(statuses(spark, sf))


@query("union_pool", "SET-6", "job_id:i rally_id:i src:s", ctes("rallies") + """
SELECT job_id, rally_id, 'pool' AS src FROM rallies WHERE intensity <= 3 UNION ALL SELECT job_id, rally_id, 'now' FROM rallies WHERE intensity > 3""")
def union_pool(spark, sf):
    r = load(spark, sf, "rallies").select("job_id", "rally_id", "intensity")
    pool = r.filter("intensity <= 3").withColumn("src", F.lit("pool"))
    now = r.filter("intensity > 1").withColumn("src", F.lit("now"))
    now = now.unionByName(r.filter("intensity = 1").withColumn("src", F.lit("now")))
    return store.union_pool(pool, now, ["job_id", "rally_id"])


@query("usage_cost", "AGG-10", "conv_id:i prompt_tokens:i output_tokens:i calls:i cost_micro_usd:d", ctes("texts") + """
SELECT conv_id, sum(CASE WHEN role = 'user' THEN n_chars ELSE 0 END) AS prompt_tokens, sum(CASE WHEN role = 'user' THEN 0 ELSE n_chars END) AS output_tokens, count(*) AS calls,
  1e6 * (sum(CASE WHEN role = 'user' THEN n_chars ELSE 0 END) / 1e6 * 0.30::DOUBLE + sum(CASE WHEN role = 'user' THEN 0 ELSE n_chars END) / 1e6 * 2.50::DOUBLE) AS cost_micro_usd FROM texts GROUP BY 1""")
def usage_cost(spark, sf):
    c = load(spark, sf, "texts").selectExpr("conv_id", "if(role = 'user', n_chars, 0) as prompt_tokens", "if(role = 'user', 0, n_chars) as output_tokens")
    return store.usage_cost(c, key="conv_id").withColumn("cost_micro_usd", F.col("cost_usd") * 1e6)


def session_parts(spark, sf):
    """Rallies and movement of each session: an order's line items."""
    li = table(spark, sf, "lineitem")
    rallies = li.selectExpr("l_orderkey as job_id", "l_linenumber as i", "l_quantity as dur")
    mv = li.groupBy(F.col("l_orderkey").alias("job_id"), F.expr("cast(l_linenumber % 4 as bigint)").alias("player_id")).agg(F.sum(F.col("l_quantity") * 2).alias("distance_m"))
    return rallies, mv


PROFILE = """rl AS (SELECT l_orderkey AS job_id, count(*) AS n_rallies, max(l_quantity) AS longest_rally FROM lineitem GROUP BY 1),
mv AS (SELECT l_orderkey AS job_id, cast(l_linenumber % 4 AS BIGINT) AS player_id, sum(l_quantity * 2) AS distance_m FROM lineitem GROUP BY 1, 2),
prof AS (SELECT a.student_id, a.job_id, a.player_id, j.school_id, j.created_at, coalesce(n_rallies, 0) AS n_rallies, coalesce(longest_rally, 0) AS longest_rally, distance_m
  FROM assign a JOIN jobs j USING (job_id) LEFT JOIN rl USING (job_id) LEFT JOIN mv ON mv.job_id = a.job_id AND mv.player_id = a.player_id WHERE j.status = 'done')"""


def profile(spark, sf):
    rallies, mv = session_parts(spark, sf)
    return store.student_profile(assign(spark, sf), load(spark, sf, "jobs"), rallies, mv)


@query("student_profile", "AGG-11", "student_id:i job_id:i player_id:i created_at:i n_rallies:i longest_rally:d distance_m:d", ctes("jobs") + f""",
{ASSIGN},
{PROFILE}
SELECT * FROM prof""")
def student_profile(spark, sf):
    return profile(spark, sf)


@query("student_totals", "AGG-12", "student_id:i sessions:i total_rallies:i longest_ever:d total_distance:d", ctes("jobs") + f""",
{ASSIGN},
{PROFILE}
SELECT student_id, count(*) AS sessions, sum(n_rallies) AS total_rallies, max(longest_rally) AS longest_ever, sum(distance_m) AS total_distance FROM prof GROUP BY 1""")
def student_totals(spark, sf):
    return store.student_totals(profile(spark, sf))


@query("student_totals_rollup", "AGG-12", "school_id:i student_id:i job_id:i sessions:i total_rallies:i longest_ever:d total_distance:d", ctes("jobs") + f""",
{ASSIGN},
{PROFILE}
SELECT school_id, student_id, job_id, count(*) AS sessions, sum(n_rallies) AS total_rallies, max(longest_rally) AS longest_ever, sum(distance_m) AS total_distance FROM prof GROUP BY ROLLUP (school_id, student_id, job_id)""")
def student_rollup(spark, sf):
    return store.student_totals(profile(spark, sf), rollup=True)


@query("student_trend", "AGG-12", "student_id:i job_id:i player_id:i scaled:d", ctes("jobs") + f""",
{ASSIGN},
{PROFILE},
m AS (SELECT *, min(longest_rally) OVER (PARTITION BY student_id) AS lo, max(longest_rally) OVER (PARTITION BY student_id) AS hi FROM prof)
SELECT student_id, job_id, player_id, CASE WHEN hi > lo THEN (longest_rally - lo) / (hi - lo) ELSE 0 END AS scaled FROM m""")
def student_trend(spark, sf):
    return store.scaled_series(profile(spark, sf), "longest_rally")


@query("school_overview", "AGG-13", "school_id:i job_id:i n_assignees:i student_id:i assignee:s player_id:i", ctes("jobs", "members") + f""",
{ASSIGN},
l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY created_at DESC, job_id) <= 120),
w AS (SELECT a.job_id, a.student_id, a.player_id, m.name, count(*) OVER (PARTITION BY a.job_id) AS n FROM assign a JOIN members m ON m.user_id = a.student_id)
SELECT l.school_id, l.job_id, coalesce(w.n, 0) AS n_assignees, w.student_id, w.name AS assignee, w.player_id FROM l LEFT JOIN w USING (job_id)""")
def school_overview(spark, sf):
    return store.school_overview(load(spark, sf, "jobs"), assign(spark, sf), load(spark, sf, "members"))


@query("visible_codes", "AGG-13", "user_id:i school_id:i student_code:s coach_code:s", ctes("schools", "members") + """
SELECT m.user_id, m.school_id, s.student_code, CASE WHEN m.role = 'admin' THEN s.coach_code END AS coach_code FROM members m JOIN schools s USING (school_id) WHERE m.role IN ('admin', 'coach')""")
def visible_codes(spark, sf):
    return store.visible_codes(load(spark, sf, "schools").drop("name"), load(spark, sf, "members"))


@query("quality_checks", "SRC-5", "check_name:s violations:i", ctes("jobs") + """
SELECT 'known_status' AS check_name, count(*) FILTER (status NOT IN ('queued', 'processing', 'done')) AS violations FROM jobs UNION ALL SELECT 'span_positive', count(*) FILTER (finished_at < started_at) FROM jobs""")
def quality_checks(spark, sf):
    d = store.quality_checks(load(spark, sf, "jobs"), {"known_status": F.col("status").isin("queued", "processing", "done"), "span_positive": F.col("finished_at") >= F.col("started_at")})
    return d.withColumnRenamed("check", "check_name")


@query("admission_throttle", "STR-3", "client:i req_id:i admitted:b", "WITH RECURSIVE" + ctes("pts")[4:] + """,
r AS (SELECT track_id AS client, pid AS req_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t, pid) AS rn FROM pts),
w AS (SELECT client, 0::BIGINT AS rn, NULL::BIGINT AS req_id, []::DOUBLE[] AS hits, false AS ok FROM (SELECT DISTINCT client FROM r)
  UNION ALL SELECT client, rn, req_id, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM
    (SELECT r.client, r.rn, r.req_id, r.t, list_filter(w.hits, lambda h: r.t - h < 60) AS live FROM w JOIN r ON r.client = w.client AND r.rn = w.rn + 1))
SELECT client, req_id, ok AS admitted FROM w WHERE req_id IS NOT NULL""")
def throttle(spark, sf):
    return store.admit(load(spark, sf, "pts").selectExpr("track_id as client", "pid as req_id", "t"), 3, 60.0)


# Chunks arrive almost in order: each upload's points numbered, some numbers repeated or jumped.
CHUNKS = """ck0 AS (SELECT track_id AS upload_id, pid AS arrival, row_number() OVER (PARTITION BY track_id ORDER BY pid) - 1 AS rn FROM pts),
ck AS (SELECT upload_id, arrival, CASE WHEN arrival % 9 = 4 THEN rn - 1 - rn // 9 WHEN arrival % 13 = 5 THEN rn + 2 ELSE rn - rn // 9 END AS chunk_no FROM ck0)"""


def chunks(spark, sf):
    from ..operators.tiles import row_index

    d = row_index(load(spark, sf, "pts").selectExpr("track_id as upload_id", "pid as arrival", "t"), ["upload_id"], "arrival", out="rn", tile=F.floor(F.col("arrival") / 100000))
    return d.selectExpr("upload_id", "arrival", "t", "case when arrival % 9 = 4 then rn - 1 - rn div 9 when arrival % 13 = 5 then rn + 2 else rn - rn div 9 end as chunk_no")


@query("chunk_ingest", "STR-5", "upload_id:i arrival:i chunk_no:i verdict:s", "WITH RECURSIVE" + ctes("pts")[4:] + f""",
{CHUNKS},
o AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY arrival) AS rn FROM ck),
w AS (SELECT upload_id, 0::BIGINT AS rn, NULL::BIGINT AS arrival, NULL::BIGINT AS chunk_no, 0::BIGINT AS done, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT upload_id FROM o)
  UNION ALL SELECT o.upload_id, o.rn, o.arrival, o.chunk_no, CASE WHEN o.chunk_no = w.done THEN w.done + 1 ELSE w.done END,
    CASE WHEN o.chunk_no = w.done - 1 THEN 'duplicate' WHEN o.chunk_no = w.done THEN 'accepted' ELSE 'gap' END FROM w JOIN o ON o.upload_id = w.upload_id AND o.rn = w.rn + 1)
SELECT upload_id, arrival, chunk_no, verdict FROM w WHERE arrival IS NOT NULL""")
def chunk_ingest(spark, sf):
    return store.ordered_chunks(chunks(spark, sf))


RUNS = "runs AS (SELECT track_id AS run_id, pid AS event_id, t, CASE WHEN value < 25 THEN 'IN_QUEUE' WHEN value < 150 THEN 'RUNNING' WHEN value < 200 THEN 'COMPLETED' ELSE 'FAILED' END AS state, pid % 3 AS active_workers FROM pts)"


def runs(spark, sf):
    return load(spark, sf, "pts").selectExpr("track_id as run_id", "pid as event_id", "t", "case when value < 25 then 'IN_QUEUE' when value < 150 then 'RUNNING' when value < 200 then 'COMPLETED' else 'FAILED' end as state",
                                             "pid % 3 as active_workers")


@query("budget_monitor", "STR-6", "run_id:i verdict:s t:d", ctes("pts") + f""",
{RUNS},
g AS (SELECT *, t - min(t) OVER (PARTITION BY run_id) AS waited, t - min(CASE WHEN state = 'RUNNING' THEN t END) OVER (PARTITION BY run_id) AS ran FROM runs),
v AS (SELECT *, CASE WHEN state = 'COMPLETED' THEN 'completed' WHEN state = 'FAILED' THEN 'failed' WHEN state = 'IN_QUEUE' AND waited > 15 AND active_workers = 0 THEN 'no_workers'
  WHEN state = 'IN_QUEUE' AND waited > 90 THEN 'queue_timeout' WHEN state = 'RUNNING' AND ran > 60 THEN 'run_timeout' END AS verdict FROM g)
SELECT run_id, coalesce(arg_min(verdict, (t, event_id)) FILTER (verdict IS NOT NULL), 'open') AS verdict, coalesce(arg_min(t, (t, event_id)) FILTER (verdict IS NOT NULL), max(t)) AS t FROM v GROUP BY run_id""")
def budget_monitor(spark, sf):
    return store.budget_monitor(runs(spark, sf), 15.0, 90.0, 60.0)


@query("expire_uploads", "STR-7", "upload_id:i last_t:d expired:b", ctes("pts") + """
SELECT track_id AS upload_id, max(t) AS last_t, max(t) < 719e0 - 5 AS expired FROM pts GROUP BY 1""")
def expire_uploads(spark, sf):
    return store.expire_uploads(load(spark, sf, "pts").selectExpr("track_id as upload_id", "t"), 719.0, 5.0 / 3600.0)
