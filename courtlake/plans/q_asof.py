"""Time joins over tracks."""
from pyspark.sql import functions as F

from ..operators import asof
from ..operators.camera import map_time, reel_offsets, slice_keyframes
from .adapters import ctes, load
from .registry import query

# Probe times: the good peaks of a user's track seen from another clock, 0.35 s off the point itself.
PROBE = "probes AS (SELECT track_id, pid AS probe_id, t + ((pid * 13) % 21 - 10) / 1e1 AS t FROM pts)"
GOOD = "good AS (SELECT * FROM pts WHERE confidence >= 0.3)"


def probes(spark, sf):
    return load(spark, sf, "pts").selectExpr("track_id", "pid as probe_id", "t + ((pid * 13) % 21 - 10) / 1e1 as t")


def good(spark, sf):
    return load(spark, sf, "pts").filter("confidence >= 0.3")


@query("nearest_time", "JOIN-2", "track_id:i probe_id:i r_pid:i dt:d", ctes("pts") + f""",
{PROBE},
{GOOD},
c AS (SELECT p.track_id, p.probe_id, g.pid, abs(g.t - p.t) AS dt, row_number() OVER (PARTITION BY p.track_id, p.probe_id ORDER BY abs(g.t - p.t), g.t, g.pid) AS rn
      FROM probes p JOIN good g ON g.track_id = p.track_id AND g.t BETWEEN p.t - 9 AND p.t + 9)
SELECT p.track_id, p.probe_id, c.pid AS r_pid, c.dt FROM probes p LEFT JOIN c ON c.track_id = p.track_id AND c.probe_id = p.probe_id AND c.rn = 1 AND c.dt <= 8""")
def nearest_time(spark, sf):
    g = good(spark, sf).select("track_id", "t", "pid")
    return asof.nearest_time(probes(spark, sf), g, ["track_id"], 8.0, order=["pid"])


@query("nearest_time_last", "JOIN-2", "track_id:i probe_id:i r_t:d", ctes("pts") + f""",
s AS (SELECT DISTINCT track_id, floor(t) AS t FROM pts),
p AS (SELECT track_id, pid AS probe_id, floor(t) + 0.5 + (pid % 3) AS t FROM pts),
c AS (SELECT p.track_id, p.probe_id, s.t, row_number() OVER (PARTITION BY p.track_id, p.probe_id ORDER BY abs(s.t - p.t), s.t DESC) AS rn
      FROM p JOIN s ON s.track_id = p.track_id AND abs(s.t - p.t) <= 4)
SELECT p.track_id, p.probe_id, c.t AS r_t FROM p LEFT JOIN c ON c.track_id = p.track_id AND c.probe_id = p.probe_id AND rn = 1""")
def nearest_time_last(spark, sf):
    p = load(spark, sf, "pts")
    s = p.selectExpr("track_id", "cast(floor(t) as double) as t").distinct()
    left = p.selectExpr("track_id", "pid as probe_id", "floor(t) + 0.5e0 + (pid % 3) as t")
    return asof.nearest_time(left, s, ["track_id"], 4.0, tie="last")


@query("interpolate_asof", "JOIN-3", "track_id:i probe_id:i x:d y:d", ctes("pts") + f""",
{PROBE},
{GOOD},
u AS (SELECT track_id, t, 1 AS side, NULL AS probe_id, pid, x, y FROM good UNION ALL SELECT track_id, t, 0, probe_id, NULL, NULL, NULL FROM probes),
b AS (SELECT *, last_value(CASE WHEN side = 1 THEN t END IGNORE NULLS) OVER w AS ta, last_value(x IGNORE NULLS) OVER w AS xa, last_value(y IGNORE NULLS) OVER w AS ya,
        first_value(CASE WHEN side = 1 THEN t END IGNORE NULLS) OVER v AS tb, first_value(x IGNORE NULLS) OVER v AS xb, first_value(y IGNORE NULLS) OVER v AS yb FROM u
      WINDOW w AS (PARTITION BY track_id ORDER BY t, side, pid ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY track_id ORDER BY t, side, pid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, (t - ta) / (tb - ta) AS w FROM b WHERE side = 0)
SELECT track_id, probe_id, CASE WHEN tb - ta <= 20 THEN xa * (1 - w) + xb * w WHEN t - ta <= 3 THEN xa WHEN tb - t <= 3 THEN xb END AS x,
  CASE WHEN tb - ta <= 20 THEN ya * (1 - w) + yb * w WHEN t - ta <= 3 THEN ya WHEN tb - t <= 3 THEN yb END AS y FROM g""")
def interpolate_asof(spark, sf):
    return asof.interpolate_asof(probes(spark, sf), good(spark, sf).select("track_id", "t", "pid", "x", "y"), ["track_id"], ["x", "y"], 20.0, 3.0, order=["pid"])


# People frames: three events in a row are a frame, of ids 0 to 2 or 1 to 3 in turn, a thousand frames a job; longer pauses after every seventh.
FRAMES = """frames AS (SELECT pid // 3000 AS job_id, cast(pid // 3 % 1000 * 4 + pid // 3 % 1000 // 7 * 12 AS DOUBLE) AS t, pid % 3 + pid // 3 % 2 AS id, x, y, confidence,
  cast(floor(value / 40) AS BIGINT) AS seg FROM pts)"""


def frames(spark, sf):
    return load(spark, sf, "pts").selectExpr("pid div 3000 as job_id", "cast(pid div 3 % 1000 * 4 + pid div 3 % 1000 div 7 * 12 as double) as t", "pid % 3 + pid div 3 % 2 as id",
                                             "x", "y", "confidence", "cast(floor(value / 40) as bigint) as seg")


def _by_id_sql(seg: bool) -> str:
    same = "a.seg = b.seg" if seg else "true"
    return ctes("pts") + f""",
{FRAMES},
ts AS (SELECT DISTINCT job_id, t FROM frames),
grid AS (SELECT job_id, t + 12718281e-7 AS t FROM ts UNION SELECT job_id, t - 51828e-5 FROM ts UNION SELECT job_id, t FROM ts),
b AS (SELECT g.job_id, g.t, (SELECT max(t) FROM ts WHERE ts.job_id = g.job_id AND ts.t <= g.t) AS lo, (SELECT min(t) FROM ts WHERE ts.job_id = g.job_id AND ts.t > g.t) AS hi,
        (SELECT min(t) FROM ts WHERE ts.job_id = g.job_id) AS first_t FROM grid g),
c AS (SELECT job_id, t, coalesce(lo, hi) AS ta, CASE WHEN t <= first_t THEN coalesce(lo, hi) ELSE coalesce(hi, lo) END AS tb FROM b),
near AS (SELECT *, CASE WHEN abs(ta - t) <= abs(tb - t) THEN ta ELSE tb END AS tn FROM c WHERE NOT (tb > ta AND tb - ta <= 8)),
held AS (SELECT n.job_id, n.t, f.id, f.x, f.y, f.confidence FROM near n JOIN frames f ON f.job_id = n.job_id AND f.t = n.tn WHERE abs(n.tn - n.t) <= 3),
pr AS (SELECT * FROM c WHERE tb > ta AND tb - ta <= 8),
m AS (SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.gt, b.gt) AS t, coalesce(a.id, b.id) AS id, coalesce(a.ta, b.ta) AS ta, coalesce(a.tb, b.tb) AS tb,
        a.id IS NOT NULL AS ha, b.id IS NOT NULL AS hb, a.x AS ax, a.y AS ay, a.confidence AS ac, b.x AS bx, b.y AS by_, b.confidence AS bc, {same} AS same
      FROM (SELECT p.t AS gt, p.ta, p.tb, f.* FROM pr p JOIN frames f ON f.job_id = p.job_id AND f.t = p.ta) a
      FULL JOIN (SELECT p.t AS gt, p.ta, p.tb, f.* FROM pr p JOIN frames f ON f.job_id = p.job_id AND f.t = p.tb) b ON a.job_id = b.job_id AND a.gt = b.gt AND a.id = b.id),
o AS (SELECT job_id, t, id, ax + (bx - ax) * ((t - ta) / (tb - ta)) AS x, ay + (by_ - ay) * ((t - ta) / (tb - ta)) AS y, least(ac, bc) AS confidence FROM m WHERE ha AND hb AND same
  UNION ALL SELECT job_id, t, id, ax, ay, ac FROM m WHERE ha AND NOT (ha AND hb AND same) AND t - ta <= 1.3 AND t - ta <= (tb - ta) / 2
  UNION ALL SELECT job_id, t, id, bx, by_, bc FROM m WHERE hb AND NOT (ha AND hb AND same) AND tb - t <= 1.3 AND tb - t < (tb - ta) / 2)
SELECT * FROM o UNION ALL SELECT * FROM held"""


def _grid(fr):
    ts = fr.select("job_id", "t").distinct()
    return ts.selectExpr("job_id", "explode(array(t + 12718281e-7, t - 51828e-5, t)) as t")


@query("interpolate_boxes_by_id", "JOIN-4", "job_id:i t:d id:i x:d y:d confidence:d", _by_id_sql(False))
def interpolate_boxes(spark, sf):
    fr = frames(spark, sf)
    return asof.interpolate_by_id(_grid(fr), fr, ["job_id"], ["x", "y"], max_gap=8, hold=1.3, window=3)


@query("interpolate_poses_by_id", "JOIN-4", "job_id:i t:d id:i x:d y:d confidence:d", _by_id_sql(True))
def interpolate_poses(spark, sf):
    fr = frames(spark, sf)
    return asof.interpolate_by_id(_grid(fr), fr, ["job_id"], ["x", "y"], max_gap=8, hold=1.3, window=3, seg="seg")


# Predictions: every labelled point seen a little early or late and a little off, some twice.
PRED = """pred AS (SELECT job_id, track_id, pid AS id, t + ((pid * 7) % 11 - 5) / 2e0 AS t, x + ((pid * 3) % 7 - 3) / 2e2 AS x, y, confidence FROM pts),
gt AS (SELECT job_id, track_id, pid AS id, t, x, y, visible FROM pts)"""


def pred_and_gt(spark, sf):
    p = load(spark, sf, "pts")
    pred = p.selectExpr("job_id", "track_id", "pid as id", "t + ((pid * 7) % 11 - 5) / 2e0 as t", "x + ((pid * 3) % 7 - 3) / 2e2 as x", "y", "confidence")
    return pred, p.selectExpr("job_id", "track_id", "pid as id", "t", "x", "y", "visible")


def greedy_sql(gt_filter: str = "true", tol: str = "2e0") -> str:
    return "WITH RECURSIVE" + ctes("pts")[4:] + f""",
{PRED},
g AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, id) AS gn FROM gt WHERE {gt_filter}),
w AS (SELECT track_id, 0::BIGINT AS gn, []::BIGINT[] AS used, NULL::BIGINT AS gt_id, NULL::BIGINT AS pred_id, NULL::DOUBLE AS dt FROM (SELECT DISTINCT track_id FROM g)
  UNION ALL SELECT w.track_id, g.gn, CASE WHEN m.id IS NULL THEN w.used ELSE list_append(w.used, m.id) END, g.id, m.id, m.dt
    FROM w JOIN g ON g.track_id = w.track_id AND g.gn = w.gn + 1
    LEFT JOIN LATERAL (SELECT p.id, abs(p.t - g.t) AS dt FROM pred p WHERE p.track_id = g.track_id AND abs(p.t - g.t) <= {tol} AND NOT list_contains(w.used, p.id)
      ORDER BY abs(p.t - g.t), p.t DESC, p.id DESC LIMIT 1) m ON true),
greedy AS (SELECT track_id, gt_id, pred_id, dt FROM w WHERE pred_id IS NOT NULL)"""


@query("greedy_match", "JOIN-6", "track_id:i gt_id:i pred_id:i dt:d", greedy_sql() + """
SELECT track_id, gt_id, pred_id, dt FROM greedy""")
def greedy_match(spark, sf):
    pred, gt = pred_and_gt(spark, sf)
    return asof.greedy_match(pred, gt, ["track_id"], 2.0)


@query("fill_unseen", "WIN-29", "rally_index:i pid:i x:d", ctes("dense") + """,
s AS (SELECT *, CASE WHEN confidence >= 0.4 THEN x END AS sx FROM dense)
SELECT rally_index, pid, coalesce(sx, (coalesce(last_value(sx IGNORE NULLS) OVER (PARTITION BY rally_index ORDER BY t, pid ROWS UNBOUNDED PRECEDING), 0.5)
  + coalesce(first_value(sx IGNORE NULLS) OVER (PARTITION BY rally_index ORDER BY t, pid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.5)) / 2) AS x FROM s""")
def fill_unseen(spark, sf):
    d = load(spark, sf, "dense").withColumn("x", F.when(F.col("confidence") >= 0.4, F.col("x")))
    return asof.fill_unseen(d, ["rally_index"], "t", ["x"], {"x": 0.5}, tie=["pid"])


SHOTS = "shots AS (SELECT job_id, shot_id, min(t) AS t0, max(t) AS t1, shot_id % 2 = 0 AS mirrored FROM samples GROUP BY 1, 2)"
ONE = "one AS (SELECT job_id, shot_id, t, arg_min(x, (k, pkey, residual_px)) AS x, arg_min(y, (k, pkey, residual_px)) AS y, arg_min(z, (k, pkey, residual_px)) AS z FROM samples GROUP BY 1, 2, 3)"


def one_sample_per_time(spark, sf, rows=None):
    s = load(spark, sf, "samples", rows)
    return s.groupBy("job_id", "shot_id", "t").agg(*[F.min_by(c, F.struct("k", "pkey", "residual_px")).alias(c) for c in "xyz"])


@query("shot_position_at", "JOIN-20", "job_id:i t:d shot_id:i x:d y:d z:d", ctes("samples") + f""",
{SHOTS},
{ONE},
grid AS (SELECT DISTINCT job_id, t + 0.02 AS t FROM samples),
f AS (SELECT g.job_id, g.t, arg_min(s.shot_id, (s.t0, s.shot_id)) AS shot_id FROM grid g JOIN shots s ON s.job_id = g.job_id AND g.t BETWEEN s.t0 - 5e-2 AND s.t1 + 5e-2 GROUP BY 1, 2),
b AS (SELECT f.*, s.mirrored, (SELECT max(t) FROM one o WHERE o.job_id = f.job_id AND o.shot_id = f.shot_id AND o.t <= f.t) AS lo,
        (SELECT min(t) FROM one o WHERE o.job_id = f.job_id AND o.shot_id = f.shot_id AND o.t > f.t) AS hi FROM f JOIN shots s ON s.job_id = f.job_id AND s.shot_id = f.shot_id),
c AS (SELECT *, coalesce(lo, hi) AS ta, coalesce(hi, lo) AS tb FROM b),
k AS (SELECT c.*, CASE WHEN tb > ta THEN greatest(0, least(1, (t - ta) / (tb - ta))) ELSE 0 END AS w FROM c),
r AS (SELECT k.job_id, k.t, k.shot_id, k.mirrored, a.x + (b.x - a.x) * w AS x, a.y + (b.y - a.y) * w AS y, a.z + (b.z - a.z) * w AS z FROM k
      JOIN one a ON a.job_id = k.job_id AND a.shot_id = k.shot_id AND a.t = k.ta JOIN one b ON b.job_id = k.job_id AND b.shot_id = k.shot_id AND b.t = k.tb)
SELECT job_id, t, shot_id, CASE WHEN mirrored THEN 6.1::DOUBLE - x ELSE x END AS x, y, z FROM r""")
def shot_position_at(spark, sf):
    s = load(spark, sf, "samples")
    shots = s.groupBy("job_id", "shot_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("mirrored", F.expr("shot_id % 2 = 0"))
    grid = s.selectExpr("job_id", "t + 0.02e0 as t").distinct()
    return asof.shot_position_at(grid, shots, one_sample_per_time(spark, sf))


@query("nearest_center", "JOIN-7", "job_id:i frame_no:i gt_id:i pid:i dist:d", ctes("boxes") + """,
b AS (SELECT job_id, frame_no, okey * 8 + track_id AS id, min((x1 + x2) / 2) AS x, min((y1 + y2) / 2) AS y FROM boxes GROUP BY 1, 2, 3),
p AS (SELECT job_id, frame_no, id, x + ((id * 5) % 97 - 48) / 1e3 + (id % 1009) / 1e6 AS x, y FROM b),
c AS (SELECT g.job_id, g.frame_no, g.id AS gt_id, p.id AS pid, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS dist FROM b g JOIN p ON p.job_id = g.job_id AND p.frame_no = g.frame_no)
SELECT job_id, frame_no, gt_id, arg_min(pid, (round(dist, 9), -pid)) AS pid, min(dist) AS dist FROM c WHERE dist <= 12e-2 GROUP BY 1, 2, 3""")
def nearest_center(spark, sf):
    b = load(spark, sf, "boxes").selectExpr("job_id", "frame_no", "okey * 8 + track_id as id", "(x1 + x2) / 2 as x", "(y1 + y2) / 2 as y")
    b = b.groupBy("job_id", "frame_no", "id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    p = b.withColumn("x", F.expr("x + ((id * 5) % 97 - 48) / 1e3 + (id % 1009) / 1e6"))
    return asof.nearest_center(p, b.withColumnRenamed("id", "gt_id"), ["job_id", "frame_no"], 0.12).withColumn("pid", F.col("p.id"))


# Clips: each job's rallies in order, played in source time.
CLIPS = """cl0 AS (SELECT job_id, rally_id, row_number() OVER (PARTITION BY job_id ORDER BY start_s, rally_id) - 1 AS pos, dur AS clip_dur, greatest(0, start_s - 1) AS source_start FROM rallies),
clips AS (SELECT *, greatest(0, acc - clip_dur - pos * 45e-2) AS t0_reel, greatest(0, acc - clip_dur - pos * 45e-2) + clip_dur AS t1_reel,
    CASE WHEN nx IS NOT NULL THEN acc - (pos + 1) * 45e-2 + 45e-2 / 2 END AS cut FROM
    (SELECT *, sum(clip_dur) OVER w AS acc, lead(pos) OVER w AS nx FROM cl0 WINDOW w AS (PARTITION BY job_id ORDER BY pos)))"""


def clips(spark, sf):
    from ..operators.tiles import row_index

    r = row_index(load(spark, sf, "rallies"), ["job_id"], "start_s", tie=["rally_id"], out="pos")
    r = r.selectExpr("job_id", "rally_id", "pos", "dur as clip_dur", "greatest(0e0, start_s - 1) as source_start")
    return reel_offsets(r)


@query("reel_offsets", "WIN-22", "job_id:i pos:i t0_reel:d t1_reel:d cut:d", ctes("rallies") + f""",
{CLIPS}
SELECT job_id, pos, t0_reel, t1_reel, cut FROM clips""")
def offsets(spark, sf):
    return clips(spark, sf)


MARKS = "marks AS (SELECT job_id, peak_id AS pid, t, t / 20 AS tr FROM peaks)"


@query("map_reel_to_source", "JOIN-17", "job_id:i pid:i t_mapped:d", ctes("rallies", "peaks") + f""",
{CLIPS},
{MARKS},
i AS (SELECT m.job_id, m.pid, arg_min(source_start + m.tr - t0_reel, pos) AS v FROM marks m JOIN clips c ON c.job_id = m.job_id AND m.tr BETWEEN t0_reel AND t1_reel GROUP BY 1, 2),
l AS (SELECT m.job_id, m.pid, arg_max(source_start + greatest(0, least(m.tr, t1_reel) - t0_reel), pos) FILTER (t0_reel <= m.tr) AS v, arg_min(source_start, pos) AS v0 FROM marks m JOIN clips c USING (job_id) GROUP BY 1, 2)
SELECT m.job_id, m.pid, coalesce(i.v, l.v, l.v0) AS t_mapped FROM marks m LEFT JOIN i USING (job_id, pid) LEFT JOIN l USING (job_id, pid) WHERE m.job_id IN (SELECT job_id FROM clips)""")
def map_reel(spark, sf):
    c = clips(spark, sf)
    m = load(spark, sf, "peaks").selectExpr("job_id", "peak_id as pid", "t / 20 as t").join(c.select("job_id").distinct(), "job_id", "left_semi")
    return map_time(m, c, "reel")


@query("map_source_to_reel", "JOIN-17", "job_id:i pid:i t_mapped:d", ctes("rallies", "peaks") + f""",
{CLIPS},
{MARKS},
i AS (SELECT m.job_id, m.pid, arg_min(t0_reel + m.t - source_start, pos) AS v FROM marks m JOIN clips c ON c.job_id = m.job_id AND m.t BETWEEN source_start AND source_start + (t1_reel - t0_reel) GROUP BY 1, 2),
n AS (SELECT m.job_id, m.pid, arg_min(t0_reel, (source_start, pos)) AS v FROM marks m JOIN clips c ON c.job_id = m.job_id AND source_start > m.t GROUP BY 1, 2)
SELECT m.job_id, m.pid, coalesce(i.v, n.v, 0) AS t_mapped FROM marks m LEFT JOIN i USING (job_id, pid) LEFT JOIN n USING (job_id, pid)""")
def map_source(spark, sf):
    m = load(spark, sf, "peaks").selectExpr("job_id", "peak_id as pid", "t")
    return map_time(m, clips(spark, sf), "source")


@query("slice_keyframes", "JOIN-18", "job_id:i pos:i t:d kf_id:i zoom:d", ctes("rallies", "peaks") + f""",
{CLIPS},
kf AS (SELECT job_id, t / 20 AS t, peak_id AS kf_id, 1 + prominence_db / 10 AS zoom FROM peaks),
s AS (SELECT c.job_id, c.pos, c.source_start AS t, coalesce(arg_max(kf_id, (k.t, kf_id)) FILTER (k.t <= t0_reel), arg_min(kf_id, (k.t, kf_id))) AS kf_id FROM clips c JOIN kf k ON k.job_id = c.job_id GROUP BY 1, 2, 3)
SELECT s.job_id, s.pos, s.t, s.kf_id, kf.zoom FROM s JOIN kf ON kf.job_id = s.job_id AND kf.kf_id = s.kf_id
UNION ALL SELECT c.job_id, c.pos, c.source_start + k.t - t0_reel, k.kf_id, k.zoom FROM clips c JOIN kf k ON k.job_id = c.job_id AND k.t > t0_reel AND k.t < t1_reel""".replace("\nUNION ALL", " UNION ALL"))
def keyframes(spark, sf):
    kf = load(spark, sf, "peaks").selectExpr("job_id", "t / 20 as t", "peak_id as kf_id", "'point' as target", "1 + prominence_db / 10 as zoom")
    return slice_keyframes(clips(spark, sf), kf)
