"""Queries over boxes, people and their identities."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_area
from ..operators import cleaning, identity, thinning
from ..operators.tiles import by_size
from ..session import cut_lineage
from .adapters import court_quads, ctes, load, table
from .registry import query
from .shapes import DETS, dets, inside_sql, people
from .shapes import PEOPLE, PLAYERS, players

K = ["job_id"]


@query("top_per_frame", "SRT-3", "job_id:i frame_no:i det_id:i", ctes("boxes") + f""",
{DETS}
SELECT job_id, frame_no, det_id FROM dets QUALIFY row_number() OVER (PARTITION BY job_id, frame_no ORDER BY confidence DESC, (x2 - x1) * (y2 - y1) DESC, det_id) <= 2""")
def top_per_frame(spark, sf):
    return identity.top_per_frame(dets(spark, sf), 2, ["job_id", "frame_no"], ["det_id"], area=box_area("x1", "y1", "x2", "y2"))


@query("court_player_gate", "PRJ-18 FN-3", "job_id:i frame_no:i det_id:i", ctes("boxes", "courts") + f""",
{DETS},
i AS (SELECT d.*, c.ax IS NULL AS nocourt, {inside_sql('13e-1', '35e-3', '((x1+x2)/2)', 'y2')} AS ins FROM (SELECT *, x1 AS xx FROM dets) d LEFT JOIN (SELECT * FROM courts WHERE job_id % 9 > 0) c USING (job_id)),
s AS (SELECT *, avg(CASE WHEN ins THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY job_id, track_id) AS share FROM i)
SELECT job_id, frame_no, det_id FROM s WHERE nocourt OR share < 35e-2 UNION ALL SELECT job_id, frame_no, det_id FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, track_id, frame_no ORDER BY confidence DESC, det_id) AS rn FROM s WHERE NOT nocourt AND share >= 35e-2 AND ins)""")
def court_player_gate(spark, sf):
    c = court_quads(spark, sf).filter("job_id % 9 > 0")
    return identity.court_player_gate(dets(spark, sf), c, ["job_id", "track_id"], tie=["det_id"])


@query("court_pose_gate", "PRJ-18", "job_id:i row_id:i", ctes("courts") + f""",
{PEOPLE},
f AS (SELECT *, CASE WHEN kps[16].confidence >= 8e-2 AND kps[17].confidence >= 8e-2 THEN (kps[16].x + kps[17].x) / 2 WHEN kps[16].confidence >= 8e-2 THEN kps[16].x WHEN kps[17].confidence >= 8e-2 THEN kps[17].x END AS fx,
  CASE WHEN kps[16].confidence >= 8e-2 AND kps[17].confidence >= 8e-2 THEN (kps[16].y + kps[17].y) / 2 WHEN kps[16].confidence >= 8e-2 THEN kps[16].y WHEN kps[17].confidence >= 8e-2 THEN kps[17].y END AS fy FROM people),
i AS (SELECT f.*, c.ax IS NULL AS nocourt, coalesce({inside_sql('13e-1', '35e-3', 'fx', 'fy')}, false) AS ins FROM f LEFT JOIN courts c USING (job_id)),
s AS (SELECT *, avg(CASE WHEN ins THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY job_id) AS share FROM i)
SELECT job_id, row_id FROM s WHERE nocourt OR share < 35e-2 OR ins""")
def court_pose_gate(spark, sf):
    a, b = F.get("keypoints", F.lit(15)), F.get("keypoints", F.lit(16))
    oka, okb = a["confidence"] >= 0.08, b["confidence"] >= 0.08
    foot = tuple(F.when(oka & okb, (a[c] + b[c]) / 2).when(oka, a[c]).when(okb, b[c]) for c in "xy")
    p = people(spark, sf).withColumn("confidence", F.lit(1.0))
    return identity.court_player_gate(p, court_quads(spark, sf), ["job_id"], foot=foot)


@query("court_frame_gate", "PRJ-18", "job_id:i frame_no:i det_id:i", ctes("boxes", "courts") + f""",
{DETS},
i AS (SELECT d.*, {inside_sql('122e-2', '0e0', '((x1+x2)/2)', 'y2')} AS ins FROM dets d JOIN courts c USING (job_id))
SELECT job_id, frame_no, det_id FROM (SELECT *, bool_or(ins) OVER (PARTITION BY job_id, frame_no) AS any_in FROM i) WHERE ins OR NOT any_in""")
def court_frame_gate(spark, sf):
    return identity.court_frame_gate(dets(spark, sf), court_quads(spark, sf), ["job_id", "frame_no"])


@query("wrist_gate", "PRJ-19", "job_id:i frame_no:i det_id:i", ctes("boxes") + f""",
{DETS},
{PEOPLE},
w AS (SELECT job_id, frame_no, kps[i].x AS wx, kps[i].y AS wy FROM people, (SELECT unnest([10, 11]) AS i) WHERE kps[i].confidence >= 25e-2)
SELECT job_id, frame_no, det_id FROM dets d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.job_id = d.job_id AND w.frame_no = d.frame_no)
  OR EXISTS (SELECT 1 FROM w WHERE w.job_id = d.job_id AND w.frame_no = d.frame_no AND sqrt((wx - (x1+x2)/2) * (wx - (x1+x2)/2) + (wy - (y1+y2)/2) * (wy - (y1+y2)/2)) <= 14e-2)""")
def wrist_gate(spark, sf):
    w = people(spark, sf).select("job_id", "frame_no", F.explode(F.array(F.get("keypoints", F.lit(9)), F.get("keypoints", F.lit(10)))).alias("k")).select("job_id", "frame_no", "k.*")
    return cleaning.wrist_gate(dets(spark, sf), w, ["job_id", "frame_no"])


@query("track_persistence", "AGG-7 SRT-6", "job_id:i track_id:i frames:i rn:i", ctes("boxes") + f""",
{DETS}
SELECT * FROM (SELECT job_id, track_id, count(*) AS frames, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, track_id) AS rn FROM dets GROUP BY 1, 2) WHERE rn <= 3""")
def track_persistence(spark, sf):
    return identity.top_ids(identity.track_persistence(dets(spark, sf), K), K, 3)


@query("keep_ids", "JOIN-14 SET-5", "job_id:i det_id:i", ctes("boxes") + f""",
{DETS},
a AS (SELECT DISTINCT job_id, track_id FROM dets WHERE confidence > 0.5 INTERSECT SELECT DISTINCT job_id, track_id FROM dets WHERE x1 < 0.5),
b AS (SELECT * FROM a EXCEPT SELECT job_id, track_id FROM dets WHERE track_id > 5 AND y1 > 0.5)
SELECT job_id, det_id FROM dets WHERE (job_id, track_id) IN (SELECT job_id, track_id FROM b)""")
def keep_ids(spark, sf):
    d = dets(spark, sf)
    ids = d.select("job_id", "track_id")
    a = identity.intersect_ids(ids.filter(d.confidence > 0.5), ids.filter(d.x1 < 0.5))
    b = identity.except_ids(a, ids.filter((d.track_id > 5) & (d.y1 > 0.5)))
    return identity.keep_ids(d, b, ["job_id", "track_id"])


@query("unassigned_rallies", "JOIN-15", "job_id:i rally_id:i", ctes("rallies", "peaks") + """
SELECT job_id, rally_id FROM rallies r WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE p.job_id = r.job_id AND p.prominence_db > 16)""")
def unassigned(spark, sf):
    return identity.without(load(spark, sf, "rallies"), load(spark, sf, "peaks").filter("prominence_db > 16"), "job_id")


@query("argmax_frame", "SRT-5", "job_id:i frame_no:i n:i", ctes("boxes") + f""",
{DETS}
SELECT job_id, frame_no, count(*) AS n FROM dets GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, frame_no) = 1""")
def argmax_frame(spark, sf):
    n = dets(spark, sf).groupBy("job_id", "frame_no").agg(F.count("*").alias("n"))
    return identity.argmax_row(n, K, ["n"], ["frame_no"])


@query("accept_worker_ids", "WIN-19", "job_id:i total:i with_id:i steps:i bad:i accepted:b", ctes("boxes") + f""",
{DETS},
d AS (SELECT job_id, frame_no, t, det_id, CASE WHEN track_id <> 4 THEN track_id END AS track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM dets),
s AS (SELECT job_id, greatest(t - lag(t) OVER w, 1e-3) AS dt, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM d WHERE track_id IS NOT NULL WINDOW w AS (PARTITION BY job_id, track_id ORDER BY t, det_id)),
g AS (SELECT job_id, count(dx) AS steps, count(*) FILTER (sqrt(dx*dx+dy*dy) > least(6e-1, 22e-2 + 28e-2 * greatest(0, dt - 25e-2))) AS bad FROM s GROUP BY 1),
c AS (SELECT job_id, count(*) AS total, count(track_id) AS with_id FROM d GROUP BY 1)
SELECT job_id, total, with_id, steps, bad, with_id / total >= 6e-1 AND (steps < 10 OR bad / steps <= 15e-2) AS accepted FROM c JOIN g USING (job_id)""")
def accept_worker_ids(spark, sf):
    return identity.accept_worker_ids(dets(spark, sf).withColumn("track_id", F.when(F.col("track_id") != 4, F.col("track_id"))), K, tie=["det_id"])


@query("stable_ids", "WIN-16", "job_id:i det_id:i raw_id:i")
def stable_ids(spark, sf):
    return identity.stable_ids(dets(spark, sf), K)


@query("assign_player_ids", "WIN-16 WIN-18 WIN-19", "job_id:i det_id:i id:i")
def assign_player_ids(spark, sf):
    # order lines travel once, before boxes are made of them; those of a job too large for one task stay where they lie. Jobs do not meet
    lines = by_size(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_suppkey")
    cols = ["job_id", "det_id", "track_id", "t", "cx", "cy", "h"]
    return reduce(DataFrame.unionByName, [identity.assign_player_ids(dets(spark, sf, li).select(*cols), K, small=li is lines[0]) for li in lines if li is not None])


@query("merge_fragments", "WIN-18", "job_id:i det_id:i id:i")
def merge_fragments(spark, sf):
    d = dets(spark, sf).select("job_id", "det_id", "t", "cx", "cy", "h", F.expr("track_id * 10 + frame_no div 50").alias("raw_id"))
    return identity.merge_fragments(cut_lineage(d), K)              # merging reads it several times


@query("prune_to_verdict", "WIN-17 JOIN-8", "kind:s job_id:i row_id:i")
def prune_to_verdict(spark, sf):
    d = cut_lineage(dets(spark, sf).drop("frame_no", "cx", "cy", "h"))       # read by the walk, its seeds and its results
    p = people(spark, sf).withColumnRenamed("player_id", "track_id")
    top = identity.top_ids(identity.track_persistence(d, K), K, 4)
    v = top.groupBy("job_id").agg(F.sort_array(F.collect_list("track_id")).alias("keep_ids")).withColumn("count", F.lit(4))
    boxes, poses = identity.prune_to_verdict(d, p, v, K)
    return boxes.select(F.lit("box").alias("kind"), "job_id", F.col("det_id").alias("row_id")).union(poses.select(F.lit("pose"), "job_id", "row_id"))


@query("iou_continue", "JOIN-8 FN-8", "job_id:i frame_no:i track_id:i prev_id:i iou:d", ctes("boxes") + f""",
{PLAYERS},
c AS (SELECT b.job_id, b.frame_no, b.player_id AS track_id, p.player_id AS prev_id, greatest(0, least(p.x2, b.x2) - greatest(p.x1, b.x1)) * greatest(0, least(p.y2, b.y2) - greatest(p.y1, b.y1)) AS inter,
  (p.x2-p.x1)*(p.y2-p.y1) + (b.x2-b.x1)*(b.y2-b.y1) AS areas FROM players b JOIN players p ON p.job_id = b.job_id AND p.frame_no = b.frame_no - 1),
o AS (SELECT *, inter / (areas - inter) AS iou FROM c WHERE inter > 0)
SELECT job_id, frame_no, track_id, prev_id, iou FROM o WHERE iou >= 3e-1 QUALIFY row_number() OVER (PARTITION BY job_id, frame_no, track_id ORDER BY iou DESC, prev_id) = 1""")
def iou_continue(spark, sf):
    b = players(spark, sf).withColumnRenamed("player_id", "track_id")
    prev = b.withColumn("frame_no", F.col("frame_no") + 1)
    return identity.iou_continue(prev, b, ["job_id", "frame_no"]).withColumn("prev_id", F.col("p.track_id"))


@query("group_tracks", "WIN-24", "job_id:i det_id:i track_key:s")
def group_tracks(spark, sf):
    d = dets(spark, sf).withColumn("track_id", F.when((F.col("job_id") % 3 > 0) | (F.col("track_id") < 6), F.col("track_id")))
    return identity.group_tracks(d, K)


@query("near_far", "WIN-25", "job_id:i t:d near:s far:s", "WITH RECURSIVE" + ctes("boxes")[4:] + f""",
{PLAYERS},
f AS (SELECT job_id, frame_no, any_value(t) AS t, list(player_id ORDER BY player_id::VARCHAR) AS ids, list((y1 + y2) / 2 ORDER BY player_id::VARCHAR) AS ys FROM players GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_no) AS rn, frame_no - lag(frame_no) OVER (PARTITION BY job_id ORDER BY frame_no) > 1 AS gap FROM f),
w AS (SELECT job_id, 0::BIGINT AS rn, NULL::DOUBLE AS t, NULL::BIGINT AS near, NULL::BIGINT AS far FROM (SELECT DISTINCT job_id FROM o)
  UNION ALL SELECT job_id, rn, t, n, CASE WHEN len(ids) = 1 THEN NULL WHEN pf IS NOT NULL AND pf <> n AND list_contains(ids, pf) AND pf <> hi AND ys[list_position(ids, pf)] - hy < 5e-2 THEN pf ELSE hi END FROM
   (SELECT *, list_min(ry) AS hy, rids[list_position(ry, list_min(ry))] AS hi FROM
    (SELECT *, list_filter(ids, lambda q: q <> n) AS rids, list_transform(list_filter(ids, lambda q: q <> n), lambda q: ys[list_position(ids, q)]) AS ry FROM
     (SELECT *, CASE WHEN len(ids) > 1 AND pn IS NOT NULL AND list_contains(ids, pn) AND pn <> low AND ly - ys[list_position(ids, pn)] < 5e-2 THEN pn ELSE low END AS n FROM
      (SELECT o.job_id, o.rn, o.t, o.ids, o.ys, CASE WHEN o.gap THEN NULL ELSE w.near END AS pn, CASE WHEN o.gap THEN NULL ELSE w.far END AS pf, list_max(o.ys) AS ly, o.ids[list_position(o.ys, list_max(o.ys))] AS low
       FROM w JOIN o ON o.job_id = w.job_id AND o.rn = w.rn + 1)))))
SELECT job_id, t, near, far FROM w WHERE t IS NOT NULL""")
def near_far(spark, sf):
    p = players(spark, sf).select("job_id", "frame_no", "t", F.col("player_id").cast("string").alias("track_key"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return identity.near_far(p, K)


@query("stride", "WIN-20", "job_id:i frame_no:i", ctes("boxes") + """,
f AS (SELECT DISTINCT job_id, frame_no FROM boxes),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_no) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM f)
SELECT job_id, frame_no FROM r WHERE i % cast(ceil(n / 60.0) AS BIGINT) = 0""")
def stride(spark, sf):
    return identity.stride(load(spark, sf, "boxes").select("job_id", "frame_no").distinct(), K, "frame_no", 60)


@query("thin", "WIN-21", "rally_index:i pid:i", "WITH RECURSIVE" + ctes("dense")[4:] + """,
o AS (SELECT *, row_number() OVER w AS rn, coalesce(t - lag(t) OVER w > 1.5, true) AS is_first, coalesce(lead(t) OVER w - t > 1.5, true) AS is_last FROM dense WINDOW w AS (PARTITION BY rally_index ORDER BY t, pid)),
w AS (SELECT rally_index, 0::BIGINT AS rn, NULL::BIGINT AS pid, NULL::DOUBLE AS last, false AS emit FROM (SELECT DISTINCT rally_index FROM o)
  UNION ALL SELECT rally_index, rn, pid, CASE WHEN e THEN t ELSE last END, e FROM (SELECT o.rally_index, o.rn, o.pid, o.t, w.last, o.is_first OR o.is_last OR o.t - w.last >= 4e-1 AS e FROM w JOIN o ON o.rally_index = w.rally_index AND o.rn = w.rn + 1))
SELECT rally_index, pid FROM w WHERE emit""")
def thin(spark, sf):
    return thinning.thin(load(spark, sf, "dense"), ["rally_index"], hz=2.5, gap=1.5, tie=["pid"])


@query("flatten_tracks", "JOIN-21", "job_id:i t:d kind:s id:i x:d y:d", ctes("pts", "boxes") + f""",
{DETS},
{PEOPLE},
pp AS (SELECT job_id, t, player_id AS id, kps[1].x AS x, kps[1].y AS y FROM people)
SELECT job_id, t, 'shuttle' AS kind, NULL AS id, x, y FROM pts UNION ALL SELECT job_id, t, 'person', id, x, y FROM pp UNION ALL SELECT job_id, t, 'box', det_id, (x1 + x2) / 2, (y1 + y2) / 2 FROM dets WHERE job_id NOT IN (SELECT job_id FROM pp)""")
def flatten_tracks(spark, sf):
    p = people(spark, sf).select("job_id", "t", F.col("player_id").alias("id"), F.get("keypoints", F.lit(0)).alias("k")).select("job_id", "t", "id", "k.*")
    b = dets(spark, sf).select("job_id", "t", F.col("det_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "confidence")
    return thinning.flatten_tracks(load(spark, sf, "pts"), b, p, K)


@query("sanitize_pose", "WIN-15", "player_id:i row_id:i seg:i jump:b bad:s")
def sanitize_pose(spark, sf):
    p = people(spark, sf).withColumn("t", F.expr("row_id / 60e0"))
    d = cleaning.sanitize_pose(p, ["job_id"], "player_id").withColumn("bad", F.array_join(F.array_sort(F.concat("bad_joint", "bad_limb")), ","))
    return d


@query("pose_segments", "WIN-15", "player_id:i row_id:i seg:i jump:b", "WITH " + PEOPLE + """,
k AS (SELECT *, list_filter(kps, lambda p: p.confidence >= 15e-2) AS g FROM people),
c AS (SELECT player_id, row_id, row_id / 60e0 AS t, len(g) AS n, list_sum(list_transform(g, lambda p: p.x)) / len(g) AS cx, list_sum(list_transform(g, lambda p: p.y)) / len(g) AS cy,
  CASE WHEN len(g) >= 2 THEN greatest(list_max(list_transform(g, lambda p: p.y)) - list_min(list_transform(g, lambda p: p.y)), 5e-2) ELSE 25e-2 END AS sc FROM k),
d AS (SELECT *, greatest(t - lag(t) OVER w, 1e-3) AS dt, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS hop, (sc + lag(sc) OVER w) / 2 AS ms FROM c WHERE n > 0 WINDOW w AS (PARTITION BY player_id ORDER BY t, row_id)),
f AS (SELECT *, hop > (26e-1 * least(dt, 7e-1) + 18e-2) * ms AS moved FROM d)
SELECT player_id, row_id, sum(CASE WHEN dt > 1.5 OR moved THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY t, row_id) AS seg, coalesce(dt <= 1.5 AND moved, false) AS jump FROM f
UNION ALL SELECT player_id, row_id, 0, false FROM c WHERE n = 0""".replace("\nUNION ALL", " UNION ALL"))
def pose_segments(spark, sf):
    p = people(spark, sf).withColumn("t", F.expr("row_id / 60e0"))
    return cleaning.sanitize_pose(p, [], "player_id")


@query("wrist_series", "WIN-38", "job_id:i player_id:i t:d side:s x:d y:d", "WITH " + PEOPLE + """
SELECT job_id, player_id, t, 'l' AS side, kps[10].x AS x, kps[10].y AS y FROM people WHERE kps[10].confidence >= 15e-2 UNION ALL SELECT job_id, player_id, t, 'r', kps[11].x, kps[11].y FROM people WHERE kps[11].confidence >= 15e-2""")
def wrist_series(spark, sf):
    from ..operators.segments import wrist_series

    return wrist_series(people(spark, sf), K)
