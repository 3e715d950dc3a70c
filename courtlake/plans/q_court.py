"""Queries on the court plane, and over scalar functions."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalar as sc
from ..operators import court
from ..operators.tiles import by_size
from .adapters import court_quads, ctes, load, table
from .registry import query
from .shapes import COURT_H, PEOPLE, PLAYERS, POSITIONS, courts, dets, DETS, people, players, positions

ON = "x_m BETWEEN -1.0 AND 71e-1 AND y_m BETWEEN -1.5 AND 149e-1"


@query("quad_homography", "FN-2 FN-1", "job_id:i corner:i u:d v:d", ctes("courts") + """
SELECT job_id, c AS corner, CASE WHEN c IN (1, 2) THEN 61e-1 ELSE 0 END AS u, CASE WHEN c IN (2, 3) THEN 134e-1 ELSE 0 END AS v FROM courts, (SELECT unnest([0, 1, 2, 3]) AS c)""")
def quad_homography(spark, sf):
    d = courts(spark, sf).select("job_id", "homography", F.posexplode("corners").alias("corner", "p"))
    return d.withColumn("q", g.court_project("homography", F.col("p")[0], F.col("p")[1])).select("job_id", "corner", "q.u", "q.v")


@query("net_line", "FN-6", "job_id:i u0:d v0:d u1:d v1:d", ctes("courts") + """
SELECT job_id, 0 AS u0, 67e-1 AS v0, 61e-1 AS u1, 67e-1 AS v1 FROM courts""")
def net_line(spark, sf):
    d = courts(spark, sf).withColumn("n", g.net_line("homography"))
    a, b = (g.court_project("homography", F.col("n")[i], F.col("n")[i + 1]) for i in (0, 2))
    return d.withColumns({"a": a, "b": b}).selectExpr("job_id", "a.u as u0", "a.v as v0", "b.u as u1", "b.v as v1")


@query("court_positions", "JOIN-9 FN-1 FN-2", "job_id:i player_id:i t:d x_m:d y_m:d src:s", ctes("boxes", "courts") + f""",
{PLAYERS},
{PEOPLE},
{COURT_H},
{POSITIONS}
SELECT * FROM positions""")
def court_positions(spark, sf):
    return positions(spark, sf)


@query("movement_stats", "AGG-8 SET-4", "job_id:i player_id:i points:i distance_m:d coverage_pct:d court_space:b", ctes("boxes", "courts") + f""",
{PLAYERS},
{PEOPLE},
{COURT_H},
{POSITIONS},
o AS (SELECT *, {ON} AS ok FROM positions),
l AS (SELECT *, lag(ok) OVER w AS pok, sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)) AS step FROM o WINDOW w AS (PARTITION BY job_id, player_id ORDER BY t))
SELECT job_id, player_id, count(*) AS points, sum(CASE WHEN ok AND pok AND step < 3 THEN step ELSE 0 END) AS distance_m,
  count(DISTINCT CASE WHEN ok THEN floor(greatest(0, least(0.99, x_m / 6.1)) * 10) * 100 + floor(greatest(0, least(0.99, y_m / 13.4)) * 22) END) / 220e0 * 100 AS coverage_pct, true AS court_space FROM l GROUP BY 1, 2""".replace("\n  count(DISTINCT", " count(DISTINCT"))
def movement_stats(spark, sf):
    return court.movement_stats(positions(spark, sf), ["job_id"])


@query("movement_image_space", "AGG-8", "job_id:i player_id:i points:i coverage_pct:d court_space:b", ctes("boxes") + f""",
{PLAYERS}
SELECT job_id, player_id, count(*) AS points, count(DISTINCT floor(greatest(0, least(99e-2, (x1 + x2) / 2)) * 10) * 100 + floor(greatest(0, least(99e-2, y2)) * 22)) / 220e0 * 100 AS coverage_pct, false AS court_space FROM players GROUP BY 1, 2""")
def movement_image(spark, sf):
    p = players(spark, sf).selectExpr("job_id", "player_id", "(x1 + x2) / 2 as x", "y2 as y")
    return court.movement_stats(p, ["job_id"], court_space=False)


@query("heatmap", "AGG-9", "job_id:i player_id:i ix:i iy:i heat:d", ctes("boxes", "courts") + f""",
{PLAYERS},
{PEOPLE},
{COURT_H},
{POSITIONS},
f AS (SELECT * FROM (SELECT DISTINCT job_id, player_id FROM positions)),
c AS (SELECT job_id, player_id, greatest(0e0, least(1e0, x_m / 61e-1)) * 17 AS cx, greatest(0e0, least(1e0, y_m / 134e-1)) * 37 AS cy FROM positions JOIN f USING (job_id, player_id) WHERE x_m BETWEEN -1.2 AND 73e-1 AND y_m BETWEEN -1.5 AND 149e-1),
s AS (SELECT job_id, player_id, floor(cx + 5e-1) + a AS ix, floor(cy + 5e-1) + b AS iy, cx, cy FROM c, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
h AS (SELECT job_id, player_id, ix, iy, sum(exp(-((ix-cx)*(ix-cx) + (iy-cy)*(iy-cy)) / 12e-1)) AS h FROM s WHERE ix BETWEEN 0 AND 17 AND iy BETWEEN 0 AND 37 GROUP BY 1, 2, 3, 4)
SELECT job_id, player_id, ix, iy, h / greatest(1e-6, max(h) OVER (PARTITION BY job_id, player_id)) AS heat FROM h""")
def heatmap(spark, sf):
    return court.heatmap(positions(spark, sf))


@query("source_share", "AGG-31", "job_id:i total:i ankle_pct:d", ctes("boxes", "courts") + f""",
{PLAYERS},
{PEOPLE},
{COURT_H},
{POSITIONS}
SELECT job_id, count(*) AS total, 100e0 * count(*) FILTER (src = 'ankles') / count(*) AS ankle_pct FROM positions WHERE x_m BETWEEN -1.0 AND 71e-1 AND y_m BETWEEN -1.0 AND 144e-1 GROUP BY 1""")
def source_share(spark, sf):
    return court.source_share(positions(spark, sf))


def consensus(spark, sf, samples: int, model: bool):
    """The consensus of the detections, and of those of the model. Order lines travel before corners are made of them, a tenth of
    the size; those of a job too large for one task stay where they lie, and the operator spreads their values."""
    parts = by_size(table(spark, sf, "lineitem").selectExpr("l_suppkey as job_id", "l_partkey as p", "l_discount as score"), "job_id")
    made = [court.corner_consensus(detections(spark, sf, li, 7, 0.0004), samples, detections(spark, sf, li, 11, 0.0002) if model else None, small=li is parts[0])
            for li in parts if li is not None]
    return reduce(DataFrame.unionByName, made)


def detections(spark, sf, li, seed: int, wobble: float):
    """Per order line one noisy detection of its supplier's court."""
    d = li.join(load(spark, sf, "courts"), "job_id")
    off = [f"((p * {seed + 2 * i}) % 101 - 50) * {wobble!r}D" for i in range(8)]
    names = [("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy")]
    pts = ", ".join(f"array({x} + {off[2 * i]}, {y} + {off[2 * i + 1]})" for i, (x, y) in enumerate(names))
    return d.selectExpr("job_id", f"array({pts}) as corners", "score * 8 as score")


def _det_sql(name: str, seed: int, wobble: float) -> str:
    off = [f"((l_partkey * {seed + 2 * i}) % 101 - 50) * {wobble!r}::DOUBLE" for i in range(8)]
    cols = [c for pair in (("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy")) for c in pair]
    vals = ", ".join(f"{c} + {off[i]} AS v{i}" for i, c in enumerate(cols))
    return f"{name} AS (SELECT l_suppkey AS job_id, l_discount * 8 AS score, {vals} FROM lineitem JOIN courts ON courts.job_id = l_suppkey)"


def _med_sql(src: str, out: str) -> str:
    med = ", ".join(f"round(median(v{i}), 4) AS m{i}" for i in range(8))
    sd = " + ".join(f"stddev_pop(v{i})" for i in range(8))
    return f"{out} AS (SELECT job_id, {med}, CASE WHEN count(*) > 1 THEN ({sd}) / 8 ELSE 0 END AS spread, count(*) AS found, max(score) AS best FROM {src} GROUP BY 1)"


@query("corner_consensus", "AGG-14 FN-4", "job_id:i x0:d y2:d spread:d confidence:d source:s status:s", ctes("courts") + f""",
{_det_sql('cv', 7, 0.0004)},
{_det_sql('gm', 11, 0.0002)},
{_med_sql('cv', 'c')},
{_med_sql('gm', 'g')},
j AS (SELECT c.*, g.m0 AS g0, g.m5 AS g5, least(1, c.found / 900e0 * c.best * greatest(2e-1, 1 - c.spread * 12)) AS conf FROM c JOIN g USING (job_id)),
k AS (SELECT *, round(conf, 3) AS cf FROM j)
SELECT job_id, CASE WHEN cf >= 5e-1 THEN m0 ELSE (m0 + g0) / 2 END AS x0, CASE WHEN cf >= 5e-1 THEN m5 ELSE (m5 + g5) / 2 END AS y2, spread, CASE WHEN cf >= 5e-1 THEN cf ELSE greatest(cf, 65e-2) END AS confidence,
  CASE WHEN cf >= 5e-1 THEN 'cv' ELSE 'cv+gemini' END AS source, 'ok' AS status FROM k""".replace("\n  CASE", " CASE"))
def corner_consensus(spark, sf):
    d = consensus(spark, sf, 900, model=True)
    return d.withColumns({"x0": F.col("corners")[0][0], "y2": F.col("corners")[2][1]})


@query("corner_consensus_cv", "AGG-14", "job_id:i x0:d spread:d confidence:d status:s", ctes("courts") + f""",
{_det_sql('cv', 7, 0.0004)},
{_med_sql('cv', 'c')},
k AS (SELECT *, round(least(1, found / 9000e0 * best * greatest(2e-1, 1 - spread * 12)), 3) AS cf FROM c)
SELECT job_id, m0 AS x0, spread, cf AS confidence, CASE WHEN cf < 35e-2 THEN 'low_confidence' ELSE 'ok' END AS status FROM k""")
def corner_consensus_cv(spark, sf):
    return consensus(spark, sf, 9000, model=False).withColumn("x0", F.col("corners")[0][0])


@query("effective_corners", "PRJ-24 PRJ-4", "job_id:i x0:d has:b", ctes("courts") + """,
j AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN ax + 1e-1 END AS own, CASE WHEN job_id % 3 < 2 AND bal > 0 THEN ax END AS old FROM courts)
SELECT job_id, round(coalesce(own, old), 4) AS x0, coalesce(own, old) IS NOT NULL AS has FROM j""")
def effective_corners(spark, sf):
    q = court_quads(spark, sf)
    moved = F.transform("corners", lambda p: F.array(F.when(p[0] < 0.5, p[0] + 0.1).otherwise(p[0]), p[1]))
    jobs = q.select("job_id", F.when(F.col("job_id") % 3 == 0, moved).otherwise(F.when(F.col("job_id") % 3 == 1, F.slice("corners", 1, 3))).alias("court_corners"))
    prior = q.select("job_id", "corners", F.when((F.col("job_id") % 3 < 2) & (F.col("bal") > 0), "manual").otherwise("cv").alias("source"))
    return court.effective_corners(jobs, prior).withColumns({"x0": F.col("court_corners")[0][0], "has": F.col("court_corners").isNotNull()})


@query("quad_area", "FN-4", "job_id:i area:d valid:b", ctes("courts") + """,
a AS (SELECT job_id, abs(ax*by_ - bx*ay + bx*cy - cx*by_ + cx*dy - dx*cy + dx*ay - ax*dy) / 2 AS area, job_id % 6 AS grow FROM courts)
SELECT job_id, area, area >= 1e-1 AS valid FROM a""")
def quad_area(spark, sf):
    return court_quads(spark, sf).withColumns({"area": g.quad_area("corners"), "valid": g.valid_quad("corners")})


@query("box_forms", "FN-7 FN-8", "job_id:i det_id:i x:d y:d w:d h:d foot_y:d back_x1:d area:d overlap:d", ctes("boxes") + f""",
{DETS}
SELECT job_id, det_id, (x1+x2)/2 AS x, (y1+y2)/2 AS y, greatest(0, x2-x1) AS w, greatest(0, y2-y1) AS h, y2 AS foot_y, x1 AS back_x1, (x2-x1)*(y2-y1) AS area,
  CASE WHEN least(x2, 0.6) > greatest(x1, 0.3) AND least(y2, 0.7) > greatest(y1, 0.2) THEN (least(x2, 6e-1) - greatest(x1, 3e-1)) * (least(y2, 7e-1) - greatest(y1, 2e-1)) / ((x2-x1)*(y2-y1) + 15e-2 - (least(x2, 6e-1) - greatest(x1, 3e-1)) * (least(y2, 7e-1) - greatest(y1, 2e-1))) ELSE 0 END AS overlap FROM dets""".replace("\n  CASE", " CASE"))
def box_forms(spark, sf):
    d = dets(spark, sf).withColumn("b", g.xywh("x1", "y1", "x2", "y2")).withColumn("back", g.xyxy("b.x", "b.y", "b.w", "b.h"))
    return d.select("job_id", "det_id", "b.x", "b.y", "b.w", "b.h", g.box_foot("x1", "y1", "x2", "y2")["y"].alias("foot_y"), F.col("back.x1").alias("back_x1"),
                    g.box_area("x1", "y1", "x2", "y2").alias("area"), g.iou(["x1", "y1", "x2", "y2"], [F.lit(0.3), F.lit(0.2), F.lit(0.6), F.lit(0.7)]).alias("overlap"))


@query("pose_geometry", "FN-7", "row_id:i cx:d cy:d height:d", "WITH " + PEOPLE + """,
k AS (SELECT row_id, list_filter(kps, lambda p: p.confidence >= 5e-2) AS q FROM people)
SELECT row_id, list_sum(list_transform(q, lambda p: p.x)) / len(q) AS cx, list_sum(list_transform(q, lambda p: p.y)) / len(q) AS cy,
  CASE WHEN len(q) >= 2 THEN list_max(list_transform(q, lambda p: p.y)) - list_min(list_transform(q, lambda p: p.y)) ELSE 25e-2 END AS height FROM k""".replace("\n  CASE", " CASE"))
def pose_geometry(spark, sf):
    d = people(spark, sf).withColumns({"c": g.pose_center("keypoints"), "height": g.pose_height("keypoints")})
    return d.select("row_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "height")


@query("crop_rect", "FN-10 FN-12", "pid:i x0:i y0:i x1:i y1:i cw:d in_view:b nx:d", ctes("dense") + """,
s AS (SELECT *, 1280 + pid % 3 * 320 AS w, 720 + pid % 2 * 360 AS h FROM dense),
c AS (SELECT *, CASE WHEN w / h > 1080/1920 THEN h * (1080/1920) ELSE w END / z AS cw_, CASE WHEN w / h > 1080/1920 THEN h ELSE w / (1080/1920) END / z AS ch_ FROM s),
r AS (SELECT *, round_even(greatest(cw_/2, least(w - cw_/2, x * w)) - cw_/2, 0) AS rx, round_even(greatest(ch_/2, least(h - ch_/2, y * h)) - ch_/2, 0) AS ry FROM c),
q AS (SELECT pid, greatest(0, rx) AS x0, greatest(0, ry) AS y0, least(rx + floor(cw_), w) AS x1, least(ry + floor(ch_), h) AS y1, h * (1080/1920) / w AS cw, w, h, x, y FROM r),
v AS (SELECT *, (x + 1e-1 - x0 / w) / ((x1 - x0) / w) AS nx0, (y - y0 / h) / ((y1 - y0) / h) AS ny0 FROM q)
SELECT pid, x0, y0, x1, y1, cw, nx0 BETWEEN -12e-2 AND 112e-2 AND ny0 BETWEEN -12e-2 AND 112e-2 AS in_view, CASE WHEN nx0 BETWEEN -12e-2 AND 112e-2 AND ny0 BETWEEN -12e-2 AND 112e-2 THEN nx0 END AS nx FROM v""")
def crop_rect(spark, sf):
    d = load(spark, sf, "dense").selectExpr("*", "1280 + pid % 3 * 320 as w", "720 + pid % 2 * 360 as h").withColumn("r", g.crop_rect("x", "y", "z", "w", "h"))
    w, h = F.col("w"), F.col("h")
    back = g.invert_crop(F.col("x") + 0.1, F.col("y"), F.col("r.x0") / w, F.col("r.y0") / h, (F.col("r.x1") - F.col("r.x0")) / w, (F.col("r.y1") - F.col("r.y0")) / h)
    return d.withColumns({"b": back, "n": g.crop_norms("w", "h")}).select("pid", "r.*", F.col("n.cw").alias("cw"), F.col("b").isNotNull().alias("in_view"), F.col("b.x").alias("nx"))


@query("zoom_easing", "FN-11", "pid:i push:d punch:d zoom:d", ctes("dense") + """
SELECT pid, 1 + 2e-2 * (confidence * confidence * (3 - 2 * confidence)) AS push, 1 + 6e-2 * exp(-greatest(x, 0) / 35e-2) AS punch,
  least(155e-2, z * 14e-1 * (1 + 2e-2 * (confidence * confidence * (3 - 2 * confidence))) * (1 + 6e-2 * exp(-greatest(x, 0) / 35e-2))) AS zoom FROM dense""".replace("\n  least", " least"))
def zoom_easing(spark, sf):
    return load(spark, sf, "dense").select("pid", g.push("confidence").alias("push"), g.punch("x", 0.06).alias("punch"), g.final_zoom(F.col("z") * 1.4, "confidence", "x", 0.02, 0.06).alias("zoom"))


@query("zoom_feasible", "FN-17", "pid:i zoom:d", ctes("dense") + """,
zs AS (SELECT unnest([14e-1, 14e-1*96e-2, 14e-1*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2, 14e-1*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2*96e-2]) AS zm),
p AS (SELECT pid, zm, x AS px, y AS py, CASE WHEN pid % 4 > 0 THEN x + (confidence - 5e-1) * 8e-1 END AS sx, y - 3e-1 * confidence AS sy, confidence AS r, 31640625e-8 / (2 * zm) AS hw, 1 / (2 * zm) AS hh FROM dense, zs),
i AS (SELECT *, px + 8e-2 - hw * 94e-2 AS xl, px - 8e-2 + hw * 94e-2 AS xh, py + 15e-2 - hh * 94e-2 AS yl, py - 1e-1 + hh * 94e-2 AS yh, hw * 6e-1 + (1 - r) * 8e-1 AS ax, hh * 75e-2 + (1 - r) * 8e-1 AS ay, sx IS NOT NULL AND r > 0 AS pull FROM p),
f AS (SELECT pid, zm, CASE WHEN pull THEN greatest(xl, sx - ax) <= least(xh, sx + ax) AND greatest(yl, sy - ay) <= least(yh, sy + ay) ELSE xl <= xh AND yl <= yh END AS ok FROM i)
SELECT pid, coalesce(max(zm) FILTER (ok), 1) AS zoom FROM f GROUP BY pid""")
def zoom_feasible(spark, sf):
    d = load(spark, sf, "dense").selectExpr("pid", "x", "y", "confidence as r", "case when pid % 4 > 0 then x + (confidence - 5e-1) * 8e-1 end as sx", "case when pid % 4 > 0 then y - 3e-1 * confidence end as sy")
    return d.select("pid", g.zoom_feasible("x", "y", "sx", "sy", "r", F.lit(0.31640625), F.lit(1.0)).alias("zoom"))


@query("parse_and_format", "FN-5 FN-14 PRJ-1 PRJ-5", "job_id:i rally_id:i start_s:d bad:b length:s abs_t:d conf:d", ctes("rallies") + """
SELECT job_id, rally_id, start_s, true AS bad, CASE WHEN round(dur * 7) >= 60 THEN floor(round(dur * 7) / 60)::BIGINT || 'm ' || (round(dur * 7)::BIGINT % 60) || 's' ELSE round(dur * 7)::BIGINT || 's' END AS length,
  CASE WHEN dur / 2 < start_s - 25e-2 THEN start_s + dur / 2 ELSE dur / 2 END AS abs_t, CASE WHEN intensity = 5 THEN 0 ELSE least(1, intensity / 3e0) END AS conf FROM rallies""".replace("\n  CASE", " CASE"))
def parse_and_format(spark, sf):
    r = load(spark, sf, "rallies").withColumns({
        "clock": F.expr("concat(' ', cast(start_s as bigint) div 3600, ':', (cast(start_s as bigint) div 60) % 60, ':', cast(start_s as bigint) % 60)"), "raw": F.expr("case when intensity = 5 then 'n/a' else cast(intensity / 3e0 as string) end")})
    return r.select("job_id", "rally_id", sc.parse_clock("clock").alias("start_s"), sc.parse_clock(F.lit("1:xx")).isNull().alias("bad"),
                    sc.fmt_duration(F.col("dur") * 7).alias("length"), sc.abs_time(F.col("dur") / 2, "start_s", "dur").alias("abs_t"), sc.clamp01("raw").alias("conf"))


@query("short_text", "PRJ-13", "doc_id:i short:s", """
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '...' END AS short FROM c""")
def short_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.short_text("text", 80).alias("short"))


@query("redact_and_basename", "PRJ-14", "page_id:i redacted:s base:s", """
WITH p AS (SELECT page_id, url, rtrim(url, '/') AS u FROM pages)
SELECT page_id, CASE WHEN length(url) <= 8 THEN url ELSE left(url, 4) || '...' || right(url, 4) END AS redacted, string_split(u, '/')[-1] AS base FROM p""")
def redact(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.redact("url").alias("redacted"), sc.basename("url").alias("base"))


@query("clean_texts", "PRJ-15", "doc_id:i n:i texts:s", """
WITH l AS (SELECT doc_id, unnest(string_split(text, '.')) AS p, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS s FROM l),
d AS (SELECT doc_id, i, CASE WHEN length(s) <= 40 THEN s ELSE rtrim(substr(s, 1, 39)) || '...' END AS s FROM c WHERE s <> ''),
e AS (SELECT doc_id, s, min(i) AS i FROM d GROUP BY 1, 2),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3),
g AS (SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY i) AS t FROM f GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n, coalesce(t, '') AS texts FROM documents LEFT JOIN g USING (doc_id)""")
def clean_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", sc.clean_texts(F.split("text", r"\."), 3, 40).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.array_join("t", "|").alias("texts"))


@query("clean_moments", "PRJ-16", "conv_id:i n:i picked:s", ctes("texts") + """,
m AS (SELECT conv_id, turn, turn % 6 AS ri, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS label FROM texts),
k AS (SELECT * FROM m WHERE ri BETWEEN 1 AND 4 AND label <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3),
g AS (SELECT conv_id, count(*) AS n, string_agg(ri || ':' || label, ',' ORDER BY turn) AS p FROM k GROUP BY 1)
SELECT c.conv_id, coalesce(n, 0) AS n, coalesce(p, '') AS picked FROM (SELECT DISTINCT conv_id FROM texts) c LEFT JOIN g USING (conv_id)""")
def clean_moments(spark, sf):
    t = load(spark, sf, "texts")
    m = F.struct("turn", (F.col("turn") % 6).cast("string").alias("rally_index"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")).alias("label"), F.lit("long rally").alias("reason"))
    d = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m")).withColumn("top", F.lit(4))   # a conversation's turns
    d = d.withColumn("k", sc.clean_moments("m", "top"))
    return d.select("conv_id", F.size("k").alias("n"), F.array_join(F.transform("k", lambda x: F.concat(x["rally_index"].cast("string"), F.lit(":"), x["label"])), ",").alias("picked"))


@query("unfence_json", "FN-13", "event_id:i k:i", """
SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def unfence(spark, sf):
    e = table(spark, sf, "events").withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props")))
    return e.select("event_id", F.from_json(sc.unfence_json("raw"), "k long").alias("j")).select("event_id", "j.k")


@query("evidence_text", "FN-15", "job_id:i text:s", ctes("peaks") + """,
p AS (SELECT job_id % 20 AS job_id, t, row_number() OVER (PARTITION BY job_id % 20 ORDER BY t) AS rn FROM peaks)
SELECT job_id, CASE WHEN count(*) < 10 THEN '' ELSE string_agg(round_even(t, 0)::BIGINT::VARCHAR, ', ' ORDER BY t) FILTER (rn <= 120) END AS text FROM p GROUP BY 1""")
def evidence_text(spark, sf):
    from ..operators.tiles import top_n, with_totals

    p = with_totals(load(spark, sf, "peaks").select((F.col("job_id") % 20).alias("job_id"), "t", "peak_id"), "job_id", n=F.count("*"))
    shown = top_n(p, "job_id", [F.asc("t"), F.asc("peak_id")], 120).groupBy("job_id").agg(F.collect_list("t").alias("ts"), F.max("n").alias("n"))
    return shown.select("job_id", sc.evidence_text("ts").alias("text"))


@query("decibels", "FN-16", "pid:i db:d", ctes("pts") + """
SELECT pid, 20 * log10(greatest(1e-4, (value - 20) / 200)) AS db FROM pts""")
def decibels(spark, sf):
    return load(spark, sf, "pts").select("pid", sc.to_db((F.col("value") - 20) / 200).alias("db"))
