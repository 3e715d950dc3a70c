"""Queries over shuttle tracks."""
from pyspark.sql import functions as F

from ..operators import cleaning, segments
from ..operators import smoothing as sm
from ..operators.tiles import quantiles, sessionize
from .adapters import court_quads, ctes, load
from .registry import query

K = ["job_id", "track_id"]
SEG = """
seg0 AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM pts WHERE confidence >= 0.3 WINDOW w AS (PARTITION BY track_id ORDER BY t, pid)),
seg1 AS (SELECT *, sum(CASE WHEN dt > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t, pid) AS seg FROM seg0)"""


@query("flight_segments", "WIN-4 WIN-3", "job_id:i track_id:i seg:i start_s:d end_s:d points:i median_speed:d max_speed:d in_play:b", ctes("pts") + "," + SEG + """,
sp AS (SELECT *, CASE WHEN dt <= 12 AND dt > 1e-3 THEN sqrt(dx * dx + dy * dy) / dt END AS speed FROM seg1),
g AS (SELECT job_id, track_id, seg, min(t) AS start_s, max(t) AS end_s, count(*) AS points, max(speed) AS max_speed,
        list_sort(list(speed) FILTER (speed IS NOT NULL))[count(speed) // 2 + 1] AS median_speed FROM sp GROUP BY 1, 2, 3)
SELECT *, median_speed >= 15e-2 AND end_s - start_s >= 4e-1 AS in_play FROM g WHERE points >= 3 AND median_speed IS NOT NULL""")
def flight_segments(spark, sf):
    return segments.flight_segments(load(spark, sf, "pts"), K, gap=12, tie=["pid"])


@query("sessionize", "WIN-3", "track_id:i pid:i seg:i", ctes("pts") + """,
a AS (SELECT *, t - lag(t) OVER w AS dt FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t, pid))
SELECT track_id, pid, sum(CASE WHEN dt > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t, pid) AS seg FROM a""")
def sessions(spark, sf):
    return sessionize(load(spark, sf, "pts"), ["track_id"], "t", 12, tie=["pid"])


@query("split_shots", "WIN-6", "track_id:i shot:i pid:i", ctes("pts") + """,
a AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM pts WHERE confidence >= 0.3 WINDOW w AS (PARTITION BY track_id ORDER BY t, pid)),
b AS (SELECT *, CASE WHEN dt <= 12 THEN dx / greatest(dt, 1e-3) END AS vx, CASE WHEN dt <= 12 THEN dy / greatest(dt, 1e-3) END AS vy FROM a),
c AS (SELECT *, lag(vx) OVER w AS px, lag(vy) OVER w AS py FROM b WINDOW w AS (PARTITION BY track_id ORDER BY t, pid)),
d AS (SELECT *, CASE WHEN dt > 12 OR (sqrt(vx*vx+vy*vy) > 1e-3 AND sqrt(px*px+py*py) > 1e-3
        AND (vx*px+vy*py) / (sqrt(vx*vx+vy*vy) * sqrt(px*px+py*py)) < 35e-2) THEN 1 ELSE 0 END AS brk FROM c),
e AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY t, pid) AS seg FROM d),
g AS (SELECT track_id, seg, row_number() OVER (PARTITION BY track_id ORDER BY seg) - 1 AS shot FROM
        (SELECT track_id, seg FROM e GROUP BY 1, 2 HAVING count(*) >= 3 AND max(t) - min(t) >= 22e-2))
SELECT track_id, shot, pid FROM e JOIN g USING (track_id, seg)""")
def split_shots(spark, sf):
    return segments.split_shots(load(spark, sf, "pts"), ["track_id"], gap=12, min_speed=1e-3, min_pts=3, tie=["pid"])


@query("sharpest_turn", "WIN-7 FN-9", "rally_index:i points:i turn_cos:d", ctes("dense") + """,
a AS (SELECT rally_index, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, row_number() OVER w - 1 AS i FROM dense
      WINDOW w AS (PARTITION BY rally_index ORDER BY t, pid)),
c AS (SELECT rally_index, i, CASE WHEN sqrt(ax*ax+ay*ay) >= 1e-6 AND sqrt(bx*bx+by_*by_) >= 1e-6 THEN round((ax*bx+ay*by_) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+by_*by_)), 9) END AS c FROM a)
SELECT rally_index, count(*) AS points, coalesce(arg_min(i, (c, i)) FILTER (c IS NOT NULL), 0) AS turn_index, min(c) AS turn_cos FROM c GROUP BY rally_index""")
def sharpest_turn(spark, sf):
    return segments.sharpest_turn(load(spark, sf, "dense"), ["rally_index"], tie=["pid"])


@query("teleports", "WIN-11", "track_id:i points:i teleports:i per_1000:d", ctes("pts") + """,
a AS (SELECT track_id, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS hop FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t, pid))
SELECT track_id, count(*) AS points, count(*) FILTER (dt <= 2.5 AND hop > 22e-2) AS teleports, CASE WHEN count(*) < 2 THEN 0 ELSE 1000.0 * count(*) FILTER (dt <= 2.5 AND hop > 22e-2) / count(*) END AS per_1000
FROM a GROUP BY track_id""")
def teleports(spark, sf):
    return segments.teleports(load(spark, sf, "pts"), ["track_id"], fps=1.0, tie=["pid"])


@query("trail", "WIN-37", "track_id:i at_s:d pid:i", ctes("pts") + """,
at_ AS (SELECT DISTINCT track_id, floor(t / 60) * 60 AS at_s FROM pts),
n AS (SELECT a.track_id, a.at_s, p.pid, p.t, p.x, p.y FROM at_ a JOIN pts p ON p.track_id = a.track_id AND p.confidence >= 0.3 AND p.t BETWEEN a.at_s - 40 AND a.at_s + 1e-3),
b AS (SELECT *, CASE WHEN lag(t) OVER w - t > 12 OR sqrt((lag(x) OVER w - x) * (lag(x) OVER w - x) + (lag(y) OVER w - y) * (lag(y) OVER w - y)) > 30e-2 THEN 1 ELSE 0 END AS brk FROM n
      WINDOW w AS (PARTITION BY track_id, at_s ORDER BY t DESC, pid DESC)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY track_id, at_s ORDER BY t DESC, pid DESC) AS cut FROM b)
SELECT track_id, at_s, pid FROM c WHERE cut = 0""")
def trail(spark, sf):
    p = load(spark, sf, "pts")
    at = p.selectExpr("track_id", "cast(floor(t / 60) * 60 as double) as at").distinct()
    return segments.trail(p, at, ["track_id"], window=40.0, max_dt=12.0, max_jump=0.30, tie=["pid"]).withColumnRenamed("at", "at_s")


@query("side_court_gate", "PRJ-17", "track_id:i pid:i", ctes("pts", "courts") + """,
q AS (SELECT job_id, (ax + bx + cx + dx) / 4 AS mx, ax, bx, cx, dx FROM courts),
bd AS (SELECT job_id, greatest(0, least(mx + (ax-mx)*135e-2, mx + (bx-mx)*135e-2, mx + (cx-mx)*135e-2, mx + (dx-mx)*135e-2) - 3e-2) AS lo,
        least(1, greatest(mx + (ax-mx)*135e-2, mx + (bx-mx)*135e-2, mx + (cx-mx)*135e-2, mx + (dx-mx)*135e-2) + 3e-2) AS hi FROM q),
a AS (SELECT *, t - lag(t) OVER w AS dt FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t, pid)),
s AS (SELECT *, sum(CASE WHEN dt > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t, pid) AS seg FROM a),
v AS (SELECT s.*, bd.lo, bd.hi, avg(CASE WHEN x BETWEEN (ax2) AND (bx2) THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY s.track_id, seg) AS share
      FROM s LEFT JOIN (SELECT job_id, lo, hi, lo AS ax2, hi AS bx2 FROM bd WHERE hi - lo < 90e-2) bd USING (job_id))
SELECT track_id, pid FROM v WHERE lo IS NULL OR share >= 0.5""")
def side_court_gate(spark, sf):
    return segments.side_court_gate(load(spark, sf, "pts"), court_quads(spark, sf), ["track_id"], gap=12, tie=["pid"])


@query("distinct_cells", "SET-4", "job_id:i cx:i cy:i", ctes("pts") + """
SELECT DISTINCT job_id, floor(x * 10) AS cx, floor(y * 22) AS cy FROM pts""")
def distinct_cells(spark, sf):
    d = load(spark, sf, "pts").selectExpr("job_id", "floor(x * 10) as cx", "floor(y * 22) as cy")
    return segments.distinct_cells(d, ["job_id", "cx", "cy"])


@query("valid_points", "PRJ-6 PRJ-1", "track_id:i pid:i x:d y:d confidence:d", ctes("pts") + """
SELECT track_id, pid, x, y, confidence FROM pts WHERE confidence >= 0.3 AND x > 0 AND x <= 1 AND y > 0 AND y <= 1""")
def valid_points(spark, sf):
    return cleaning.valid_points(load(spark, sf, "pts"))


@query("exact_quantiles", "AGG-21 WIN-4", "job_id:i up:d p50:d p95:d", ctes("pts") + """
SELECT job_id, list_sort(list(value))[count(*) // 2 + 1] AS up, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM pts GROUP BY job_id""")
def exact_quantiles(spark, sf):
    return quantiles(load(spark, sf, "pts"), ["job_id"], "value", {"up": "upper", "p50": 0.5, "p95": 0.95})


_DENSE = ctes("dense")


@query("drop_static_runs", "WIN-8", "rally_index:i pid:i", "WITH RECURSIVE" + _DENSE[4:] + """,
fed AS (SELECT rally_index, pid, t, CASE WHEN kind = 'click' THEN 5e-1 ELSE x END AS x, y, row_number() OVER (PARTITION BY rally_index ORDER BY t, pid) AS rn FROM dense),
w AS (SELECT rally_index, rn, pid, t, x AS ax, y AS ay, 1 AS run FROM fed WHERE rn = 1
  UNION ALL SELECT rally_index, rn, pid, t, CASE WHEN fresh THEN x ELSE ax END, CASE WHEN fresh THEN y ELSE ay END, run + CASE WHEN fresh THEN 1 ELSE 0 END
    FROM (SELECT f.*, w.ax, w.ay, w.run, f.t - w.t > 1 OR sqrt((f.x - w.ax) * (f.x - w.ax) + (f.y - w.ay) * (f.y - w.ay)) > 12e-2 AS fresh
          FROM w JOIN fed f ON f.rally_index = w.rally_index AND f.rn = w.rn + 1)),
n AS (SELECT *, count(*) OVER (PARTITION BY rally_index, run) AS len FROM w)
SELECT rally_index, pid FROM n WHERE len < 4""")
def drop_static_runs(spark, sf):
    d = load(spark, sf, "dense").withColumn("x", F.when(F.col("kind") == "click", 0.5).otherwise(F.col("x")))
    return cleaning.drop_static_runs(d, ["rally_index"], radius=0.12, run=4, gap=1.0, tie=["pid"])


@query("measure_confidence", "WIN-9", "rally_index:i pid:i confidence:d provenance:s", "WITH RECURSIVE" + _DENSE[4:] + """,
fed AS (SELECT 1 AS dir, rally_index, pid, t, x, y, row_number() OVER (PARTITION BY rally_index ORDER BY t, pid) AS rn FROM dense
  UNION ALL SELECT 2, rally_index, pid, -t, x, y, row_number() OVER (PARTITION BY rally_index ORDER BY t DESC, pid DESC) FROM dense),
w AS (SELECT dir, rally_index, rn, pid, [{'t': t, 'x': x, 'y': y}] AS path, CAST(NULL AS DOUBLE) AS trust FROM fed WHERE rn = 1
  UNION ALL SELECT dir, rally_index, rn, pid, CASE WHEN far THEN [{'t': t, 'x': x, 'y': y}] WHEN judged < 3e-1 THEN path ELSE list_append(path[-12:], {'t': t, 'x': x, 'y': y}) END, CASE WHEN NOT far THEN judged END
    FROM (SELECT *, CASE WHEN sqrt((x - p.x) * (x - p.x) + (y - p.y) * (y - p.y)) > 10 * dt THEN 5e-2
              ELSE greatest(5e-2, least(95e-2, 95e-2 - 33e-2 * sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) / greatest(2e-2, 3 * usual))) END AS judged
          FROM (SELECT *, CASE WHEN q IS NULL THEN p.x ELSE p.x + (p.x - q.x) * dt / greatest(p.t - q.t, 1e-3) END AS gx, CASE WHEN q IS NULL THEN p.y ELSE p.y + (p.y - q.y) * dt / greatest(p.t - q.t, 1e-3) END AS gy,
                  coalesce(list_sort(steps)[len(steps) // 2 + 1], 2e-2) AS usual
                FROM (SELECT f.*, w.path, w.path[-1] AS p, w.path[-2] AS q, f.t - w.path[-1].t > 1 AS far, greatest(f.t - w.path[-1].t, 1e-3) AS dt,
                        list_transform(range(1, len(w.path)), lambda i: sqrt((w.path[i].x - w.path[i+1].x) * (w.path[i].x - w.path[i+1].x) + (w.path[i].y - w.path[i+1].y) * (w.path[i].y - w.path[i+1].y))) AS steps
                      FROM w JOIN fed f ON f.dir = w.dir AND f.rally_index = w.rally_index AND f.rn = w.rn + 1))))
SELECT rally_index, pid, round(coalesce(max(trust), 6e-1), 3) AS confidence, 'observed' AS provenance FROM w GROUP BY rally_index, pid""")
def measure_confidence(spark, sf):
    return cleaning.measure_confidence(load(spark, sf, "dense"), ["rally_index"], gap=1.0)


@query("hampel", "WIN-10", "rally_index:i pid:i")
def hampel(spark, sf):
    d = load(spark, sf, "dense").withColumn("x", F.when(F.expr("value > 60"), 0.97).otherwise(F.col("x")))
    return cleaning.hampel(d, ["rally_index"], max_residual=0.16)


@query("one_euro", "WIN-14", "rally_index:i pid:i x:d y:d", "WITH RECURSIVE" + _DENSE[4:] + """,
fed AS (SELECT *, row_number() OVER (PARTITION BY rally_index ORDER BY t, pid) AS rn FROM dense WHERE confidence >= 0.15),
w AS (SELECT rally_index, rn, pid, t, x, y, x AS sx, y AS sy, 0e0 AS dx, 0e0 AS dy FROM fed WHERE rn = 1
  UNION ALL SELECT rally_index, rn, pid, t, x, y, CASE WHEN fresh THEN x ELSE sx + (x - sx) / (1 + 1 / (2 * pi() * (1 + 1.5 * abs(ndx))) / dt) END,
      CASE WHEN fresh THEN y ELSE sy + (y - sy) / (1 + 1 / (2 * pi() * (1 + 1.5 * abs(ndy))) / dt) END, CASE WHEN fresh THEN 0 ELSE ndx END, CASE WHEN fresh THEN 0 ELSE ndy END
    FROM (SELECT f.rally_index, f.rn, f.pid, f.t, f.x, f.y, w.sx, w.sy, f.t - w.t AS dt, f.t - w.t > 1.5 OR f.t <= w.t AS fresh,
            w.dx + ((f.x - w.sx) / (f.t - w.t) - w.dx) / (1 + 1 / (2 * pi()) / (f.t - w.t)) AS ndx, w.dy + ((f.y - w.sy) / (f.t - w.t) - w.dy) / (1 + 1 / (2 * pi()) / (f.t - w.t)) AS ndy
          FROM w JOIN fed f ON f.rally_index = w.rally_index AND f.rn = w.rn + 1))
SELECT rally_index, pid, sx AS x, sy AS y FROM w UNION ALL SELECT rally_index, pid, x, y FROM dense WHERE confidence < 0.15""")
def one_euro(spark, sf):
    return sm.one_euro(load(spark, sf, "dense"), ["rally_index"], ["x", "y"])


@query("rolling_extent", "WIN-26", "rally_index:i pid:i x_min:d y_max:d", _DENSE + """
SELECT rally_index, pid, min(x) OVER (PARTITION BY rally_index ORDER BY t, pid ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x_min,
  max(y) OVER (PARTITION BY rally_index ORDER BY t, pid ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS y_max FROM dense""")
def rolling_extent(spark, sf):
    d = sm.rolling_min(load(spark, sf, "dense"), ["rally_index"], "t", "x", 4, tie=["pid"])
    return sm.rolling_max(d, ["rally_index"], "t", "y", 4, tie=["pid"])


def _hann_sql(col: str, win: int) -> str:
    ws = sm.hann_weights(win)
    half = win // 2
    part = "(PARTITION BY rally_index ORDER BY t, pid)"
    terms = []
    for j in range(-half, half + 1):
        if ws[j + half] > 0:
            edge = f"first_value({col}) OVER {part}" if j < 0 else f"last_value({col}) OVER (PARTITION BY rally_index ORDER BY t, pid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            terms.append(f"coalesce({'lag' if j < 0 else 'lead'}({col}, {abs(j)}) OVER {part}, {edge}) * {ws[j + half]!r}::DOUBLE")
    return " + ".join(terms)


@query("hann", "WIN-27", "rally_index:i pid:i x:d", _DENSE + f"""
SELECT rally_index, pid, {_hann_sql('x', 9)} AS x FROM dense""")
def hann(spark, sf):
    return sm.hann(load(spark, sf, "dense"), ["rally_index"], "t", ["x"], 9, tie=["pid"])


@query("ema_and_rate_limit", "WIN-28", "rally_index:i pid:i x_ema:d y_limited:d", "WITH RECURSIVE" + _DENSE[4:] + """,
o AS (SELECT *, row_number() OVER (PARTITION BY rally_index ORDER BY t, pid) AS rn FROM dense),
w AS (SELECT rally_index, rn, pid, x AS e, y AS r FROM o WHERE rn = 1
  UNION ALL SELECT o.rally_index, o.rn, o.pid, w.e + 2e-1 * (o.x - w.e), w.r + greatest(-2e-2, least(2e-2, o.y - w.r)) FROM w JOIN o ON o.rally_index = w.rally_index AND o.rn = w.rn + 1)
SELECT rally_index, pid, e AS x_ema, r AS y_limited FROM w""")
def ema_and_rate_limit(spark, sf):
    d = sm.ema(load(spark, sf, "dense"), ["rally_index"], "t", "x", 0.2)
    return sm.rate_limit(d, ["rally_index"], "t", "y", 0.02)


@query("ramp_and_switch", "WIN-33", "rally_index:i pid:i ramp:d active:i", "WITH RECURSIVE" + _DENSE[4:] + """,
o AS (SELECT *, confidence > 0.5 AS vis, value AS ea, value * 0 + 40 AS eb, row_number() OVER (PARTITION BY rally_index ORDER BY t, pid) AS rn FROM dense),
i AS (SELECT *, CASE WHEN ea >= eb THEN 0 ELSE 1 END AS c0 FROM o WHERE rn = 1),
w AS (SELECT rally_index, rn, pid, 0e0 AS ramp, c0 AS cur, CASE WHEN (CASE WHEN c0 = 0 THEN eb ELSE ea END) > 1.35 * (CASE WHEN c0 = 0 THEN ea ELSE eb END) THEN 1 ELSE 0 END AS run FROM i
  UNION ALL SELECT rally_index, rn, pid, ramp, CASE WHEN run >= 2 THEN 1 - cur ELSE cur END, CASE WHEN run >= 2 THEN 0 ELSE run END FROM
   (SELECT o.rally_index, o.rn, o.pid, CASE WHEN o.vis THEN least(1e0, w.ramp + 12e-2) ELSE greatest(0e0, w.ramp - 12e-2) END AS ramp, w.cur,
     CASE WHEN (CASE WHEN w.cur = 0 THEN eb ELSE ea END) > 1.35 * (CASE WHEN w.cur = 0 THEN ea ELSE eb END) THEN w.run + 1 ELSE 0 END AS run
    FROM w JOIN o ON o.rally_index = w.rally_index AND o.rn = w.rn + 1))
SELECT rally_index, pid, ramp, cur AS active FROM w""")
def ramp_and_switch(spark, sf):
    d = load(spark, sf, "dense").withColumns({"vis": F.col("confidence") > 0.5, "eb": F.lit(40.0)})
    d = sm.ramp(d, ["rally_index"], "t", "vis")
    return sm.switch_active(d, ["rally_index"], "t", "value", "eb", frames=2)
