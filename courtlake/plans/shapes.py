"""Derived inputs several query modules share, in both engines."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.court import with_homography
from .adapters import court_quads, load, table

# One detection per (job, frame, order line); lineitem may repeat a line.
DETS = """dets AS (SELECT job_id, frame_no, okey * 8 + track_id AS det_id, track_id, any_value(t) AS t, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, max(confidence) AS confidence
  FROM boxes GROUP BY job_id, frame_no, okey, track_id)"""


def dets(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    b = load(spark, sf, "boxes", rows).groupBy("job_id", "frame_no", "okey", "track_id").agg(
        F.min("t").alias("t"), *[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.max("confidence").alias("confidence"))
    d = b.withColumn("det_id", F.col("okey") * 8 + F.col("track_id")).drop("okey")
    return d.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "h": F.col("y2") - F.col("y1")})


# One box per (job, frame, player).
PLAYERS = """players AS (SELECT job_id, frame_no, track_id AS player_id, any_value(t) AS t, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, max(confidence) AS confidence FROM boxes GROUP BY 1, 2, 3)"""


def players(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "boxes").groupBy("job_id", "frame_no", F.col("track_id").alias("player_id")).agg(
        F.min("t").alias("t"), *[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.max("confidence").alias("confidence"))


# People with 17 joints from the embedding vectors, one each: job, frame and player follow from the vector's number and are
# its digits, so no two vectors share them; jobs grow in number with the vectors.
PEOPLE = """people0 AS (SELECT vec_id AS row_id, 1 + vec_id % 50 + 50 * (vec_id // 70000) AS job_id, vec_id // 50 % 1400 // 7 AS frame_no, 1 + vec_id // 50 % 7 AS player_id, [cast(v AS DOUBLE) for v in embedding] AS e FROM embeddings),
people AS (SELECT row_id, job_id, frame_no, player_id, frame_no / 6e0 AS t, list_transform(range(17), lambda i: {'x': 5e-1 + e[3*i+1] / 2e0, 'y': 5e-1 + e[3*i+2] / 2e0, 'confidence': least(1e0, abs(e[3*i+3]) * 4e0)}) AS kps
  FROM people0)"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").selectExpr(
        "vec_id as row_id", "1 + vec_id % 50 + 50 * (vec_id div 70000) as job_id", "vec_id div 50 % 1400 div 7 as frame_no", "1 + vec_id div 50 % 7 as player_id", "cast(embedding as array<double>) as e")
    return e.withColumns({"t": F.expr("frame_no / 6e0"), "keypoints": F.expr(
        "transform(sequence(0, 16), i -> named_struct('x', 5e-1 + e[3*i] / 2e0, 'y', 5e-1 + e[3*i+1] / 2e0, 'confidence', least(1e0, abs(e[3*i+2]) * 4e0)))")}).drop("e")


# Projective map of the unit square onto the quad, its inverse, scaled to metres.
COURT_H = """q0 AS (SELECT job_id, ax AS x0, ay AS y0, bx AS x1, by_ AS y1, cx AS x2, cy AS y2, dx AS x3, dy AS y3 FROM courts),
q1 AS (SELECT *, ((x0-x1+x2-x3)*(y3-y2) - (x3-x2)*(y0-y1+y2-y3)) / ((x1-x2)*(y3-y2) - (x3-x2)*(y1-y2)) AS g, ((x1-x2)*(y0-y1+y2-y3) - (x0-x1+x2-x3)*(y1-y2)) / ((x1-x2)*(y3-y2) - (x3-x2)*(y1-y2)) AS k FROM q0),
q2 AS (SELECT *, x1-x0+g*x1 AS a, x3-x0+k*x3 AS b, y1-y0+g*y1 AS d, y3-y0+k*y3 AS e FROM q1),
hom AS (SELECT job_id, 61e-1*(e-y0*k)/(a*e-b*d) AS h0, 61e-1*(x0*k-b)/(a*e-b*d) AS h1, 61e-1*(b*y0-x0*e)/(a*e-b*d) AS h2, 134e-1*(y0*g-d)/(a*e-b*d) AS h3, 134e-1*(a-x0*g)/(a*e-b*d) AS h4, 134e-1*(x0*d-a*y0)/(a*e-b*d) AS h5,
  (d*k-e*g)/(a*e-b*d) AS h6, (b*g-a*k)/(a*e-b*d) AS h7 FROM q2)"""


def courts(spark: SparkSession, sf: str) -> DataFrame:
    return with_homography(court_quads(spark, sf)).select("job_id", "corners", "homography")


POSITIONS = """pos0 AS (SELECT b.job_id, b.player_id, b.t, coalesce(a.ax, (b.x1 + b.x2) / 2) AS x, coalesce(a.ay, b.y2) AS y, a.ax IS NOT NULL AS ank FROM players b
  LEFT JOIN (SELECT job_id, player_id, frame_no, (kps[16].x + kps[17].x) / 2 AS ax, (kps[16].y + kps[17].y) / 2 AS ay FROM people WHERE kps[16].confidence >= 15e-2 AND kps[17].confidence >= 15e-2) a
    ON a.job_id = b.job_id AND a.player_id = b.player_id AND a.frame_no = b.frame_no),
positions AS (SELECT job_id, player_id, t, (h0*x + h1*y + h2) / (h6*x + h7*y + 1) AS x_m, (h3*x + h4*y + h5) / (h6*x + h7*y + 1) AS y_m, CASE WHEN ank THEN 'ankles' ELSE 'box_foot' END AS src FROM pos0 JOIN hom USING (job_id))"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.court import court_positions

    return court_positions(players(spark, sf), people(spark, sf), courts(spark, sf), ["job_id"])


def inside_sql(expand: str, pad: str, x: str, y: str) -> str:
    """Cross-product sign test against the expanded court (corners already form a ring)."""
    mx, my = "((ax+bx+cx+dx)/4)", "((ay+by_+cy+dy)/4)"
    pts = []
    for px, py in (("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy")):
        r = f"sqrt(({px}-{mx})*({px}-{mx})+({py}-{my})*({py}-{my}))"
        pts.append((f"({mx}+({px}-{mx})*{expand}+({px}-{mx})/{r}*{pad})", f"({my}+({py}-{my})*{expand}+({py}-{my})/{r}*{pad})"))
    cross = [f"(({b[0]}-{a[0]})*({y}-{a[1]})-({b[1]}-{a[1]})*({x}-{a[0]}))" for a, b in zip(pts, pts[1:] + pts[:1])]
    return f"(({' AND '.join(c + ' > -1e-12' for c in cross)}) OR ({' AND '.join(c + ' < 1e-12' for c in cross)}))"
