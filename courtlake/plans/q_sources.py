"""Queries that go through the readers and writers."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import camera, smoothing as sm, store
from ..operators.segments import flight_segments
from ..operators.tiles import by_size, shared
from ..session import scratch_dir, stored_rows
from ..sources import detections, results, tables
from ..operators import report
from .adapters import ctes, load, table
from .q_quality import PCM, SHOT, hits as gated_hits, pcm
from .registry import query

_PAYLOAD = """
  case pid % 4
   when 0 then '{"rallies":[{"rally_index":1,"frames":[{"t":' || tt || ',"players":[{"box":[' || x || ',' || y || ',1,1],"confidence":' || confidence || ',"track_id":' || track_id || '}],"shuttle":{"x":' || x || ',"y":' || y || ',"confidence":' || confidence || '}}]}]}'
   when 1 then '{"results":[{"timeline":[{"time":' || tt || ',"player_boxes":[{"x1":1,"y1":1,"x2":' || x || ',"y2":' || y || ',"conf":' || confidence || '}],"shuttle_x":' || x || ',"shuttle_y":' || y || ',"shuttle_conf":"' || confidence || '"}]}]}'
   when 2 then '{"clips":[{"index":9},{"index":1,"shuttle":[[' || x || ',' || y || ']],"players":[{"sec":' || tt || ',"detections":[{"x":' || x || ',"y":' || y || ',"w":0.5,"h":0.25}]}]}]}'
   else '{"rallies":[{"frames":[{"t":"bad","people":[{"x":"oops"}],"poses":' || case when pid % 8 = 7 then '[{"x":' || x || ',"y":' || y || ',"conf":' || confidence || '},{"x":0.5,"y":0.25}]' else '[{"keypoints":[[' || x || ',' || y || ',' || confidence || '],{"x":0.5,"y":0.25}]}]' end || ',"racquets":[[' || x || ',' || y || ',0.9,0.9,' || confidence || ']],"racket_candidates":[[0.1,0.1,0.2,0.2,0.01]]}' end"""
_PAYLOAD = _PAYLOAD.replace("0.2,0.01]]}' end", "0.2,0.01]]}]}]}' end")


def canonical(spark, sf):
    p = load(spark, sf, "pts").withColumn("tt", F.expr("pid % 8"))
    raw = p.selectExpr("pid as job_id", f"{_PAYLOAD} as payload")
    rallies = p.selectExpr("pid as job_id", "cast(1 as bigint) as rally_index", "20e0 as start_s", "6e0 as dur")
    return detections.canonicalize_detections(raw, rallies)


@query("canonical_shuttle", "SRC-2 PRJ-5 JOIN-1 SET-2", "job_id:i rally_index:i t:d x:d y:d confidence:d", ctes("pts") + """
SELECT pid AS job_id, 1 AS rally_index, CASE WHEN pid % 4 = 2 THEN 20 ELSE 20 + pid % 8 END AS t, x, y, CASE WHEN pid % 4 = 2 THEN 1 ELSE confidence END AS confidence FROM pts WHERE pid % 4 < 3""")
def canonical_shuttle(spark, sf):
    return canonical(spark, sf)["shuttle_points"]


@query("canonical_boxes", "SRC-2 FN-7", "job_id:i t:d x1:d y1:d x2:d y2:d confidence:d track_id:i", ctes("pts") + """
SELECT pid AS job_id, 20 + pid % 8 AS t, x AS x1, y AS y1, CASE WHEN pid % 4 = 2 THEN least(1, x + 5e-1) ELSE 1 END AS x2, CASE WHEN pid % 4 = 2 THEN least(1, y + 25e-2) ELSE 1 END AS y2, CASE WHEN pid % 4 = 2 THEN 1 ELSE confidence END AS confidence,
  CASE WHEN pid % 4 = 0 THEN track_id END AS track_id FROM pts WHERE pid % 4 = 2 OR (pid % 4 < 2 AND confidence >= 5e-2)""".replace("\n  CASE", " CASE"))
def canonical_boxes(spark, sf):
    return canonical(spark, sf)["player_boxes"]


@query("canonical_people", "SRC-2", "job_id:i t:d n:i confidence:d x0:d racquet:b", ctes("pts") + """
SELECT pid AS job_id, 20 AS t, 2 AS n, (confidence + 1) / 2 AS confidence, x AS x0, confidence >= 5e-2 AS racquet FROM pts WHERE pid % 4 = 3""")
def canonical_people(spark, sf):
    c = canonical(spark, sf)
    r = c["racquet_boxes"].groupBy("job_id").agg(F.lit(True).alias("racquet"))
    return c["people"].join(r, "job_id", "left").select("job_id", "t", F.size("keypoints").alias("n"), "confidence", F.get("keypoints", F.lit(0))["x"].alias("x0"), F.coalesce("racquet", F.lit(False)).alias("racquet"))


@query("read_rallies", "SRC-3 FN-5 FN-13 WIN-1", "job_id:i start_s:d end_s:d intensity:i note:s dur:d", ctes("rallies") + """,
k AS (SELECT rally_id AS job_id, start_s, least(3600, floor(end_s)) AS end_s, intensity, note FROM rallies)
SELECT job_id, start_s, end_s, intensity, note, end_s - start_s AS dur FROM k WHERE end_s - start_s >= 3""")
def read_rallies(spark, sf):
    clock = "concat(cast({0} as bigint) div 60, ':', lpad(cast({0} as bigint) % 60, 2, '0'))"
    r = load(spark, sf, "rallies")
    one = f"concat('{{\"start\":\"', {clock.format('start_s')}, '\",\"end\":\"', {clock.format('end_s')}, '\",\"intensity\":', intensity, ',\"note\":\"', note, '\"}}')"
    raw = r.selectExpr("rally_id as job_id", f"concat('```json\n{{\"sport\":\"badminton\",\"rallies\":[', {one}, ',{{\"start\":\"x\",\"end\":\"1:00\"}}]}}\n```') as response".replace("{{", "{").replace("}}", "}"))
    return tables.read_rallies(raw, raw.select("job_id", F.lit(3600.0).alias("duration")))


@query("read_shuttle_csv", "SRC-4", "clip_id:i t:d x:d y:d confidence:d source:s", ctes("pts") + """
SELECT track_id AS clip_id, 10e0 * track_id + floor(t) / 25e0 AS t, least(1, floor(x * 1000) / 1279e0) AS x, least(1, floor(y * 700) / 719e0) AS y, 82e-2 AS confidence, 'tracknetv3' AS source FROM pts WHERE visible""")
def read_shuttle_csv(spark, sf):
    path = scratch_dir(spark, "csv") + "/tracks"
    p = load(spark, sf, "pts")
    p.selectExpr("cast(floor(t) as string) as Frame", "if(visible, '1', '0') as Visibility", "cast(floor(x * 1000) as string) as X", "cast(floor(y * 700) as string) as Y", "track_id as clip_id").repartition("clip_id").write.option(
        "header", True).csv(path)      # a folder a clip would be as many files as clips
    meta = p.select("track_id").distinct().selectExpr("track_id as clip_id", "10e0 * track_id as start_s", "25e0 as fps", "1279 as width", "719 as height")
    return tables.read_shuttle_csv(spark, path, meta)


@query("track_tables", "SRC-9", "job_id:i pid:i t:d x:d", ctes("pts") + """
SELECT job_id, pid, t, x FROM pts""")
def track_tables(spark, sf):
    path = scratch_dir(spark, "tracks") + "/pts"
    tables.save_tracks(load(spark, sf, "pts"), path, 8)
    return tables.load_tracks(spark, path)


@query("read_pcm_chunks", "SRC-10 AGG-19", "job_id:i i:i s:d", ctes("pts") + f""",
{PCM}
SELECT job_id, i, s FROM pcm""")
def read_pcm(spark, sf):
    path = scratch_dir(spark, "pcm") + "/chunks"
    d = pcm(spark, sf).withColumns({"chunk_no": F.floor(F.col("i") / 64), "v": (F.col("s") * 32768).cast("short")})
    d.groupBy("job_id", "chunk_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("samples")).write.parquet(path)   # 64 samples a chunk
    return tables.pcm_samples(tables.read_pcm_chunks(spark, path), 64)


def documents(spark, sf):
    """One result document per rally of the orders table, its flight from the order's lines."""
    s = load(spark, sf, "samples").groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct(      # an order's lines
        "t", (F.col("x") / 10).alias("x"), (F.col("z") / 10 + 0.1).alias("y"), (F.col("pkey") % 100 / 100.0).alias("confidence"), F.lit("tracknetv3").alias("source")))).alias("pts"))
    r = load(spark, sf, "rallies").join(s, F.col("rally_id") == F.col("shot_id"), "left")
    vision = F.struct(F.lit("ok").alias("status"), F.lit(0.5).alias("shuttle_quality"), F.col("pts").alias("shuttle"))
    rally = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "dur", "intensity", "note", vision.alias("vision"))
    plain = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "dur", "intensity", "note")
    return r.select(F.col("rally_id").cast("string").alias("job_id"), F.lit("badminton").alias("sport"), F.lit(3600.0).alias("duration"), F.array(plain).alias("all_rallies"), F.array(rally).alias("rallies"))


@query("read_results", "SRC-1", "job_id:i rally_index:i points:i first_t:d start_s:d", ctes("rallies", "samples") + """,
s AS (SELECT shot_id, count(*) AS n, min(t) AS t FROM samples GROUP BY 1)
SELECT rally_id AS job_id, 0 AS rally_index, coalesce(n, 0) AS points, t AS first_t, start_s FROM rallies LEFT JOIN s ON shot_id = rally_id""")
def read_results(spark, sf):
    path = scratch_dir(spark, "results") + "/docs"
    documents(spark, sf).write.json(path)
    t = results.read_results(spark, path)
    pts = t["shuttle_points"].groupBy("job_id", "rally_index").agg(F.count("*").alias("points"), F.min("t").alias("first_t"))
    d = t["rallies"].join(pts, ["job_id", "rally_index"], "left")
    return d.select("job_id", "rally_index", F.coalesce("points", F.lit(0)).alias("points"), "first_t", "start_s")


@query("read_bench", "SRC-7", "clip:s shuttle_labels:i shots:i points:i", ctes("rallies", "samples") + """,
s AS (SELECT shot_id, count(*) AS n FROM samples GROUP BY 1)
SELECT 'clip' || rally_id AS clip, CASE WHEN rally_id % 3 = 0 THEN 1 ELSE 0 END AS shuttle_labels, CASE WHEN rally_id % 3 = 1 THEN 1 ELSE 0 END AS shots, coalesce(n, 0) AS points FROM rallies LEFT JOIN s ON shot_id = rally_id WHERE intensity > 1""")
def read_bench(spark, sf):
    root = scratch_dir(spark, "bench")
    r = load(spark, sf, "rallies")
    documents(spark, sf).write.json(f"{root}/results")
    r.filter("intensity > 1").selectExpr("'clip' || rally_id as name", "cast(rally_id as string) as result", "'l' || rally_id as labels").write.json(f"{root}/manifest")
    lab = F.struct(F.lit(0).alias("rally"), F.when(F.expr("rally_id % 3 = 0"), F.array(F.struct(F.lit(1.0).alias("t"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y")))).alias("shuttle"),
                   F.when(F.expr("rally_id % 3 = 1"), F.array(F.struct(F.lit(1.0).alias("t_hit"), F.lit(90.0).alias("speed_kmh")))).alias("shots3d"))
    r.select(F.concat(F.lit("l"), "rally_id").alias("clip"), F.array(lab).alias("rallies")).write.json(f"{root}/labels")
    b = results.read_bench(spark, f"{root}/manifest", f"{root}/results", f"{root}/labels")
    counts = [(b["labels"]["shuttle"], "clip", "shuttle_labels"), (b["labels"]["shots3d"], "clip", "shots"), (b["results"]["shuttle_points"], "job_id", "points")]
    d = b["labels"]["rallies"].select("clip")
    for t, k, n in counts:
        d = d.join(t.groupBy(F.col(k).alias("clip")).agg(F.count("*").alias(n)), "clip", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return d


@query("match_reports", "SRC-8 WIN-4 JOIN-5 WIN-41", "job_id:i rally_index:i schema_tag:s flights:i in_play:i peaks:i hits:i fastest:d", ctes("rallies", "peaks", "samples") + f""",
{SHOT},
hit AS (SELECT shot_id, count(*) AS hits, max(speed_kmh) AS fastest FROM gated WHERE gate IS NULL GROUP BY 1),
a AS (SELECT shot_id, x / 10 AS x, z / 10 + 1e-1 AS y, t FROM samples WHERE (pkey % 100 / 100e0) >= 3e-1),
b AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS hop FROM a WINDOW w AS (PARTITION BY shot_id ORDER BY t, x, y)),
c AS (SELECT *, sum(CASE WHEN dt > 25e-2 THEN 1 ELSE 0 END) OVER (PARTITION BY shot_id ORDER BY t, x, y ROWS UNBOUNDED PRECEDING) AS seg FROM b),
d AS (SELECT shot_id, seg, count(*) AS n, max(t) - min(t) AS len, list_sort(list(hop / dt) FILTER (dt > 1e-3 AND dt <= 25e-2))[count(*) FILTER (dt > 1e-3 AND dt <= 25e-2) // 2 + 1] AS med FROM c GROUP BY 1, 2),
f AS (SELECT shot_id, count(*) AS flights, count(*) FILTER (med >= 15e-2 AND len >= 4e-1) AS in_play FROM d WHERE n >= 3 AND med IS NOT NULL GROUP BY 1),
p AS (SELECT r.rally_id, count(*) AS peaks FROM rallies r JOIN peaks k ON k.job_id = r.job_id AND k.t BETWEEN r.start_s - 1 AND r.end_s + 1 GROUP BY 1)
SELECT r.rally_id AS job_id, 0 AS rally_index, 'v2' AS schema_tag, coalesce(flights, 0) AS flights, coalesce(in_play, 0) AS in_play, coalesce(peaks, 0) AS peaks, coalesce(hits, 0) AS hits, fastest FROM rallies r LEFT JOIN f ON f.shot_id = r.rally_id LEFT JOIN p USING (rally_id) LEFT JOIN hit ON hit.shot_id = r.rally_id""")
def match_reports(spark, sf):
    from ..operators.intervals import events_in

    root = scratch_dir(spark, "reports")
    r = load(spark, sf, "rallies")
    # order lines travel before samples are made of them, to their order for flights and to their shot for hits; an order is a rally
    tracks = by_size(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    pts = [load(spark, sf, "samples", li, ("shot_id", "pkey", "t", "x", "z")).selectExpr("shot_id as job_id", "t", "x / 10 as x", "z / 10 + 1e-1 as y", "pkey % 100 / 100e0 as confidence") for li in tracks if li is not None]
    fl = reduce(DataFrame.unionByName, [flight_segments(p, ["job_id"], tie=["x", "y"], small=p is pts[0]) for p in pts]).withColumn("rally_index", F.lit(0))
    pk = events_in(r.select("job_id", "rally_id", "start_s", "end_s"), load(spark, sf, "peaks"), pad=1.0).selectExpr("rally_id as job_id", "0 as rally_index", "t", "prominence_db")
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    hits = gated_hits(spark, sf, shared(lines, ["l_suppkey", "l_orderkey"], lines.count())).selectExpr("shot_id as job_id", "0 as rally_index", "t", "speed_kmh", "speed_at_net_kmh")
    rows = r.selectExpr("rally_id as job_id", "0 as rally_index", "start_s", "end_s", "dur", "intensity")
    doc = stored_rows(report.rally_report(rows, fl, hits, pk), "reports")           # written three times below
    tables.write_reports(doc, f"{root}/out", "v1", buckets=8, compression="gzip")                       # a first version, stale below
    tables.write_reports(doc.filter("intensity < 4"), f"{root}/out", "v2", buckets=8, compression="gzip")
    tables.write_reports(doc, f"{root}/out", "v2", buckets=8, compression="gzip")                       # adds only the missing ones
    out = spark.read.schema(doc.withColumn("schema_tag", F.lit("")).schema).json(f"{root}/out")
    n = {c: F.coalesce(F.when(F.col(s).isNotNull(), F.size(s)), F.lit(0)) for c, s in (("flights", "shuttle_flight"), ("peaks", "audio_peaks"), ("hits", "hits"))}
    return out.select("job_id", "rally_index", "schema_tag", n["flights"].alias("flights"), F.coalesce(F.when(F.col("in_play").isNotNull(), F.size("in_play")), F.lit(0)).alias("in_play"), n["peaks"].alias("peaks"), n["hits"].alias("hits"), F.array_max(F.transform("hits", lambda h: h["speed_kmh"])).alias("fastest"))


@query("public_view_light", "PRJ-8", "job_id:i rally_index:i dur:d", ctes("rallies") + """
SELECT rally_id AS job_id, 0 AS rally_index, dur FROM rallies""")
def public_light(spark, sf):
    from ..operators.thinning import public_view

    d = documents(spark, sf).select(F.col("job_id").cast("long").alias("job_id"), F.posexplode("rallies").alias("rally_index", "r")).select("job_id", "rally_index", "r.dur", "r.vision.shuttle")
    return public_view(d, light=True)


@query("union_sources", "SET-2", "job_id:i pid:i src:s", ctes("pts") + """
SELECT job_id, pid, 'frame' AS src FROM pts WHERE visible UNION ALL SELECT job_id, pid, 'track' FROM pts""")
def union_sources(spark, sf):
    p = load(spark, sf, "pts")
    return store.union_sources(p.filter("visible").select("job_id", "pid", F.lit("frame").alias("src")), p.select("job_id", "pid", F.lit("track").alias("src")))


# -- camera -------------------------------------------------------------------------------------
PICKS = "picks AS (SELECT conv_id AS job_id, list(cast((turn * 5 + conv_id) % 7 AS BIGINT) ORDER BY turn) AS picks, cast(count(*) + 2 AS BIGINT) AS pool_size FROM conversations GROUP BY 1)"


def picks(spark, sf):
    t = load(spark, sf, "texts").groupBy(F.col("conv_id").alias("job_id")).agg(       # a conversation's turns
        F.transform(F.sort_array(F.collect_list(F.struct("turn", F.expr("cast((turn * 5 + conv_id) % 7 as bigint)").alias("p")))), lambda s: s["p"]).alias("picks"), (F.count("*") + 2).alias("pool_size"))
    return t


@query("valid_order", "PRJ-12", "job_id:i is_valid:b", "WITH " + PICKS + """
SELECT job_id, len(picks) = len(list_distinct(picks)) AND list_min(picks) >= 1 AND list_max(picks) <= pool_size AS is_valid FROM picks""")
def valid_order(spark, sf):
    return camera.valid_order(picks(spark, sf))


@query("pick_in_order", "JOIN-22", "job_id:i pos:i rally_index:i rally_id:i", ctes("rallies") + f""",
{PICKS},
pool AS (SELECT job_id, rally_id, row_number() OVER (PARTITION BY job_id ORDER BY start_s, rally_id) AS rally_index FROM rallies),
w AS (SELECT job_id, unnest(range(len(picks))) AS pos, unnest(picks) AS rally_index FROM picks)
SELECT w.job_id, w.pos, w.rally_index, pool.rally_id FROM w JOIN pool USING (job_id, rally_index)""")
def pick_in_order(spark, sf):
    from ..operators.tiles import row_index

    pool = row_index(load(spark, sf, "rallies"), ["job_id"], "start_s", tie=["rally_id"], out="rally_index").withColumn("rally_index", F.col("rally_index") + 1)
    return camera.pick_in_order(pool.select("job_id", "rally_index", "rally_id"), picks(spark, sf))


@query("clean_camera_plan", "PRJ-11", "pid:i n:i target:s zoom:d py:d", ctes("pts") + """
SELECT pid, 1 AS n, CASE WHEN kind = 'view' THEN 'player' WHEN kind = 'click' THEN 'point' ELSE 'shuttle' END AS target, CASE WHEN pid % 3 = 0 THEN 14e-1 ELSE value END AS zoom, CASE WHEN kind = 'click' THEN 45e-2 END AS py FROM pts WHERE visible AND pid % 5 > 0""")
def clean_plan(spark, sf):
    raw = ("from_json('{\"enabled\":' || visible || ',\"keyframes\":[{\"t\":' || if(pid % 5 = 0, '\"soon\"', cast(t as string)) || ',\"target\":\"' || case kind when 'view' then 'player' when 'click' then 'point' else 'moon' end || '\"'"
           " || if(pid % 3 = 0, '', ',\"zoom\":' || value) || if(kind = 'click', ',\"point\":{\"x\":\"0.3\",\"y\":\"?\"}', '') || '}]}', 'enabled boolean, keyframes array<struct<t:string,target:string,targetPlayer:string,target_player:string,zoom:string,point:struct<x:string,y:string>>>') as plan")
    d = camera.clean_camera_plan(load(spark, sf, "pts").selectExpr("pid", raw)).withColumn("k", F.get("keyframes", F.lit(0)))
    return d.select("pid", F.size("keyframes").alias("n"), "k.target", "k.zoom", F.col("k.point.y").alias("py"))


@query("order_clips", "WIN-39", "job_id:i rally_id:i pos:i order_source:s", ctes("rallies") + """,
c AS (SELECT *, CASE WHEN job_id % 3 = 0 AND intensity = 1 THEN NULL WHEN job_id % 3 = 1 THEN start_s ELSE price END AS rec FROM rallies),
v AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, count(rec) OVER (PARTITION BY job_id) AS h, count(DISTINCT rec) OVER (PARTITION BY job_id) AS d FROM c)
SELECT job_id, rally_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN n = h AND n = d THEN rec END, rally_id) - 1 AS pos, CASE WHEN n = h AND n = d THEN 'recording time' ELSE 'upload order' END AS order_source FROM v""")
def order_clips(spark, sf):
    c = load(spark, sf, "rallies").withColumns({"recorded_at": F.expr("case when job_id % 3 = 0 and intensity = 1 then null when job_id % 3 = 1 then start_s else price end"), "upload_no": F.col("rally_id")})
    return camera.order_clips(c)


@query("static_framing", "AGG-30", "rally_index:i x:d y:d z:d", ctes("dense") + """
SELECT rally_index, median(x) AS x, median(y) AS y, 1 AS z FROM dense GROUP BY 1""")
def static_framing(spark, sf):
    return camera.static_framing(load(spark, sf, "dense"), ["rally_index"])


def camera_grid(spark, sf):
    """A frame per point: shuttle where confident, a near player always, a far one sometimes."""
    d = load(spark, sf, "dense")
    return d.selectExpr("rally_index", "frame_no", "t", "case when confidence >= 4e-1 then x end as shu_x", "case when confidence >= 4e-1 then y end as shu_y", "case when pid % 5 > 0 then x + 1e-1 end as near_x", "case when pid % 5 > 0 then y + 2e-1 end as near_y",
                        "case when pid % 3 = 0 then x - 1e-1 end as far_x", "case when pid % 3 = 0 then y - 1e-1 end as far_y", "kind", "value")


def _hann15(col):
    ws = sm.hann_weights(15)
    part = "(PARTITION BY rally_index ORDER BY frame_no)"
    full = "(PARTITION BY rally_index ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return " + ".join(f"coalesce({'lag' if j < 0 else 'lead'}({col}, {abs(j)}) OVER {part}, {'first' if j < 0 else 'last'}_value({col}) OVER {full}) * {ws[j + 7]!r}::DOUBLE" for j in range(-7, 8) if ws[j + 7] > 0)


CW = "316406250e-9"
GRID = "grid AS (SELECT rally_index, frame_no, t, CASE WHEN confidence >= 4e-1 THEN x END AS shu_x, CASE WHEN confidence >= 4e-1 THEN y END AS shu_y, CASE WHEN pid % 5 > 0 THEN x + 1e-1 END AS near_x, CASE WHEN pid % 5 > 0 THEN y + 2e-1 END AS near_y, CASE WHEN pid % 3 = 0 THEN x - 1e-1 END AS far_x, CASE WHEN pid % 3 = 0 THEN y - 1e-1 END AS far_y, kind, value FROM dense)"


@query("eval_camera_plan", "WIN-30 WIN-27", "rally_index:i frame_no:i x:d y:d z:d", ctes("dense") + f""",
{GRID},
kf AS (SELECT rally_index, t + 1e-3 AS t, frame_no AS kf_id, CASE WHEN kind = 'view' THEN 'player' WHEN kind = 'error' THEN 'point' ELSE 'shuttle' END AS target, frame_no % 2 AS tp, 5e-1 AS px, 4e-1 AS py, 1 + value / 100 AS zoom FROM grid WHERE value > 40),
i AS (SELECT g.*, (SELECT max(k.t) FROM kf k WHERE k.rally_index = g.rally_index AND k.t <= g.t) AS ta0, (SELECT min(k.t) FROM kf k WHERE k.rally_index = g.rally_index AND k.t > g.t) AS tb FROM grid g),
a AS (SELECT i.*, ta0 IS NOT NULL AS started, k.target, k.tp, k.px, k.py, k.zoom AS za, b.zoom AS zb, k.t AS ta FROM i JOIN kf k ON k.rally_index = i.rally_index AND k.t = coalesce(ta0, tb) LEFT JOIN kf b ON b.rally_index = i.rally_index AND b.t = tb),
z AS (SELECT *, greatest(1, least(25e-1, CASE WHEN started AND tb > ta THEN za + (zb - za) * greatest(0, least(1, (t - ta) / (tb - ta))) ELSE za END)) AS z0,
  CASE target WHEN 'point' THEN px WHEN 'player' THEN CASE WHEN tp = 1 THEN coalesce(far_x, near_x) ELSE coalesce(near_x, far_x) END ELSE shu_x END AS cx, CASE target WHEN 'point' THEN py WHEN 'player' THEN CASE WHEN tp = 1 THEN coalesce(far_y, near_y) ELSE coalesce(near_y, far_y) END ELSE shu_y END AS cy FROM a),
h AS (SELECT *, coalesce(last_value(cx IGNORE NULLS) OVER w, 5e-1) AS hx, coalesce(last_value(cy IGNORE NULLS) OVER w, 55e-2) AS hy FROM z WINDOW w AS (PARTITION BY rally_index ORDER BY frame_no ROWS UNBOUNDED PRECEDING)),
c AS (SELECT rally_index, frame_no, greatest({CW} / (2 * z0), least(1 - {CW} / (2 * z0), hx)) AS x, greatest(1 / (2 * z0), least(1 - 1 / (2 * z0), hy)) AS y, z0 AS z FROM h),
s AS (SELECT rally_index, frame_no, {_hann15('x')} AS x, {_hann15('y')} AS y, {_hann15('z')} AS z FROM c)
SELECT rally_index, frame_no, greatest({CW} / (2 * z), least(1 - {CW} / (2 * z), x)) AS x, greatest(1 / (2 * z), least(1 - 1 / (2 * z), y)) AS y, z FROM s""")
def eval_camera_plan(spark, sf):
    g = camera_grid(spark, sf)
    kf = g.filter("value > 40").selectExpr("rally_index", "t + 1e-3 as t", "frame_no as kf_id", "case when kind = 'view' then 'player' when kind = 'error' then 'point' else 'shuttle' end as target", "frame_no % 2 as target_player", "5e-1 as px", "4e-1 as py", "1 + value / 100 as zoom")
    return camera.eval_camera_plan(g.drop("kind", "value"), kf, ["rally_index"])


def follow_inputs(spark, sf):
    g = camera_grid(spark, sf).selectExpr("rally_index", "frame_no", "shu_x", "shu_y", "near_x as near_cx", "near_y as near_cy", "if(near_x is null, null, 5e-2) as near_hw", "if(near_x is null, null, 12e-2) as near_hh",
                                          "far_x as far_cx", "far_y as far_cy", "if(far_x is null, null, 3e-2) as far_hw", "if(far_x is null, null, 8e-2) as far_hh")
    r = g.select("rally_index").distinct().selectExpr("rally_index", "(rally_index * 13 % 50) / 100e0 as player_quality", "(rally_index * 7 % 50) / 100e0 as shuttle_quality", "14e-1 + rally_index % 8 / 10e0 as z_rally", "2e-1 as band_lo")
    return g, r


@query("follow_targets", "WIN-31 AGG-21 WIN-29 WIN-27", "rally_index:i frame_no:i x:d y:d z:d")
def follow_targets(spark, sf):
    return camera.follow_targets(*follow_inputs(spark, sf), ["rally_index"])


@query("contain", "WIN-32", "rally_index:i frame_no:i x:d y:d z:d")
def contain(spark, sf):
    g, _ = follow_inputs(spark, sf)
    return sm.contain(g.withColumns({"x": F.lit(0.5), "y": F.lit(0.55), "z": F.lit(1.8)}), ["rally_index"], 0.31640625, 1.0)


