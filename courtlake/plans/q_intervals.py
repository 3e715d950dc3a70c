"""Queries over rally intervals."""
from pyspark.sql import functions as F

from ..operators import intervals as iv
from .adapters import ctes, game_durations, load
from .registry import query

# Rallies a job put in its reel: the three longest.
_REEL = """reel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY dur DESC, rally_id) rn FROM rallies) WHERE rn <= 3)"""


def reel(spark, sf):
    from ..operators.tiles import top_n

    return top_n(load(spark, sf, "rallies"), ["job_id"], [F.desc("dur"), F.asc("rally_id")], 3).drop("rn")


@query("merge_overlaps", "WIN-1", "job_id:i start_s:d end_s:d intensity:i note:s dur:d", ctes("rallies") + """,
f AS (SELECT *, CASE WHEN start_s >= max(end_s) OVER w - 0.5 THEN 1 ELSE 0 END AS brk FROM rallies
      WINDOW w AS (PARTITION BY job_id ORDER BY start_s, rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY start_s, rally_id) AS isl FROM f)
SELECT job_id, min(start_s) AS start_s, max(end_s) AS end_s, max(intensity) AS intensity, arg_min(note, (start_s, rally_id)) AS note,
  max(end_s) - min(start_s) AS dur FROM g GROUP BY job_id, isl""")
def merge_overlaps(spark, sf):
    return iv.merge_overlaps(load(spark, sf, "rallies"), tie=("rally_id",))


@query("clean_rallies", "SRC-3 WIN-1", "job_id:i start_s:d end_s:d intensity:i note:s dur:d", ctes("rallies") + """,
c AS (SELECT job_id, rally_id, greatest(0, start_s) AS start_s, least(3600, end_s) AS end_s, intensity, note FROM rallies),
k AS (SELECT * FROM c WHERE end_s - start_s >= 3.0),
f AS (SELECT *, CASE WHEN start_s >= max(end_s) OVER w - 0.5 THEN 1 ELSE 0 END AS brk FROM k
      WINDOW w AS (PARTITION BY job_id ORDER BY start_s, rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY start_s, rally_id) AS isl FROM f)
SELECT job_id, min(start_s) AS start_s, max(end_s) AS end_s, max(intensity) AS intensity, arg_min(note, (start_s, rally_id)) AS note,
  max(end_s) - min(start_s) AS dur FROM g GROUP BY job_id, isl""")
def clean_rallies(spark, sf):
    return iv.clean_rallies(load(spark, sf, "rallies"), game_durations(spark, sf), tie=("rally_id",))


@query("trim_list", "WIN-2", "job_id:i start_s:d end_s:d", ctes("rallies") + """,
p AS (SELECT job_id, greatest(0, start_s - 0.4::DOUBLE) AS s, least(3600, end_s + 0.4::DOUBLE) AS e FROM rallies),
f AS (SELECT *, CASE WHEN s > max(e) OVER w + 0.2::DOUBLE THEN 1 ELSE 0 END AS brk FROM p
      WINDOW w AS (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM f)
SELECT job_id, min(s) AS start_s, max(e) AS end_s FROM g GROUP BY job_id, isl HAVING max(e) - min(s) >= 1.0""")
def trim_list(spark, sf):
    return iv.trim_list(load(spark, sf, "rallies"), game_durations(spark, sf))


_TIMELINE = ctes("rallies") + f""",
{_REEL},
g AS (SELECT r.*, greatest(coalesce(max(end_s) OVER w, 0), 0) AS cur FROM rallies r
      WINDOW w AS (PARTITION BY job_id ORDER BY start_s, rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
keys AS (SELECT DISTINCT job_id, round(start_s, 2) AS k FROM reel),
tl AS (
  SELECT g.job_id, 'rally' AS kind, start_s, end_s, end_s - start_s AS dur, intensity, note, keys.k IS NOT NULL AS in_reel
    FROM g LEFT JOIN keys ON keys.job_id = g.job_id AND keys.k = round(start_s, 2)
  UNION ALL SELECT job_id, 'no_play', cur, start_s, start_s - cur, NULL, NULL, NULL FROM g WHERE start_s - cur >= 1.0
  UNION ALL SELECT job_id, 'no_play', max(end_s), 3600, 3600 - max(end_s), NULL, NULL, NULL FROM g GROUP BY job_id HAVING 3600 - max(end_s) >= 1.0)"""


@query("timeline", "WIN-5 SET-1", "job_id:i kind:s start_s:d end_s:d dur:d intensity:i note:s in_reel:b", _TIMELINE + """
SELECT * FROM tl""")
def timeline(spark, sf):
    return iv.timeline(load(spark, sf, "rallies"), reel(spark, sf), game_durations(spark, sf))


@query("timeline_shares", "AGG-32", "job_id:i kind:s total_s:d share:d segments:i", _TIMELINE + """
SELECT job_id, kind, sum(dur) AS total_s, sum(dur / 3600) AS share, count(*) AS segments FROM tl GROUP BY job_id, kind""")
def timeline_shares(spark, sf):
    d = game_durations(spark, sf)
    tl = iv.timeline(load(spark, sf, "rallies"), reel(spark, sf), d)
    return iv.timeline_shares(tl, d).groupBy("job_id", "kind").agg(F.sum("dur").alias("total_s"), F.sum("share").alias("share"), F.count("*").alias("segments"))


@query("peaks_in_rallies", "JOIN-5", "job_id:i rally_id:i peak_id:i t:d", ctes("rallies", "peaks") + """
SELECT r.job_id, r.rally_id, p.peak_id, p.t FROM rallies r JOIN peaks p ON p.job_id = r.job_id AND p.t BETWEEN r.start_s - 1.0 AND r.end_s + 1.0""")
def peaks_in_rallies(spark, sf):
    return iv.events_in(load(spark, sf, "rallies"), load(spark, sf, "peaks"), pad=1.0)


@query("mark_selected", "JOIN-16", "job_id:i rally_id:i used:b in_reel:b", ctes("rallies") + f""",
{_REEL},
sel AS (SELECT job_id, start_s + (rally_id % 5) / 5e0 AS s FROM reel)
SELECT r.job_id, r.rally_id, EXISTS (SELECT 1 FROM sel WHERE sel.job_id = r.job_id AND abs(sel.s - r.start_s) < 0.5) AS used,
  EXISTS (SELECT 1 FROM sel WHERE sel.job_id = r.job_id AND round(sel.s, 2) = round(r.start_s, 2)) AS in_reel FROM rallies r""")
def mark_selected(spark, sf):
    sel = reel(spark, sf).withColumn("start_s", F.expr("start_s + (rally_id % 5) / 5e0"))
    return iv.mark_selected(load(spark, sf, "rallies"), sel)


@query("refine_with_audio", "WIN-13", "job_id:i start_s:d end_s:d note:s audio_hits:i", ctes("rallies", "peaks") + """,
r5 AS (SELECT job_id // 20 AS job_id, rally_id, start_s, end_s, note FROM rallies),
p5 AS (SELECT job_id // 20 AS job_id, peak_id, t FROM peaks),
sus AS (SELECT job_id FROM (SELECT job_id, sum(end_s - start_s) AS play FROM r5 GROUP BY 1) JOIN (SELECT job_id, count(*) AS n FROM p5 GROUP BY 1) USING (job_id)
        WHERE n >= 10 AND play / 3600e0 > 0.7),
hit AS (SELECT r.*, p.t, p.peak_id FROM r5 r JOIN sus USING (job_id) JOIN p5 p ON p.job_id = r.job_id AND p.t BETWEEN r.start_s - 0.5 AND r.end_s + 0.5),
brk AS (SELECT *, CASE WHEN t - lag(t) OVER w > 5 THEN 1 ELSE 0 END AS b FROM hit WINDOW w AS (PARTITION BY job_id, rally_id ORDER BY t, peak_id)),
cl AS (SELECT *, sum(b) OVER (PARTITION BY job_id, rally_id ORDER BY t, peak_id) AS c FROM brk),
ref AS (SELECT job_id, greatest(any_value(start_s), min(t) - 2) AS start_s, least(any_value(end_s), max(t) + 2) AS end_s, any_value(note) AS note, count(*) AS audio_hits
        FROM cl GROUP BY job_id, rally_id, c HAVING count(*) >= 2),
ok AS (SELECT * FROM ref WHERE end_s - start_s >= 3)
SELECT * FROM ok UNION ALL
  SELECT job_id, start_s, end_s, note, NULL FROM r5 WHERE job_id NOT IN (SELECT job_id FROM ok)""")
def refine_with_audio(spark, sf):
    r, p = (load(spark, sf, n).withColumn("job_id", F.floor(F.col("job_id") / 20)) for n in ("rallies", "peaks"))
    d = r.select("job_id").distinct().withColumn("duration", F.lit(3600.0))
    return iv.refine_with_audio(r.select("job_id", "rally_id", "start_s", "end_s", "note"), p, d)


@query("longest_ok_window", "WIN-23", "clip_id:i lo:d hi:d", ctes("pts") + """,
fr AS (SELECT track_id AS clip_id, t, pid AS frame_no, kind NOT IN ('error', 'logout') AND value < 60 AS ok FROM pts),
cl AS (SELECT clip_id, max(t) + 1 AS clip_dur FROM fr GROUP BY 1),
b AS (SELECT *, CASE WHEN ok <> lag(ok) OVER w THEN 1 ELSE 0 END AS brk, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM fr WINDOW w AS (PARTITION BY clip_id ORDER BY t, frame_no)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY clip_id ORDER BY t, frame_no) AS seg FROM b),
r AS (SELECT clip_id, any_value(clip_dur) AS clip_dur, coalesce((arg_min({'v': pt}, (t, frame_no)).v + min(t)) / 2, 0) AS lo, coalesce((max(t) + arg_max({'v': nt}, (t, frame_no)).v) / 2, any_value(clip_dur)) AS hi
      FROM s JOIN cl USING (clip_id) WHERE ok GROUP BY clip_id, seg),
r2 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY hi - lo DESC, lo) = 1)
SELECT clip_id, lo, hi FROM r2 WHERE hi - lo >= 4.5 AND hi - lo < clip_dur - 0.5""")
def longest_ok_window(spark, sf):
    fr = load(spark, sf, "pts").selectExpr("track_id as clip_id", "t", "pid as frame_no", "kind not in ('error', 'logout') and value < 60 as ok")
    return iv.longest_ok_window(fr, fr.groupBy("clip_id").agg((F.max("t") + 1).alias("clip_dur")))


@query("select_for_reel", "SRT-2", "job_id:i pick:i rally_id:i dur:d", "WITH RECURSIVE" + ctes("rallies")[4:] + """,
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(dur, 2) DESC, intensity DESC, rally_id) AS rn FROM rallies),
w AS (SELECT job_id, rn, rally_id, dur, true AS took, 1 AS n, round(dur, 2) + 2.6::DOUBLE AS total FROM o WHERE rn = 1
  UNION ALL SELECT o.job_id, o.rn, o.rally_id, o.dur, w.n < 5 AND w.total + (2.6::DOUBLE + round(o.dur, 2)) <= 90,
    CASE WHEN w.n < 5 AND w.total + (2.6::DOUBLE + round(o.dur, 2)) <= 90 THEN w.n + 1 ELSE w.n END,
    CASE WHEN w.n < 5 AND w.total + (2.6::DOUBLE + round(o.dur, 2)) <= 90 THEN w.total + (2.6::DOUBLE + round(o.dur, 2)) ELSE w.total END
    FROM w JOIN o ON o.job_id = w.job_id AND o.rn = w.rn + 1)
SELECT job_id, n - 1 AS pick, rally_id, dur FROM w WHERE took""")
def select_for_reel(spark, sf):
    return iv.select_for_reel(load(spark, sf, "rallies"))


@query("match_summary", "AGG-6", "job_id:i rallies_found:i rallies_in_reel:i play_time_s:d no_play_time_s:d audio_peaks:i", ctes("rallies", "peaks") + f""",
{_REEL},
j AS (SELECT DISTINCT job_id FROM rallies)
SELECT j.job_id, f.n AS rallies_found, coalesce(u.n, 0) AS rallies_in_reel, coalesce(u.s, 0) AS play_time_s, greatest(0, 3600 - f.s) AS no_play_time_s, coalesce(p.n, 0) AS audio_peaks
FROM j LEFT JOIN (SELECT job_id, count(*) n, sum(dur) s FROM rallies GROUP BY 1) f USING (job_id) LEFT JOIN (SELECT job_id, count(*) n, sum(dur) s FROM reel GROUP BY 1) u USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) n FROM peaks GROUP BY 1) p USING (job_id)""")
def match_summary(spark, sf):
    return iv.match_summary(game_durations(spark, sf), load(spark, sf, "rallies"), reel(spark, sf), load(spark, sf, "peaks"))
