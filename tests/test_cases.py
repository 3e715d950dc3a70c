"""Small cases with known answers."""
import math

import pytest
from pyspark.sql import functions as F

from courtlake.functions import geometry as g
from courtlake.functions import scalar as sc
from courtlake.operators import asof, bench_metrics, camera, court, identity, intervals, quality, report, segments, store, thinning
from courtlake.sources import tables

IV = "job_id int, rally_id int, start_s double, end_s double, intensity int, note string"


def ivs(spark, *spans):
    return spark.createDataFrame([(0, i, float(s), float(e), 3, "") for i, (s, e) in enumerate(spans)], IV)


def dur(spark, s):
    return spark.createDataFrame([(0, float(s))], "job_id int, duration double")


def test_timeline_labels_dead_time(spark, rows):
    t = intervals.timeline(ivs(spark, (5, 15), (30, 40)), ivs(spark, (30, 40)), dur(spark, 60))
    assert rows(t, "start_s", "end_s", "kind", "in_reel") == [(0.0, 5.0, "no_play", None), (5.0, 15.0, "rally", False), (15.0, 30.0, "no_play", None), (30.0, 40.0, "rally", True), (40.0, 60.0, "no_play", None)]


def test_wall_to_wall_rallies_shrink_to_their_impacts(spark, rows):
    ts = [3, 4.5, 6, 7.5, 9, 22, 23.5, 25, 33.5, 35, 37, 38.5]
    peaks = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(ts)], "job_id int, peak_id int, t double")
    r = intervals.refine_with_audio(ivs(spark, (0, 20), (20, 44), (44, 60)), peaks, dur(spark, 60))
    assert rows(r, "start_s", "end_s", "audio_hits") == [(1.0, 11.0, 5), (20.0, 27.0, 3), (31.5, 40.5, 4)]


@pytest.mark.parametrize("n,cover", [(9, 60), (12, 20)])
def test_thin_audio_or_healthy_coverage_changes_nothing(spark, rows, n, cover):
    peaks = spark.createDataFrame([(0, i, i * 1.0) for i in range(n)], "job_id int, peak_id int, t double")
    r = intervals.refine_with_audio(ivs(spark, (0, cover)), peaks, dur(spark, 60))
    assert rows(r, "start_s", "end_s") == [(0.0, float(cover))]


def test_reel_skips_what_does_not_fit(spark, rows):
    r = spark.createDataFrame([(0, i, float(d), 3) for i, d in enumerate([50, 40, 30, 5, 4, 3, 3])], "job_id int, rally_id long, dur double, intensity int")
    assert rows(intervals.select_for_reel(r), "pick", "rally_id") == [(0, 0), (1, 2)]
    long = spark.createDataFrame([(0, 0, 200.0, 3), (0, 1, 10.0, 3)], "job_id int, rally_id long, dur double, intensity int")
    assert rows(intervals.select_for_reel(long), "rally_id") == [(0,)]


@pytest.mark.parametrize("step,n,in_play", [(0.01, 30, True), (0.001, 30, False)])
def test_in_play_needs_speed(spark, step, n, in_play):
    p = spark.createDataFrame([(0, i / 30, 0.1 + step * i, 0.5, 0.9) for i in range(n)] + [(0, 5 + i / 30, 0.9, 0.1, 0.9) for i in range(2)], "k int, t double, x double, y double, confidence double")
    got = segments.flight_segments(p, ["k"]).collect()
    assert [(r.points, r.in_play) for r in got] == [(n, in_play)]


def test_side_court_flight_is_dropped_and_wide_courts_have_no_opinion(spark):
    pts = spark.createDataFrame([(0, i / 30, 0.98, 0.4) for i in range(10)] + [(0, 5 + i / 30, 0.5, 0.4) for i in range(10)], "job_id int, t double, x double, y double")
    court_ = lambda lo, hi: spark.createDataFrame([(0, [[lo, 0.3], [hi, 0.3], [hi, 0.9], [lo, 0.9]])], "job_id int, corners array<array<double>>")
    assert segments.side_court_gate(pts, court_(0.35, 0.65), ["job_id"]).count() == 10
    assert segments.side_court_gate(pts, court_(0.05, 0.95), ["job_id"]).count() == 20
    assert segments.side_court_gate(pts, court_(0.35, 0.65).filter("false"), ["job_id"]).count() == 20


BOX = "job_id int, frame_no int, det_id int, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_player_gate_fails_open(spark):
    quad = spark.createDataFrame([(0, [[0.3, 0.3], [0.7, 0.3], [0.9, 0.9], [0.1, 0.9]])], "job_id int, corners array<array<double>>")
    inside, outside = (0.45, 0.4, 0.55, 0.7, 0.9), (0.0, 0.0, 0.05, 0.1, 0.9)
    mix = spark.createDataFrame([(0, f, 2 * f + i, *b) for f in range(6) for i, b in enumerate((inside, outside))], BOX)
    assert {r.det_id % 2 for r in identity.court_player_gate(mix, quad, ["job_id"], tie=["det_id"]).collect()} == {0}
    bad = spark.createDataFrame([(0, f, f, *(inside if f == 0 else outside)) for f in range(6)], BOX)
    assert identity.court_player_gate(bad, quad, ["job_id"], tie=["det_id"]).count() == 6


def test_homography_maps_corners_and_movement_is_measured(spark, rows):
    c = spark.createDataFrame([(0, [[0.30, 0.30], [0.70, 0.30], [0.90, 0.90], [0.10, 0.90]])], "job_id int, corners array<array<double>>")
    d = court.with_homography(c).withColumn("p", g.court_project("homography", F.lit(0.5), F.lit(0.9)))
    r = d.select("p.u", "p.v").first()
    assert r.u == pytest.approx(3.05) and r.v == pytest.approx(13.4)
    flat = spark.createDataFrame([(0, [[0.3, 0.3], [0.3, 0.3], [0.3, 0.3], [0.3, 0.3]])], "job_id int, corners array<array<double>>")
    assert court.with_homography(flat).first().homography is None
    pos = spark.createDataFrame([(0, 1, float(i), 1.0 + i, 5.0) for i in range(4)] + [(0, 1, 4.0, 50.0, 5.0), (0, 1, 5.0, 5.0, 5.0)], "job_id int, player_id int, t double, x_m double, y_m double")
    m = court.movement_stats(pos, ["job_id"]).first()
    assert (m.points, m.distance_m) == (6, pytest.approx(3.0))


def test_label_matching_and_gates(spark, rows):
    gt = spark.createDataFrame([(0, i, i / 30, 0.5, 0.5, True) for i in range(20)], "k int, id int, t double, x double, y double, visible boolean")
    f = bench_metrics.shuttle_f1(gt.drop("visible").withColumn("x", F.when(F.col("id") < 10, F.col("x")).otherwise(F.col("x") + 0.1)), gt, ["k"]).first()
    assert (f.tp, f.n_pred, f.n_visible, f.f1) == (10, 20, 20, pytest.approx(0.5))
    m = spark.createDataFrame([("c", 0, 0.9, 0.0)], "clip string, rally int, shuttle_f1 double, d3_below_floor_accepted double")
    for n, _, _ in bench_metrics.RELEASE_GATES:
        if n not in m.columns:
            m = m.withColumn(n, F.lit(None).cast("double"))
    r = bench_metrics.gate_report(m)
    assert r.filter("passed is null").count() == 8 and r.filter("all_passed").count() == 10


def test_greedy_ties_go_to_the_later_prediction(spark, rows):
    gt = spark.createDataFrame([(0, 1, 1.0)], "k int, id long, t double")
    pred = spark.createDataFrame([(0, 5, 0.75), (0, 6, 1.25)], "k int, id long, t double")
    assert rows(asof.greedy_match(pred, gt, ["k"], 0.5), "gt_id", "pred_id") == [(1, 6)]


def test_malformed_values_are_skipped(spark, rows):
    d = spark.createDataFrame([("1:15",), ("1:02:03",), ("90",), ("a:b",)], "c string")
    assert [r[0] for r in d.select(sc.parse_clock("c")).collect()] == [75.0, 3723.0, 90.0, None]
    raw = spark.createDataFrame([(0, '```json\n{"sport":"b","rallies":[{"start":"0:05","end":"0:20","intensity":"4"},{"end":"1:00"},{"start":"0:30","end":"0:31"},{"start":"0:19","end":"0:30"}]}\n```')], "job_id int, response string")
    assert rows(tables.read_rallies(raw, dur(spark, 25)), "start_s", "end_s", "intensity") == [(5.0, 25.0, 4)]


def test_job_state_restarts_at_a_requeue(spark):
    ev = [(1, 0, 0.0, "queued"), (1, 1, 5.0, "processing"), (1, 2, 9.0, "failed"), (1, 3, 20.0, "queued"), (1, 4, 25.0, "processing")]
    r = store.job_state(spark.createDataFrame(ev, "job_id int, event_id int, ts double, status string")).first()
    assert (r.status, r.started_at, r.finished_at) == ("processing", 25.0, None)


def test_reports_are_rebuilt_only_when_stale(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1.0) for i in range(20)], "job_id long, v double")
    path = str(tmp_path / "out")
    assert tables.write_reports(df.filter("job_id < 10"), path, "v1", buckets=4).count() == 10
    assert tables.write_reports(df, path, "v1", buckets=4).count() == 10
    assert tables.write_reports(df, path, "v1", buckets=4).count() == 0
    assert tables.write_reports(df, path, "v2", buckets=4).count() == 20
    back = spark.read.json(path)
    assert back.count() == 20 and back.filter("schema_tag = 'v2'").count() == 20


def test_track_tables_prune_to_their_bucket(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, float(i)) for i in range(400)], "job_id long, t double")
    tables.save_tracks(df, str(tmp_path / "t"), 16)
    one = tables.load_tracks(spark, str(tmp_path / "t"), [7], 16)
    assert one.count() == 10 and "PartitionFilters: [isnotnull(job_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_interval_overlap_of_zero_length_and_nested(spark, rows):
    m = intervals.merge_overlaps(ivs(spark, (0, 30), (5, 8), (29.4, 40), (39.9, 50)), tie=("rally_id",))
    assert rows(m, "start_s", "end_s") == [(0.0, 40.0), (39.9, 50.0)]


def test_track_quality_of_a_perfect_track(spark):
    p = spark.createDataFrame([(0, i / 30, 0.5 + 0.001 * i, 0.5) for i in range(300)], "job_id int, t double, x double, y double")
    q = quality.shuttle_quality(p, spark.createDataFrame([(0, 10.0)], "job_id int, dur double"), ["job_id"]).first()
    assert (q.coverage, q.teleports, q.quality) == (1.0, 0, 1.0)


def test_no_racquet_evidence_forbids_technique(spark):
    r = spark.createDataFrame([(0, 0.1, 0.2, 0.0, 0.0, 0.3, 0, 0, False)], "job_id int, player_quality double, pose_quality double, racquet_quality double, racquet_candidate_quality double, shuttle_quality double, racquet_samples int, racquet_candidate_samples int, has_frame boolean")
    e = report.evidence_summary(r).first()
    assert (e.mode, len(e.caveats), len(e.forbidden), e.visual_context) == ("none", 4, 5, 0.0)


def test_reel_clock_round_trip(spark):
    clips = camera.reel_offsets(spark.createDataFrame([(0, i, 10.0, 100.0 * i) for i in range(3)], "job_id int, pos long, clip_dur double, source_start double"))
    pts = spark.createDataFrame([(0, i, 105.0 + 100 * i) for i in range(2)], "job_id int, pid int, t double")
    reel = camera.map_time(pts, clips, "source")
    back = camera.map_time(reel.select("job_id", "pid", F.col("t_mapped").alias("t")), clips, "reel")
    assert {(r.pid, round(r.t_mapped, 6)) for r in back.collect()} == {(0, 105.0), (1, 205.0)}


def test_thinning_keeps_dropouts(spark):
    p = spark.createDataFrame([(0, i, i / 30) for i in range(30)] + [(0, 100 + i, 3 + i / 30) for i in range(30)], "k int, pid int, t double")
    ts = sorted(r.t for r in thinning.thin(p, ["k"], tie=["pid"]).collect())
    gaps = [b - a for a, b in zip(ts, ts[1:])]
    assert sum(d > 0.35 for d in gaps) == 1 and max(d for d in gaps if d < 1) < 0.33 and math.isclose(ts[-1], 3 + 29 / 30)


def test_short_rallies_get_a_short_window(spark):
    import math

    from courtlake.operators.smoothing import hann_short

    rows = [(k, i, float((i * 7 + k) % 5), "a") for k in (1, 2, 3, 8, 16, 17) for i in range(k)]
    got = {(r.k, r.frame_no): r.x for r in hann_short(spark.createDataFrame(rows, "k int, frame_no int, x double, note string"), ["k"], "frame_no", ["x"], 17).collect()}
    expect = {}
    for n in (1, 2, 3, 8, 16):
        win = max(3, n | 1)
        w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (win - 1)) for i in range(win)]
        v = [float((i * 7 + n) % 5) for i in range(n)]
        for i in range(n):
            expect[n, i] = sum(w[j + win // 2] * v[max(0, min(n - 1, i + j))] for j in range(-(win // 2), win // 2 + 1)) / sum(w)
    assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 1e-9 for k in expect)


def test_energy_windows_at_any_rate(spark):
    import math

    from courtlake.operators.audio import rms_series

    for sr, n in ((22050, 22050), (16000, 8000), (50, 60), (40, 41)):
        hop, win = max(1, int(0.05 * sr)), max(1, int(0.1 * sr))
        s = [math.sin(i * 0.37) * (i % 11) / 11 for i in range(n)]
        got = {round(2 * r.t * sr): r.db for r in rms_series(spark.createDataFrame([(1, i, v) for i, v in enumerate(s)], "job_id int, i long, s double"), sr=sr).collect()}
        starts = [a for a in range(0, n, hop) if a + win <= n]
        assert got.keys() == {2 * a + win for a in starts}
        for a in starts[:5] + starts[-5:]:
            rms = math.sqrt(sum(x * x for x in s[a:a + win]) / win)
            assert abs(got[2 * a + win] - 20 * math.log10(max(1e-4, rms))) < 1e-6


def test_tracks_of_many_clips_lie_in_few_files(spark, sf_dir, tmp_path, monkeypatch):
    from courtlake.plans import q_sources
    from courtlake.sources.tables import read_shuttle_csv

    monkeypatch.setattr(q_sources, "scratch_dir", lambda spark, name: str(tmp_path))
    clips = q_sources.read_shuttle_csv(spark, sf_dir).select("clip_id").distinct().count()
    assert 0 < len(list((tmp_path / "tracks").rglob("*.csv"))) < clips
    p = spark.createDataFrame([("0", "1", "10", "20", 1), ("25", "1", "20", "30", 2), ("1", "0", "9", "9", 2), ("x", "1", "9", "9", 1)], "Frame string, Visibility string, X string, Y string, clip_id long")
    meta = spark.createDataFrame([(k, 10.0 * k, 25.0, 100, 100) for k in (1, 2)], "clip_id long, start_s double, fps double, width long, height long")
    p.write.option("header", True).csv(str(tmp_path / "column"))
    p.write.option("header", True).partitionBy("clip_id").csv(str(tmp_path / "folder"))
    for layout in ("column", "folder"):
        got = read_shuttle_csv(spark, str(tmp_path / layout), meta).select("clip_id", "t", "x", "y").collect()
        assert sorted(map(tuple, got)) == [(1, 10.0, 0.1, 0.2), (2, 21.0, 0.2, 0.3)]


def test_an_average_at_the_limit_does_not_depend_on_the_order(spark, tmp_path):
    import random

    from courtlake.plans import q_quality

    rnd, total = random.Random(1), 10.0
    while total >= 10.0:                     # 20 that average exactly 0.5, less as a sum of doubles in this order
        low = rnd.sample(range(1, 50), 10)
        ks, total = [*low, *[100 - k for k in low]], 0.0
        rnd.shuffle(ks)
        for k in ks:
            total += k / 100
    events = spark.createDataFrame([(k * 71 % 100, 1, "click", 1.0) for k in ks], "event_id long, user_id long, event_type string, value double").coalesce(1)
    events.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.mask_enabled for r in q_quality.rally_flags(spark, str(tmp_path)).collect()] == [True]
