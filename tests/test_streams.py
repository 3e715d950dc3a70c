"""Streams over several batches: state is carried, late rows go."""
import glob

from pyspark.sql import functions as F

from courtlake.streaming import operators as st
from courtlake.streaming.runner import drain, feed


def _commits(root):
    return len([f for f in glob.glob(f"{root}/checkpoint/commits/*") if not f.endswith(".tmp")])


def test_state_is_carried_from_batch_to_batch(spark, tmp_path):
    rows = [(c, 100 * c + k, float(k)) for c in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "client long, req_id long, t double")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    whole = drain(st.admit(feed(spark, df, one, parts=1), 3, 10.0), one).collect()
    sliced = drain(st.admit(feed(spark, df, many, parts=5), 3, 10.0), many).collect()
    assert _commits(one) >= 1 and _commits(many) >= 5
    assert sorted(whole) == sorted(sliced) and 0 < sum(r.admitted for r in sliced) < len(rows)


def test_a_row_behind_the_watermark_is_left_out(spark, tmp_path):
    root = str(tmp_path)
    schema = "track_id long, pid long, t double, x double, y double, confidence double"
    flight = [(1, k, k * 0.1, 0.01 * k, 0.5, 1.0) for k in range(10)]
    for part in (flight, [(2, 100, 1000.0, 0.5, 0.5, 1.0)], [(2, 102, 1000.2, 0.5, 0.5, 1.0)], [(1, 50, 0.95, 0.9, 0.5, 1.0)], [(2, 101, 5000.0, 0.5, 0.5, 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    got = drain(st.flight_sessions(stream, ["track_id"]), root).where(F.col("track_id") == 1).collect()
    assert _commits(root) >= 5
    assert [(r.points, round(r.end_s, 3)) for r in got] == [(10, 0.9)]


def _write(spark, root, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _state_rows(seen):
    """Rows in the state store after each batch."""
    return lambda q: seen.extend(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"])


POINTS = "rally_index long, pid long, t double, x double, y double, confidence double"
RUNS = "run_id long, event_id long, t double, state string, active_workers long"


def test_smoother_state_ends_and_starts_afresh(spark, tmp_path):
    """Every series but the last is silent for over the reset time by the end, and the state of none of them is kept."""
    root, seen = str(tmp_path), []
    batches = [[(k, 100 * b + k, 10.0 * b + 0.01 * i, 0.5 + i / 10, 0.5, 1.0) for i, k in enumerate(range(20 * b, 20 * b + 20))] for b in range(4)]
    batches.append([(3, 900, 40.0, 0.9, 0.1, 1.0)])                # an old series again: as if it were new
    got = drain(st.one_euro_stream(_write(spark, root, POINTS, *batches), "rally_index"), root, watch=_state_rows(seen)).collect()
    assert len(got) == 81 and max(seen) <= 2 * 3 * 20 and seen[-1] <= 3 * 1      # value and timer rows of the keys alive
    assert [(r.x, r.y) for r in got if r.pid == 900] == [(0.9, 0.1)]
    assert 0.0 in [r.x - 0.5 for r in got]                          # the row at time zero is not late


def test_admission_and_runs_are_forgotten(spark, tmp_path):
    root, seen = str(tmp_path / "a"), []
    batches = [[(10 * b + k, 100 * b + k, 1000.0 * b + k) for k in range(10)] for b in range(5)]
    drain(st.admit(_write(spark, root, "client long, req_id long, t double", *batches), 2, 100.0), root, watch=_state_rows(seen)).collect()
    assert max(seen) <= 60 and seen[-1] <= 30
    root, seen = str(tmp_path / "r"), []
    batches = [[(10 * b + k, 100 * b + k, 5000.0 * b + k, "COMPLETED", 1) for k in range(10)] for b in range(5)]
    got = drain(st.budget_monitor(_write(spark, root, RUNS, *batches)), root, watch=_state_rows(seen)).collect()
    assert len(got) == 50 and seen[-1] <= 30


def test_deadlines_of_silent_runs(spark, tmp_path):
    """Each way a run can end, in batches and with a late row; and the same in one batch."""
    events = [
        (1, 0, 0.0, "IN_QUEUE", 0), (2, 1, 0.0, "IN_QUEUE", 2), (3, 2, 0.0, "IN_QUEUE", 1), (3, 3, 50.0, "RUNNING", 1), (4, 4, 10.0, "IN_QUEUE", 0),
        (4, 5, 100.0, "IN_QUEUE", 3), (4, 6, 905.0, "RUNNING", 3), (4, 7, 2000.0, "COMPLETED", 3), (5, 8, 100.0, "RUNNING", 1), (5, 9, 1301.0, "COMPLETED", 1),
        (6, 10, 0.0, "RUNNING", 1), (6, 11, 1200.0, "FAILED", 1), (7, 12, 10.0, "IN_QUEUE", 1), (7, 13, 400.0, "IN_QUEUE", 0)]
    want = {(1, "no_workers", 150.0), (2, "queue_timeout", 900.0), (3, "run_timeout", 1250.0), (4, "completed", 2000.0), (5, "run_timeout", 1300.0), (6, "failed", 1200.0), (7, "no_workers", 400.0)}
    events.sort(key=lambda r: (r[2], r[1]))
    end, late = [(-1, 99, 1e6, "IN_QUEUE", 1)], [(8, 98, 5.0, "COMPLETED", 1)]
    for name, batches in (("one", [events]), ("many", [[e for e in events if lo <= e[2] < hi] for lo, hi in ((-1, 20), (20, 300), (300, 950), (950, 1250), (1250, 9999))])):
        root = str(tmp_path / name)
        got = drain(st.run_deadlines(_write(spark, root, RUNS, *batches, end, late)), root).collect()
        assert {(r.run_id, r.verdict, r.t) for r in got if r.run_id > 0} == want and len(got) == len(want)


def test_overdue_by_pipeline(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "gpu"), (2, "cpu"), (3, "gpu"), (4, None), (5, "gpu")], "job_id long, pipeline string")
    events = [[(1, 0, 0.0, "processing"), (2, 1, 0.0, "processing"), (3, 2, 0.0, "queued"), (4, 3, 0.0, "processing"), (5, 4, 0.0, "processing"), (9, 5, 0.0, "processing")],
              [(3, 7, 650.0, "processing"), (5, 8, 700.0, "done")], [(3, 9, 1300.0, "queued"), (3, 10, 1310.0, "processing")], [(2, 6, 1700.0, "done")], [(-1, 11, 1750.0, "queued")], [(-1, 12, 1751.0, "queued")]]
    root, seen = str(tmp_path), []
    out = drain(st.overdue_jobs(_write(spark, root, "job_id long, event_id long, ts double, status string", *events), jobs), root, "update", st.upsert_sink, _state_rows(seen))
    rows = sorted(out.collect(), key=lambda r: r.version)
    last = {r.job_id: (r.status, r.overdue) for r in rows}
    assert last == {1: ("processing", True), 2: ("done", False), 3: ("processing", False), 4: ("processing", False), 5: ("done", True), 9: ("processing", False), -1: ("queued", False)}
    assert any(r.job_id == 1 and r.overdue and r.updated_at == 0.0 for r in rows)


def test_chunks_in_any_order_and_up_to_a_size(spark, tmp_path):
    schema = "upload_id long, arrival long, t double, chunk_no long, bytes long, declared long"
    a = [(1, 0, 0.0, 0, 40, 100), (1, 1, 1.0, 0, 40, 100), (1, 2, 2.0, 1, 0, 100), (2, 3, 2.5, 0, 90, 500)]
    b = [(1, 4, 3.0, 1, 70, 100), (1, 5, 4.0, 2, 10, 100), (1, 6, 5.0, 1, 60, 100), (2, 7, 6.0, 1, 31, 500), (2, 8, 7.0, 1, 30, 500), (1, 9, 8.0, 0, 40, 100)]
    root = str(tmp_path / "size")
    got = drain(st.ordered_chunks(_write(spark, root, schema, a, b), size="bytes", declared="declared", most=120), root).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.arrival)] == ["accepted", "duplicate", "empty", "accepted", "too_large", "gap", "accepted", "too_large", "accepted", "gap"]
    root, seen = str(tmp_path / "any"), []
    again = [(3, 20, 5000.0, 0, 1, 1)], [(3, 21, 9000.0, 1, 1, 1)], [(3, 22, 9001.0, 1, 1, 1)]
    got = drain(st.dedupe_chunks(_write(spark, root, schema, a, b, *again)), root, watch=_state_rows(seen)).collect()
    assert sorted((r.upload_id, r.chunk_no) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert seen[-1] <= 2


def test_feed_keeps_every_row_and_the_session(spark, tmp_path):
    rows = [(k, None if k % 10 == 0 else float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, t double")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    root = str(tmp_path)
    out = drain(feed(spark, df, root, parts=4), root)
    assert sorted(r.k for r in out.collect()) == list(range(200)) and spark.conf.get(key, None) == was
    assert len(glob.glob(f"{root}/in/part-*.parquet")) == 4


def test_states_of_many_keys_are_stored_in_groups(spark, tmp_path):
    from courtlake.streaming.fold import GROUPS

    root, stored, n = str(tmp_path), [], 3 * GROUPS
    events = spark.range(2 * n).selectExpr("id % {0} as job_id".format(n), "id as event_id", "cast(id as double) as ts", "if(id < {0}, 'queued', 'done') as status".format(n))
    out = drain(st.job_state(feed(spark, events, root, parts=2, order="ts")), root, "update", st.upsert_sink,
                watch=lambda q: stored.extend(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]))
    assert 0 < max(stored) <= GROUPS
    assert out.where(f"status = 'done' and version = 2 and updated_at = job_id + {n}").count() == n
