"""What grows with the tables: rows that a step makes, and sums that must not depend on where rows lie."""
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtlake.operators import court


def _steps(df):
    """(name, rows put out) of the executed plan's steps, with those of exchanges that are read again left out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        found.append((name, rows.get().value() if rows.isDefined() else 0))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_gate_averages_are_added_in_event_order(spark, tmp_path):
    """Rows lie in another order than the events; hundredths whose average is the gate of 0.9 but for the order in which they are added."""
    rng = random.Random(5)
    for _ in range(10000):
        ids = sorted(rng.sample(range(1000), 12))
        c = [i * 31 % 100 / 100 for i in ids]
        back = 0.0
        for x in reversed(c):
            back += x
        there = 0.0
        for x in c:
            there += x
        if (there / 12 + 0.4 >= 0.9) != (back / 12 + 0.4 >= 0.9):
            break
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE events AS SELECT unnest({ids})::BIGINT AS event_id, TIMESTAMP '2024-01-02' AS ts, 7::BIGINT AS user_id, 'view' AS event_type, 5e0 AS value, '' AS props")
    con.execute(f"COPY (SELECT * FROM events ORDER BY event_id DESC) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(entry.oracle_sql()["gate_report"]).df().set_index("gate").passed
    got = entry.queries()["gate_report"](spark, str(tmp_path)).toPandas().set_index("gate").passed
    assert got["player_exact_count_frac"] == want["player_exact_count_frac"]


def test_a_heat_map_makes_no_row_per_point_and_cell(spark):
    rng = random.Random(3)
    pts = [(1, p, rng.uniform(-2, 8), rng.uniform(-3, 16)) for p in (1, 2) for _ in range(1500)]
    d = spark.createDataFrame(pts, "job_id long, player_id long, x_m double, y_m double")
    got = court.heatmap(d)
    want = {}
    for _, p, x, y in pts:
        if not (-1.2 <= x <= 7.3 and -1.5 <= y <= 14.9):
            continue
        cx, cy = min(max(x / 6.1, 0.0), 1.0) * 17, min(max(y / 13.4, 0.0), 1.0) * 37
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                ix, iy = math.floor(cx + 0.5) + a, math.floor(cy + 0.5) + b
                if 0 <= ix <= 17 and 0 <= iy <= 37:
                    want[p, ix, iy] = want.get((p, ix, iy), 0.0) + math.exp(-((ix - cx) ** 2 + (iy - cy) ** 2) / 1.2)
    top = {p: max(h for k, h in want.items() if k[0] == p) for p in (1, 2)}
    assert {(r.player_id, r.ix, r.iy): r.heat for r in got.collect()} == pytest.approx({k: h / top[k[0]] for k, h in want.items()})
    assert max(n for _, n in _steps(got)) <= len(pts)


@pytest.mark.parametrize("n", [5, 80])
def test_continuations_equal_all_pairs_and_small_frames_make_no_cells(spark, n):
    from courtlake.operators.identity import iou_continue

    rng = random.Random(n)
    box = lambda f, i: (f, f / 6, i, x := rng.random() * 0.5, y := rng.random() * 0.5, x + 0.1 + rng.random() * 0.4, y + 0.1 + rng.random() * 0.4)
    prev, cur = ([box(f, i) for f in range(3) for i in range(n)] for _ in range(2))
    cols = "frame_no long, t double, track_id long, x1 double, y1 double, x2 double, y2 double"
    got = iou_continue(spark.createDataFrame(prev, cols), spark.createDataFrame(cur, cols), ["frame_no"])
    want = {}
    for f, _, i, *b in cur:
        best = None
        for g, _, j, *a in prev:
            inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            share = inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)
            if f == g and share >= 0.3:
                best = min(best or (0, 0), (-share, j))
        if best:
            want[f, i] = best[1]
    assert {(r.frame_no, r.track_id): r.p.track_id for r in got.collect()} == want
    assert n > 64 or sum(k for name, k in _steps(got) if name == "Generate") == 0


def test_labelled_boxes_of_small_frames_make_no_cells_and_are_read_once(spark, sf_dir):
    d = entry.queries()["id_switches"](spark, sf_dir)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
    assert sum(k for name, k in _steps(d) if name == "Generate") == 0


@pytest.mark.parametrize("name", ["merge_fragments", "prune_to_verdict", "prune_discontinuous", "match_shots", "d3_error"])
def test_order_lines_are_read_once_and_kept(name, spark, sf_dir):
    d = entry.queries()[name](spark, sf_dir)
    assert not any("lineitem" in f for f in d.inputFiles())
    if name in ("match_shots", "d3_error"):
        assert d.count() > 0


def test_shot_matches_work_out_no_gate(spark, sf_dir, monkeypatch):
    from courtlake.plans import q_quality

    monkeypatch.setattr(q_quality.q, "shot_gates", lambda *a, **b: pytest.fail("gates are not part of a match"))
    assert entry.queries()["match_shots"](spark, sf_dir).count() > 0


def test_boxes_without_ids_succeed_in_frames_of_a_plain_walk():
    from courtlake.operators.identity import _succession

    a, b = (0.1, 0.1, 0.3, 0.5), (0.6, 0.1, 0.8, 0.5)
    row = lambda t, seed, det, id, box: (t, 2, seed, det, id is None, id or 0, 0.5, *box)
    rows = [row(0.0, True, 1, 1, a), row(0.0, True, 2, 2, b), row(0.5, True, 3, 1, a), row(0.5, False, 4, 7, b), row(1.0, False, 5, None, a), row(1.0, False, 6, 7, b), row(3.0, False, 7, 8, a)]
    assert list(_succession(0.3, 0.8)(iter(rows))) == [(0.0, [1, 2], [], 2), (0.5, [3, 4], [7], 2), (1.0, [6, 5], [], 2), (3.0, [], [], 1)]
