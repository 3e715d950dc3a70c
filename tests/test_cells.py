"""Boxes meet in cells: results equal all pairs, and a crowded frame stays linear."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.operators.asof import nearest_center
from courtlake.operators.identity import iou_continue


def _points(rng, n, frame, start=0):
    return [(frame, start + i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)) * 1.4 - 0.2)]


def _most_rows(df):
    """Rows that the joins of the executed plan put out."""
    df.collect()
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        if "Join" in name:
            rows.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return sum(rows)


@pytest.mark.parametrize("radius", [0.12, 0.031, 2.0])
def test_nearest_equals_all_pairs(spark, radius):
    rng = np.random.default_rng(8)
    gt = [r for f, n in ((1, 40), (2, 3), (3, 200), (4, 1)) for r in _points(rng, n, f, 1000 * f)]
    pred = [r for f, n in ((1, 50), (2, 2), (3, 150), (5, 4)) for r in _points(rng, n, f, 5000 * f)]
    pred += [(2, 9000, *gt[40][2:]), (2, 9001, *gt[40][2:]), (1, 9002, gt[0][2] + 0.12, gt[0][3])]      # ties, and a border
    got = nearest_center(spark.createDataFrame(pred, "f long, id long, x double, y double"), spark.createDataFrame(gt, "f long, gt_id long, x double, y double"), ["f"], radius)
    want = {}
    for f, i, x, y in gt:
        near = [(float(np.hypot(a - x, b - y)), -j, j) for g, j, a, b in pred if g == f and np.hypot(a - x, b - y) <= radius]
        if near:
            want[i] = min(near)[2]
    assert {r.gt_id: r.p.id for r in got.collect()} == want


def test_distances_that_differ_by_a_rounding_error_are_ties(spark):
    x = 0.1 + 0.2
    gt = spark.createDataFrame([(1, 1, 0.0, 0.5)], "f long, gt_id long, x double, y double")
    pred = spark.createDataFrame([(1, 5, 0.3, 0.5), (1, 6, x, 0.5)], "f long, id long, x double, y double")
    assert x > 0.3 and [r.p.id for r in nearest_center(pred, gt, ["f"], 0.5).collect()] == [6]


def test_a_frame_of_ten_thousand_boxes(spark):
    rng = np.random.default_rng(9)
    n = 10_000
    gt, pred = (spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))], f"f long, {c} long, x double, y double") for c in ("gt_id", "id"))
    got = nearest_center(pred, gt, ["f"], 0.12)
    assert _most_rows(got) < 80 * n                  # all pairs are 10 000 n, all within the radius some 450 n
    assert got.count() == n


def test_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(10)

    def boxes(n, t, start):
        low, size = rng.random((n, 2)) * 1.2 - 0.2, rng.random((n, 2)) * 0.3
        return [(1, t, start + i, float(a), float(b), float(a + w), float(b + h)) for i, ((a, b), (w, h)) in enumerate(zip(low, size))]

    schema = "job_id long, t double, track_id long, x1 double, y1 double, x2 double, y2 double"
    prev, cur = boxes(300, 1.0, 0), boxes(300, 1.5, 1000)
    got = iou_continue(spark.createDataFrame(prev, schema), spark.createDataFrame(cur, schema), ["job_id"]).select("track_id", F.col("p.track_id").alias("before"), "iou").collect()
    want = {}
    for c in cur:
        for p in prev:
            w, h = min(c[5], p[5]) - max(c[3], p[3]), min(c[6], p[6]) - max(c[4], p[4])
            inter = max(w, 0) * max(h, 0)
            area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
            v = inter / (area(c) + area(p) - inter)
            if v >= 0.3:
                want[c[2]] = max(want.get(c[2], (0, 0)), (v, -p[2]))
    assert {r.track_id: r.before for r in got} == {k: -v[1] for k, v in want.items()} and len(want) > 30
