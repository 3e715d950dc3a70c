"""Sequential operators against direct loops over one small group at a time."""
import math
import random
import statistics

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from courtlake.operators import cleaning, identity, quality, thinning

PTS = "rally_index int, pid long, t double, x double, y double, confidence double"


def track(seed: int, n: int = 120, spikes: bool = False, still: bool = False):
    """A jittery arc with dropouts, optional spikes and a parked stretch."""
    r, out, t = random.Random(seed), [], 0.0
    for i in range(n):
        t += r.choice([0.03, 0.04, 0.04, 0.05]) if r.random() > 0.06 else r.uniform(0.4, 1.2)
        x, y = 0.5 + 0.35 * math.sin(t), 0.4 + 0.2 * math.sin(2 * t + 1)
        if still and 40 <= i < 60:
            x, y = 0.3 + r.uniform(-0.004, 0.004), 0.3 + r.uniform(-0.004, 0.004)
        if spikes and r.random() < 0.08:
            x = r.uniform(0.05, 0.95)
        out.append((i, t, x + r.uniform(-0.003, 0.003), y, 0.9))
    return out


@pytest.fixture(scope="module")
def tracks():
    return {s: track(s, spikes=s % 2 == 0, still=s % 3 == 0) for s in range(6)}


@pytest.fixture(scope="module")
def points(spark, tracks):
    return spark.createDataFrame([(s, *p) for s, ps in tracks.items() for p in ps], PTS)


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.rally_index, set()).add(r.pid)
    return out


def test_static_runs(points, tracks):
    want = {}
    for s, ps in tracks.items():
        drop, i = set(), 0
        while i < len(ps):
            j = i + 1
            while j < len(ps) and ps[j][1] - ps[j - 1][1] <= 0.35 and math.dist(ps[j][2:4], ps[i][2:4]) <= 0.012:
                j += 1
            if j - i >= 8:
                drop |= {p[0] for p in ps[i:j]}
            i = j
        want[s] = {p[0] for p in ps} - drop
    assert kept(cleaning.drop_static_runs(points, ["rally_index"], tie=["pid"])) == want
    assert any(len(want[s]) < len(tracks[s]) for s in want)


def test_measured_confidence(points, tracks):
    """The query's recursive SQL over small tracks with spikes, so that points are refused."""
    sql = "WITH RECURSIVE fed AS" + oracle_sql()["measure_confidence"].split("\nfed AS", 1)[1]
    dense = pd.DataFrame([(s, *p[:4]) for s, ps in tracks.items() for p in ps], columns=["rally_index", "pid", "t", "x", "y"])
    con = duckdb.connect()
    con.register("dense", dense)
    want = {(r, p): (c, w) for r, p, c, w in con.execute(sql).fetchall()}
    got = {(r.rally_index, r.pid): (r.confidence, r.provenance) for r in cleaning.measure_confidence(points, ["rally_index"], gap=1.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=1.1e-3), want[k][1]) for k in want)
    assert sum(c < 0.3 for c, _ in got.values()) > 5 and len({c for c, _ in got.values()}) > 20


def test_hampel(points, tracks):
    want = {}
    for s, ps in tracks.items():
        keep = [True] * len(ps)
        for _ in range(2):
            alive = [i for i, k in enumerate(keep) if k]
            new = []
            for i, p in enumerate(ps):
                lt, rt = [j for j in alive if j < i][-3:], [j for j in alive if j > i][:3]
                nb = [ps[j] for j in lt + rt]
                if not nb:
                    new.append(True)
                    continue
                edge = (rt[0], rt[1]) if not lt and len(rt) > 1 else (lt[-1], lt[-2]) if not rt and len(lt) > 1 else None
                if edge:
                    a, b = ps[edge[0]], ps[edge[1]]
                    k = (p[1] - a[1]) / (a[1] - b[1]) if abs(a[1] - b[1]) > 1e-9 else 0
                    mid = (a[2] + (a[2] - b[2]) * k, a[3] + (a[3] - b[3]) * k)
                else:
                    mid = (statistics.median(q[2] for q in nb), statistics.median(q[3] for q in nb))
                room = 0.16
                if len(nb) > 1:
                    room = max(room, 2.5 * statistics.median(math.dist(q[2:4], r[2:4]) for q, r in zip(nb, nb[1:])))
                new.append(math.dist(p[2:4], mid) <= room)
            keep = new
        want[s] = {p[0] for p, k in zip(ps, keep) if k}
    assert kept(cleaning.hampel(points, ["rally_index"])) == want
    assert any(len(want[s]) < len(tracks[s]) for s in want)


def test_thinning_widens_and_truncates(points, tracks):
    got = kept(thinning.thin(points, ["rally_index"], max_points=40, tie=["pid"]))
    for s, ps in tracks.items():
        def emit(every):
            out = [ps[0]]
            for i in range(1, len(ps)):
                first = ps[i][1] - ps[i - 1][1] > 0.25
                last = i + 1 == len(ps) or ps[i + 1][1] - ps[i][1] > 0.25
                if first or last or ps[i][1] - out[-1][1] >= every:
                    out.append(ps[i])
            return out

        o = emit(0.08)
        if len(o) > 40:
            o = emit(max(0.08, (o[-1][1] - o[0][1]) / 40))[:40]
        assert got[s] == {p[0] for p in o}


DET = "job_id int, t double, det_id long, track_id long, cx double, cy double, h double"


@pytest.fixture(scope="module")
def dets(spark):
    """Two players and a third who leaves and returns; ids lost now and then."""
    r, out, n = random.Random(5), [], 0
    for job in range(3):
        for f in range(90):
            t = f / 6
            for p, (cx, cy, h) in enumerate([(0.5 + 0.2 * math.sin(t), 0.75, 0.3), (0.5 + 0.15 * math.cos(t), 0.3, 0.14), (0.8, 0.5, 0.22)]):
                if (p == 2 and 30 < f < 60) or r.random() < 0.05:
                    continue
                tid = None if r.random() < 0.1 + 0.3 * job else p * 10 + (f > 45)
                out.append((job, t, n, tid, cx + r.uniform(-0.01, 0.01), cy, h + r.uniform(-0.01, 0.01)))
                n += 1
    return out


def test_stable_ids(spark, dets):
    got = {r.det_id: r.raw_id for r in identity.stable_ids(spark.createDataFrame(dets, DET), ["job_id"]).collect()}
    for job in range(3):
        slots = {}
        for t in sorted({d[1] for d in dets if d[0] == job}):
            frame = sorted((d for d in dets if d[0] == job and d[1] == t), key=lambda d: d[2])
            pairs = sorted((math.dist(d[4:6], v[:2]) + 0.5 * abs(d[6] - v[2]), i, s) for i, d in enumerate(frame) for s, v in slots.items()
                           if math.dist(d[4:6], v[:2]) + 0.5 * abs(d[6] - v[2]) <= min(0.6, 0.22 + 0.28 * max(0, t - v[3] - 0.25)))
            ids, used = {}, set()
            for _, i, s in pairs:
                if i not in ids and s not in used:
                    ids[i] = s
                    used.add(s)
            for i, d in enumerate(frame):
                if i not in ids:
                    near = {s: math.dist(d[4:6], v[:2]) for s, v in slots.items() if s not in used}
                    alike = [s for s in near if abs(slots[s][2] - d[6]) < 0.12 and near[s] <= min(0.65, 0.45 + 0.3 * (t - slots[s][3]))]
                    free = [s for s in range(4) if s not in slots and s not in used]
                    ids[i] = min(alike, key=near.get) if alike else free[0] if free else min(near, key=lambda s: slots[s][3])
                    used.add(ids[i])
            for i, d in enumerate(frame):
                slots[ids[i]] = (*d[4:7], t)
                assert got[d[2]] == ids[i]


def test_fragments_merge_into_players(spark, dets):
    """Ids that change at frame 45 are the same three people; the most seen player is 0."""
    df = spark.createDataFrame([d for d in dets if d[3] is not None and d[0] == 0], DET).withColumn("raw_id", F.col("track_id"))
    got = identity.merge_fragments(df, ["job_id"]).collect()
    assert len({(r.track_id // 10, r.id) for r in got}) == 3
    n = {i: sum(r.id == i for r in got) for i in range(3)}
    assert n[0] >= n[1] >= n[2]


def test_worker_ids_fall_back_when_thin(spark, dets):
    v = {r.job_id: r.accepted for r in identity.accept_worker_ids(spark.createDataFrame(dets, DET), ["job_id"], tie=["det_id"]).collect()}
    have = {j: sum(d[3] is not None for d in dets if d[0] == j) / sum(d[0] == j for d in dets) for j in v}
    assert v == {j: have[j] >= 0.6 for j in v} and set(v.values()) == {True, False}


BOXES = "job_id int, t double, det_id long, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_prune_follows_a_renamed_player(spark):
    rows, n = [], 0
    for f in range(20):
        for tid, x in ((1 if f < 10 else 7, 0.2 + f * 0.005), (2, 0.6), (9, 0.85)):
            rows.append((0, f / 6, n, tid, x, 0.3, x + 0.1, 0.6, 0.9))
            n += 1
    boxes = spark.createDataFrame(rows, BOXES)
    poses = boxes.select("job_id", "t", "track_id", F.col("det_id").alias("row_id"))
    verdict = spark.createDataFrame([(0, [1, 2], 2)], "job_id int, keep_ids array<long>, count int")
    b, p = identity.prune_to_verdict(boxes, poses, verdict, ["job_id"])
    assert {r.track_id for r in b.collect()} == {1, 2, 7} == {r.track_id for r in p.collect()}
    assert b.count() == 40


def test_prune_reverts_a_verdict_the_track_contradicts(spark):
    rows = [(0, f / 6, f * 3 + i, 5 + i, 0.2 * i, 0.1, 0.2 * i + 0.1, 0.4, 0.9) for f in range(12) for i in range(3)]
    boxes = spark.createDataFrame(rows, BOXES)
    verdict = spark.createDataFrame([(0, [77], 2)], "job_id int, keep_ids array<long>, count int")
    b, _ = identity.prune_to_verdict(boxes, boxes.select("job_id", "track_id", "det_id"), verdict, ["job_id"])
    assert b.count() == 36


def test_group_tracks_matches_boxes_without_ids(spark):
    rows = [(0, f / 6, f * 2 + i, None if (f + i) % 3 == 0 else i, 0.2 + 0.5 * i + f * 0.004, 0.3, 0.3 + 0.5 * i + f * 0.004, 0.6, 0.9) for f in range(20) for i in range(2)]
    got = identity.group_tracks(spark.createDataFrame(rows, BOXES), ["job_id"]).collect()
    side = {}
    for r in got:
        side.setdefault(r.track_key, set()).add(r.x1 > 0.5)
    assert all(len(v) == 1 for v in side.values())
    assert {r.track_key for r in got if r.track_id is not None} == {"w0", "w1"}


def test_near_far_keeps_the_incumbent(spark):
    pos = [(0, f, f / 30, k, cy) for f in range(30) for k, cy in (("a", 0.70), ("b", 0.68 + 0.001 * f), ("c", 0.2))]
    df = spark.createDataFrame(pos, "job_id int, frame_no long, t double, track_key string, cy double")
    got = {round(r.t * 30): (r.near, r.far) for r in identity.near_far(df, ["job_id"]).collect()}
    assert set(got.values()) == {("a", "c")}                        # b overtakes by less than the margin


SHOT = "job_id int, shot_id long, t0 double, t1 double, residual_px double, start_x double, start_y double, start_z double, end_x double, end_y double, end_z double"


def test_discontinuous_shots(spark):
    r, want, rows = random.Random(3), {}, []
    for job in range(5):
        t, shots = 0.0, []
        for i in range(20):
            t += r.uniform(0.3, 1.2)
            d = r.uniform(0.2, 0.9)
            shots.append((job, i, t, t + d, r.uniform(1, 30), *[r.uniform(0, 3) for _ in range(6)]))
            t += d - 0.3
        rows += shots
        left = list(shots)
        while True:
            bad = next((i for i in range(len(left) - 1) if left[i + 1][2] - left[i][3] <= 0.4 and math.dist(left[i][8:11], left[i + 1][5:8]) > 2.0), None)
            if bad is None:
                break
            left.pop(bad if left[bad][4] >= left[bad + 1][4] else bad + 1)
        want[job] = {s[1] for s in left}
    got = {}
    for x in quality.prune_discontinuous(spark.createDataFrame(rows, SHOT), ["job_id"]).collect():
        got.setdefault(x.job_id, set()).add(x.shot_id)
    assert got == want


POSE = "job_id int, player_id int, row_id long, t double, keypoints array<struct<x:double,y:double,confidence:double>>"


def person(cx, cy, **moved):
    kp = [[cx, cy - 0.1 + 0.012 * j, 0.9] for j in range(17)]
    for j, (dx, dy) in moved.items():
        kp[int(j[1:])][0] += dx
        kp[int(j[1:])][1] += dy
    return [tuple(k) for k in kp]


def test_pose_teleport_is_rejected_then_reseeded(spark):
    frames = [person(0.5, 0.5, **({"k9": (0.9, 0.0)} if 5 <= f < 12 else {})) for f in range(16)]
    df = spark.createDataFrame([(0, 1, f, f / 6, k) for f, k in enumerate(frames)], POSE)
    got = {r.row_id: (r.seg, list(r.bad_joint), list(r.bad_limb), r.keypoints[9]) for r in cleaning.sanitize_pose(df, ["job_id"]).collect()}
    assert all(v[0] == 0 for v in got.values())
    assert [9 in got[f][1] for f in range(5, 8)] == [True] * 3          # three rejections
    assert got[5][3].confidence == 0.0 and got[5][3].rejected
    assert 9 not in got[4][1] and not got[4][3].rejected


def test_pose_identity_change_and_long_absence_start_segments(spark):
    rows = [(0, 1, f, f / 6, person(0.3, 0.5)) for f in range(4)] + [(0, 1, 4 + f, (4 + f) / 6, person(0.8, 0.5)) for f in range(4)] + [(0, 1, 8, 9.0, person(0.8, 0.5))]
    got = {r.row_id: (r.seg, r.jump) for r in cleaning.sanitize_pose(spark.createDataFrame(rows, POSE), ["job_id"]).collect()}
    assert [got[i][0] for i in range(9)] == [0] * 4 + [1] * 4 + [2]
    assert [i for i in got if got[i][1]] == [4]


def test_fold_behind_a_join_keeps_an_exchange_of_its_own(spark):
    # without one, the rows lie as the join left them, and a join that becomes a broadcast while the query runs leaves them anyhow
    from courtlake.operators.folds import ordered_fold

    d = spark.range(4000).selectExpr("id % 50 as k", "id % 2 as part", "id as pid")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = d.join(d.groupBy("k", "part").agg(F.max("pid").alias("m")), ["k", "part"])
        out = ordered_fold(joined, ["k", "part"], ["pid"], lambda rows: [(sum(1 for _ in rows),)], "n long", ["pid"])
        assert "REPARTITION_BY_COL" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.k, r.n) for r in out.collect()) == [(k, 80) for k in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_step_length_is_the_root_of_the_sum_of_squares(spark):
    # steps that hypot and the root of the sum of squares set on different sides of the widest gate
    circle = ((0.6 * math.cos(a / 999), 0.6 * math.sin(a / 999)) for a in range(1500))
    far = [(dx, dy) for dx, dy in circle if (math.hypot(dx, dy) > 0.6) != (math.sqrt(dx * dx + dy * dy) > 0.6)]
    assert far
    rows = [(n, 10.0 * k, 2 * n + k, 1, dx * k, dy * k, 0.3) for n, (dx, dy) in enumerate(far) for k in (0, 1)]
    got = {r.job_id: r.bad for r in identity.accept_worker_ids(spark.createDataFrame(rows, DET), ["job_id"], tie=["det_id"]).collect()}
    assert got == {n: int(math.sqrt(dx * dx + dy * dy) > 0.6) for n, (dx, dy) in enumerate(far)}


def test_slots_equal_cost_tables():
    """The cheapest pair of the whole table first, as arrays have it, over frames with ties, missing values and more boxes than slots."""
    import random

    import numpy as np

    from courtlake.operators.identity import _cheapest_pairs, _remembered_slots

    rnd = random.Random(3)
    for _ in range(300):
        cost = np.array([[rnd.choice([0.1, 0.2, 0.3, np.inf]) for _ in range(rnd.choice([4]))] for _ in range(rnd.randint(1, 5))])
        left, want = cost.copy(), {}
        while np.isfinite(left.min()):
            i, j = np.unravel_index(left.argmin(), left.shape)
            want[int(i)] = int(j)
            left[i, :] = left[:, j] = np.inf
        assert _cheapest_pairs([(c, i, j) for (i, j), c in np.ndenumerate(cost) if np.isfinite(c)]) == want
    box = lambda k, cx: {"cx": cx, "cy": 0.5, "h": 0.2, "det_id": k}
    frames = [(0.0, [box(1, 0.1), box(2, 0.9)]), (0.1, [box(3, 0.9), box(4, 0.1)]), (0.2, [box(5, None), box(6, 0.1), box(7, 0.5)]), (9.0, [box(8, 0.5)])]
    assert list(_remembered_slots(2, 0.22)(frames)) == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (6, 0), (7, 2), (8, 2)]
