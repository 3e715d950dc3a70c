"""Nearest-time, bracketing and greedy time joins. Each is one union, one tiled scan: linear in the
rows on both sides, whatever the density or tolerance."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold
from .tiles import as_list, row_index, sessionize, shared, tile_scan


def _struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def nearest_time(left: DataFrame, right: DataFrame, on: Sequence[str], tol: float, tie: str = "first",
                 order: Sequence[str] = (), tile: Column | None = None) -> DataFrame:
    """JOIN-2: for each left row the right row with the smallest |dt|, or nulls beyond ``tol``.

    ``tie`` picks the earlier ("first") or later ("last") of equally near rows; ``order`` breaks ties
    between right rows at one time. Right columns other than keys come out prefixed ``r_``."""
    on = as_list(on)
    rcols = [c for c in right.columns if c not in on]
    rank = F.struct("t", *order)
    pick = F.min_by if tie == "first" else F.max_by
    r = right.groupBy(*on, "t").agg(pick(_struct(rcols), rank).alias("_r"))
    u = left.select(*on, "t", F.lit(1).alias("_side"), _struct(left.columns).alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    u = u.unionByName(r.select(*on, "t", F.lit(0).alias("_side"), F.lit(None).cast(u.schema["_l"].dataType).alias("_l"), "_r"))
    u = tile_scan(u, on, "t", tie=["_side"], ffill={"_before": F.col("_r")}, bfill={"_after": F.col("_r")}, tile=tile)
    d = u.filter(F.col("_side") == 1)
    d0, d1 = F.col("t") - F.col("_before.t"), F.col("_after.t") - F.col("t")
    early = d1.isNull() | (d0 <= d1 if tie == "first" else d0 < d1)
    d = d.withColumn("_m", F.when(d0.isNotNull() & early, F.col("_before")).otherwise(F.col("_after")))
    d = d.withColumn("dt", F.abs(F.col("_m.t") - F.col("t")))
    hit = F.col("dt") <= tol
    return d.select("_l.*", F.when(hit, F.col("dt")).alias("dt"), *[F.when(hit, F.col(f"_m.{c}")).alias(f"r_{c}") for c in rcols])


def bracket(grid: DataFrame, samples: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str] = (),
            grid_first: bool = True, tile: Column | None = None) -> DataFrame:
    """Structs ``a`` and ``b`` of the samples around each grid row. With ``grid_first`` a sample at the
    grid time counts as ``b``, else as ``a``."""
    on = as_list(on)
    s = samples.select(*on, "t", F.lit(1 if grid_first else 0).alias("_side"), *order, F.struct("t", *cols).alias("_s"))
    g = grid.select(*on, "t", F.lit(0 if grid_first else 1).alias("_side"), _struct(grid.columns).alias("_g"))
    u = g.unionByName(s, allowMissingColumns=True)
    u = tile_scan(u, on, "t", tie=["_side", *order], ffill={"a": F.col("_s")}, bfill={"b": F.col("_s")}, tile=tile)
    return u.filter(F.col("_g").isNotNull()).select("_g.*", "a", "b")


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a * (1 - w) + b * w


def interpolate_asof(grid: DataFrame, samples: DataFrame, on: Sequence[str], cols: Sequence[str], max_gap: float,
                     hold: float, order: Sequence[str] = (), tile: Column | None = None) -> DataFrame:
    """JOIN-3: linear interpolation across gaps up to ``max_gap``, else hold a side within ``hold``, else null."""
    d = bracket(grid, samples, on, cols, order, tile=tile)
    ta, tb, t = F.col("a.t"), F.col("b.t"), F.col("t")
    span = tb - ta
    w = F.when(span <= 1e-6, 0.0).otherwise((t - ta) / span)

    def value(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(span <= max_gap, lerp(a, b, w)).when(t - ta <= hold, a).when(tb - t <= hold, b)

    return d.withColumns({c: value(c) for c in cols}).drop("a", "b")


def interpolate_by_id(grid: DataFrame, frames: DataFrame, on: Sequence[str], cols: Sequence[str], id: str = "id",
                      max_gap: float = 0.9, hold: float = 0.3, window: float = 0.6, seg: str | None = None) -> DataFrame:
    """JOIN-4: boxes or joints per id between two frames. An id seen on both sides is interpolated (not
    across a change of ``seg``); an id seen on one side shows only close to its frame and on its half."""
    on = as_list(on)
    frames = shared(frames.select(*on, "t", F.col("t").alias("_at"), id, *cols, "confidence", *([seg] if seg else [])), [*on, "t"])
    times = frames.select(*on, F.col("_at").alias("t")).distinct()      # off the packed copy, as all that read the frames
    frames = frames.drop("_at")
    g = bracket(grid.select(*on, "t").distinct(), times, on, [], grid_first=False)
    g = g.join(times.groupBy(*on).agg(F.min("t").alias("_first")), on)
    t = F.col("t")
    g = g.withColumns({"ta": F.coalesce("a.t", "b.t"), "tb": F.when(t <= F.col("_first"), F.coalesce("a.t", "b.t"))
                       .otherwise(F.coalesce("b.t", "a.t"))}).drop("a", "b", "_first")
    joined = (F.col("tb") > F.col("ta")) & (F.col("tb") - F.col("ta") <= max_gap)
    near = F.when(F.abs(F.col("ta") - t) <= F.abs(F.col("tb") - t), F.col("ta")).otherwise(F.col("tb"))
    g = g.withColumns({"_joined": joined, "_near": F.when(~joined & (F.abs(near - t) <= window), near)})
    out = [*on, "t", id, *cols, "confidence"]
    held = g.filter("_near is not null").select(*on, "t", "_near").join(
        frames.withColumnRenamed("t", "_near"), [*on, "_near"]).select(*out)
    pairs = g.filter("_joined").select(*on, "t", "ta", "tb")
    sides = {}
    for side, at in (("A", "ta"), ("B", "tb")):
        s = pairs.join(frames.withColumnRenamed("t", at), [*on, at]).select(
            *on, "t", id, "ta", "tb", F.struct(*cols, "confidence", *([seg] if seg else [])).alias(side))
        sides[side] = s
    key = [*on, "t", id, "ta", "tb"]
    m = sides["A"].join(sides["B"], key, "full")
    da, db, half = t - F.col("ta"), F.col("tb") - t, (F.col("tb") - F.col("ta")) / 2
    hold_a, hold_b = (da <= hold) & (da <= half), (db <= hold) & (db < half)
    both = F.col("A").isNotNull() & F.col("B").isNotNull()
    if seg:
        both = both & (F.col(f"A.{seg}") == F.col(f"B.{seg}"))
    k = da / (F.col("tb") - F.col("ta"))
    mixed = F.struct(*[(F.col(f"A.{c}") + (F.col(f"B.{c}") - F.col(f"A.{c}")) * k).alias(c) for c in cols],
                     F.least("A.confidence", "B.confidence").alias("confidence"))
    plain = {s: F.struct(*[F.col(f"{s}.{c}") for c in (*cols, "confidence")]) for s in "AB"}
    shown = F.array_compact(F.when(F.coalesce(both, F.lit(False)), F.array(mixed)).otherwise(F.array(
        F.when(F.col("A").isNotNull() & hold_a, plain["A"]), F.when(F.col("B").isNotNull() & hold_b, plain["B"]))))
    return m.select(*on, "t", id, F.inline(shown)).unionByName(held)


def greedy_match(pred: DataFrame, gt: DataFrame, on: Sequence[str], tol: float, id: str = "id") -> DataFrame:
    """JOIN-6: each label in time order takes the closest unused prediction within ``tol``; ties go to
    the later one. Labels and predictions further apart than ``tol`` cannot meet, so tracks are cut
    there and the pieces matched in parallel."""
    on = as_list(on)
    u = (gt.select(*on, "t", F.col(id).alias("_id"), F.lit(1).alias("_gt"))
         .union(pred.select(*on, "t", F.col(id).alias("_id"), F.lit(0).alias("_gt"))))
    u = sessionize(u, on, "t", tol, tie=["_gt", "_id"], seg="_piece")

    def match(rows):
        waiting, free = [], []      # labels not settled yet, predictions not taken (both in time order)

        def settle(now):
            while waiting and waiting[0][0] + tol < now:
                t, gid = waiting.pop(0)
                best = None
                for i, (pt, _) in enumerate(free):
                    d = abs(pt - t)
                    if d <= tol and (best is None or d <= best[0]):
                        best = (d, i)
                if best is not None:
                    _, pid = free.pop(best[1])
                    yield pid, gid, best[0]

        for t, rid, is_gt in rows:
            yield from settle(t)
            oldest = waiting[0][0] if waiting else t
            free[:] = [p for p in free if p[0] >= min(oldest, t) - tol]
            (waiting if is_gt else free).append((t, rid))
        yield from settle(float("inf"))

    d = ordered_fold(u, [*on, "_piece"], ["t", "_gt", "_id"], match, "pred_id long, gt_id long, dt double", ["t", "_id", "_gt"])
    return d.drop("_piece")


def shot_position_at(grid: DataFrame, shots: DataFrame, samples: DataFrame, on: Sequence[str] = ("job_id",), slack: float = 0.05,
                     court_w: float = 6.1) -> DataFrame:
    """JOIN-20: position inside the first shot whose window holds the grid time."""
    from .intervals import events_in

    on = as_list(on)
    spans = shots.select(*on, "shot_id", "t0", "t1", "mirrored")
    cand = events_in(spans, grid.select(*on, "t"), on, pad=slack, start="t0", end="t1", width=30.0)
    first = cand.groupBy(*on, "t").agg(F.min_by(F.struct("shot_id", "mirrored"), F.struct("t0", "shot_id")).alias("s"))
    g = first.select(*on, "s.shot_id", "s.mirrored", "t")
    d = bracket(g, samples.select(*on, "shot_id", "t", "x", "y", "z"), [*on, "shot_id"], ["x", "y", "z"], grid_first=False)
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    k = F.when(b["t"] > a["t"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - a["t"]) / (b["t"] - a["t"])))).otherwise(0.0)
    pos = {c: a[c] + (b[c] - a[c]) * k for c in "xyz"}
    d = d.select(*on, "t", "shot_id", "mirrored", *[v.alias(c) for c, v in pos.items()])
    return d.withColumn("x", F.when(F.col("mirrored"), court_w - F.col("x")).otherwise(F.col("x"))).drop("mirrored")


def fill_unseen(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], default: dict[str, float],
                tie: Sequence[str] = ()) -> DataFrame:
    """WIN-29: an unseen value becomes the mean of the last and next seen ones, each falling back to a default."""
    d = tile_scan(df, keys, t, tie=tie, ffill={f"_f_{c}": F.col(c) for c in cols}, bfill={f"_b_{c}": F.col(c) for c in cols})
    fill = {c: F.coalesce(c, (F.coalesce(f"_f_{c}", F.lit(default[c])) + F.coalesce(f"_b_{c}", F.lit(default[c]))) / 2) for c in cols}
    return d.withColumns(fill).select(*df.columns)


CROWD, CLOSE = 64, 1 / 8         # rows of a frame beyond which boxes meet in cells, first those within a part of the radius, and that part


def nearest_within(left: DataFrame, right: DataFrame, on: Sequence[str], radius: float, left_id: str | Sequence[str], right_id: str) -> DataFrame:
    """Each row of ``left`` (x, y, ids of its own within ``on``) with the closest row of ``right`` of the same ``on``, as the struct ``p``, and their ``dist``;
    ties, to nine places, go to the larger ``right_id``; rows without one within ``radius`` go.

    In a frame of few rows all meet. In a crowded frame both sides meet in square cells, and small ones come first: what has a partner
    within an eighth of the radius needs no wider search, so that a row meets a few neighbours and not all rows within the radius."""
    on, ids = as_list(on), as_list(left_id)
    columns = left.columns
    right = right.select(*on, F.col(right_id).alias("_pid"), F.struct("*").alias("p"))
    crowd = right.groupBy(*on).agg(F.count("*").alias("_m"))
    left = left.join(crowd, on)

    def first(d: DataFrame, r: float) -> DataFrame:
        dx, dy = F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y")
        d = d.withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= r)
        w = Window.partitionBy(*on, *ids).orderBy(F.round("dist", 9).asc(), F.desc("_pid"))
        return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*columns, "p", "dist")

    def closest(d: DataFrame, r: float) -> DataFrame:
        reach = r * (1 + 1e-9)                                      # a cell is as wide as what it is searched for, so two of them hold it
        cell = lambda c, by=0.0: F.floor((c + by) / (2 * reach))
        around = lambda c: F.explode(F.sequence(cell(F.col(c), -reach), cell(F.col(c), reach)))
        p = right.join(crowd.filter(F.col("_m") > CROWD).select(*on), on, "left_semi").withColumns({"_cx": cell(F.col("p.x")), "_cy": cell(F.col("p.y"))})
        return first(d.withColumn("_cx", around("x")).withColumn("_cy", around("y")).join(p, [*on, "_cx", "_cy"]), r)

    crowded = left.filter(F.col("_m") > CROWD)
    near = closest(crowded, radius * CLOSE).filter(F.col("dist") < radius * CLOSE - 1e-9)      # what ties with it lies within the search too
    far = closest(crowded.join(near.select(*on, *ids), [*on, *ids], "left_anti"), radius)
    return first(left.filter(F.col("_m") <= CROWD).join(right, on), radius).unionByName(near).unionByName(far)


def nearest_center(pred: DataFrame, gt: DataFrame, on: Sequence[str], max_dist: float, pred_id: str = "id", gt_id: str = "gt_id") -> DataFrame:
    """JOIN-7: per labelled box the closest predicted box of the same frame; ties go to the later one."""
    return nearest_within(gt, pred, on, max_dist, gt_id, pred_id)


def grid_times(spans: DataFrame, keys: Sequence[str], fps: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Frame times t0 + i / fps covering each span, at least two frames."""
    n = F.greatest(F.lit(2), F.round((F.col(end) - F.col(start)) * fps).cast("int"))
    return spans.select(*as_list(keys), F.col(start).alias("_t0"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_no")).select(
        *as_list(keys), "frame_no", (F.col("_t0") + F.col("frame_no") / F.lit(float(fps))).alias("t"))


__all__ = ["nearest_time", "bracket", "lerp", "interpolate_asof", "interpolate_by_id", "greedy_match", "shot_position_at",
           "fill_unseen", "nearest_center", "grid_times", "row_index"]
