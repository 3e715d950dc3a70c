"""Filters along a track or a camera path."""
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .folds import ordered_fold, tiled_fold
from .tiles import TILE, as_list, lay_out, row_index, sessionize

FRAMES_PER_TILE = 4096


def one_euro(df: DataFrame, keys: Sequence[str], cols: Sequence[str], id: str = "pid", min_cutoff: float = 1.0, beta: float = 1.5,
             d_cutoff: float = 1.0, reset: float = 1.5, min_conf: float = 0.15) -> DataFrame:
    """WIN-14: adaptive low-pass per series. Faint rows pass through and do not feed the filter; an absence
    over ``reset`` starts a fresh filter, so series are cut there and filtered in parallel."""
    keys = as_list(keys)
    fed = F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_conf
    d = sessionize(df.select(*keys, "t", "confidence", id, *cols).filter(fed), keys, "t", reset, tie=[id], seg="_piece")

    def alpha(dt, cutoff):
        return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * max(cutoff, 1e-6)) / max(dt, 1e-6))

    def walk(rows):
        last = None
        for t, rid, *xs in rows:
            if last is None or t <= last:
                ys, speeds = list(xs), [0.0] * len(xs)
            else:
                dt = t - last
                for i, x in enumerate(xs):
                    speeds[i] += alpha(dt, d_cutoff) * ((x - ys[i]) / dt - speeds[i])
                    ys[i] += alpha(dt, min_cutoff + beta * abs(speeds[i])) * (x - ys[i])
            last = t
            yield (rid, *ys)

    out = ordered_fold(d, [*keys, "_piece"], ["t", id], walk, f"{id} long, " + ", ".join(f"_{c} double" for c in cols), ["t", id, *cols])
    return df.join(out.drop("_piece"), [*keys, id], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*df.columns)


def halo(df: DataFrame, keys: Sequence[str], idx: str, reach: int, size: int = FRAMES_PER_TILE) -> DataFrame:
    """Cut each group into tiles of ``size`` positions and copy ``reach`` border rows into the
    neighbouring tiles, so a centred frame can be computed per tile. ``_own`` marks originals."""
    own = F.floor(F.col(idx) / size)
    tiles = F.array_distinct(F.array(own, F.floor((F.col(idx) - reach) / size), F.floor((F.col(idx) + reach) / size)))
    return df.withColumn("_tile", F.explode(F.filter(tiles, lambda t: t >= 0))).withColumn("_own", F.col("_tile") == own)


def _centred(df, keys, t, reach, make, tie=()):
    keys = as_list(keys)
    d = halo(row_index(df, keys, t, tie=tie, out="_i"), keys, "_i", reach)
    w = Window.partitionBy(*keys, "_tile").orderBy("_i")
    return d.withColumns(make(w)).filter("_own").drop("_i", "_tile", "_own")


def rolling_min(df: DataFrame, keys: Sequence[str], t: str, col: str, w: int, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-26: minimum over ``w`` rows to each side."""
    return _centred(df, keys, t, w, lambda win: {f"{col}_min": F.min(col).over(win.rowsBetween(-w, w))}, tie)


def rolling_max(df: DataFrame, keys: Sequence[str], t: str, col: str, w: int, tie: Sequence[str] = ()) -> DataFrame:
    return _centred(df, keys, t, w, lambda win: {f"{col}_max": F.max(col).over(win.rowsBetween(-w, w))}, tie)


def hann_weights(win: int) -> list[float]:
    win += 1 - win % 2
    raw = [0.5 - 0.5 * math.cos(2 * math.pi * i / (win - 1)) for i in range(win)]
    return [r / sum(raw) for r in raw]


def hann(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str] | str, win: int = 11, tie: Sequence[str] = ()) -> DataFrame:
    """WIN-27: centred Hann average; the ends repeat the first and last value."""
    keys, cols = as_list(keys), as_list(cols)
    weights = hann_weights(win)
    half = len(weights) // 2

    def make(w):
        # with the halo a neighbour is missing only at a group's own ends, where the tile's end is the group's
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def mean(c):
            ends = {True: F.first(c).over(whole), False: F.last(c).over(whole)}
            terms = [(F.coalesce(F.lag(c, -j).over(w), ends[j < 0]) if j else F.col(c)) * F.lit(weights[j + half])
                     for j in range(-half, half + 1) if weights[j + half] > 0]
            return sum(terms[1:], terms[0])

        return {c: mean(c) for c in cols}

    return _centred(df, keys, t, half, make, tie)


def hann_short(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], most: int) -> DataFrame:
    """The same average for groups of fewer than ``most`` rows, over a window as long as the group (odd, 3 at least). A group is
    so short that it is held as one array."""
    keys, cols = as_list(keys), as_list(cols)
    rest = [c for c in df.columns if c not in (*keys, t)]
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(t, *rest))).alias("_r")).filter(F.size("_r") < most)
    n = F.size("_r")
    half = F.floor(F.greatest(F.lit(3), n + 1 - n % 2) / 2).cast("int")
    offsets = F.sequence(-half, half)
    weight = lambda j: 0.5 - 0.5 * F.cos(math.pi * (j + half) / half)
    total = F.aggregate(offsets, F.lit(0.0), lambda a, j: a + weight(j))

    def mean(i, c):
        value = lambda j: F.get("_r", F.greatest(F.lit(0), F.least(i + j, n - 1)))[c]
        return F.aggregate(offsets, F.lit(0.0), lambda a, j: a + weight(j) * value(j)) / total

    rows = F.transform("_r", lambda r, i: F.struct(r[t].alias(t), *[(mean(i, c) if c in cols else r[c]).alias(c) for c in rest]))
    return g.select(*keys, F.inline(rows)).select(*df.columns)


def ema(df: DataFrame, keys: Sequence[str], t: str, col: str, alpha: float = 0.20, id: str = "pid") -> DataFrame:
    """WIN-28: a += alpha * (x - a), starting at the first value. A run of rows acts on ``a`` as a * p + q."""
    keys = as_list(keys)

    def summarize(rows):
        p, q = 1.0, 0.0
        for _, x in rows:
            p, q = p * (1 - alpha), q * (1 - alpha) + alpha * x
        return p, q

    def walk(s, r):
        a = s[0] + alpha * (r[1] - s[0])
        return [a], (r[0], a)

    df = lay_out(df, keys, t)
    d = row_index(df.select(*keys, t, id, col, TILE), keys, t, tie=[id], out="_i").drop(TILE)
    df = df.drop(TILE)
    out = tiled_fold(d, keys, "_i", summarize, lambda s, f: [s[0] * f[0] + f[1]], walk, lambda r: [r[1]], "array<double>", f"{id} long, {col}_ema double", [id, col])
    return df.join(out, [*keys, id])


def rate_limit(df: DataFrame, keys: Sequence[str], t: str, col: str, step: float, id: str = "pid") -> DataFrame:
    """WIN-28: follow a series with at most ``step`` change per row."""

    def walk(rows):
        a = None
        for rid, x in rows:
            a = x if a is None else a + max(-step, min(step, x - a))
            yield rid, a

    out = ordered_fold(df, as_list(keys), [t, id], walk, f"{id} long, {col}_limited double", [id, col])
    return df.join(out, [*as_list(keys), id])


def ramp(df: DataFrame, keys: Sequence[str], t: str, flag: str, step: float = 0.12, id: str = "pid") -> DataFrame:
    """WIN-33: a 0..1 ramp that rises while ``flag`` holds and falls otherwise; 0 on the first row. A run of rows
    acts as clamp(r + c, lo, hi)."""
    keys = as_list(keys)

    def bounded(f, on):
        c, lo, hi = f
        if on:
            return c + step, min(1.0, lo + step), min(1.0, hi + step)
        return c - step, max(0.0, lo - step), max(0.0, hi - step)

    def summarize(rows):
        f = (0.0, 0.0, 1.0)
        for _, on in rows:
            f = bounded(f, on)
        return f

    def walk(s, r):
        v = max(0.0, min(1.0, s[0] + (step if r[1] else -step)))
        return [v], (r[0], v)

    df = lay_out(df, keys, t)
    d = row_index(df.select(*keys, t, id, flag, TILE), keys, t, tie=[id], out="_i").drop(TILE)
    df = df.drop(TILE)
    # the first row shows 0 whatever its flag: start one step below or above it
    out = tiled_fold(d.withColumn(flag, F.when(F.col("_i") == 0, F.lit(False)).otherwise(F.col(flag))), keys, "_i", summarize,
                     lambda s, f: [max(f[1], min(f[2], s[0] + f[0]))], walk, lambda r: [0.0], "array<double>", f"{id} long, ramp double", [id, flag])
    return df.join(out, [*keys, id])


def switch_active(df: DataFrame, keys: Sequence[str], t: str, a: str, b: str, ratio: float = 1.35, frames: int = 6, id: str = "pid") -> DataFrame:
    """WIN-33: the busier of two players, changing only after ``frames`` clearly busier rows in a row. The state is
    one of 2 * frames values, so a run of rows acts as a table from state to state."""
    keys = as_list(keys)

    def move(s, ea, eb):
        cur, run = divmod(int(s), frames)
        mine, other = (ea, eb) if cur == 0 else (eb, ea)
        run = run + 1 if other > ratio * mine else 0
        return (1 - cur) * frames if run >= frames else cur * frames + run

    def summarize(rows):
        table = list(range(2 * frames))
        for _, ea, eb in rows:
            table = [move(s, ea, eb) for s in table]
        return [float(s) for s in table]

    def walk(s, r):
        n = move(s[0], r[1], r[2])
        return [float(n)], (r[0], n // frames)

    df = lay_out(df, keys, t)
    d = row_index(df.select(*keys, t, id, a, b, TILE), keys, t, tie=[id], out="_i").drop(TILE)
    df = df.drop(TILE)
    out = tiled_fold(d, keys, "_i", summarize, lambda s, f: [f[int(s[0])]], walk, lambda r: [0.0 if r[1] >= r[2] else float(frames)], "array<double>",
                     f"{id} long, active int", [id, a, b])
    return df.join(out, [*keys, id])


def _shift(d: DataFrame, cw: float, ch: float, pad: float, soft: bool) -> DataFrame:
    """Zoom out and move the crop just enough to hold the required extents of each frame."""
    inf = float("inf")
    sx, sy = (F.lit(None).cast("double") if soft else F.col(c) for c in ("shu_x", "shu_y"))
    side = F.lit(None).cast("double") if soft else F.col("near_hw") * 0.6
    up = F.col("near_hh") * 0.8
    lo_x, hi_x = F.least(sx, F.col("near_cx") - side), F.greatest(sx, F.col("near_cx") + side)
    lo_y, hi_y = F.least(sy, F.col("near_cy") - up), F.greatest(sy, F.col("near_cy") + up)
    d = d.withColumns({"_lx": lo_x, "_hx": hi_x, "_ly": lo_y, "_hy": hi_y})

    def need(axis: str):
        return F.coalesce((F.col(f"_h{axis}") - F.col(f"_l{axis}")) / 2 + pad, F.lit(-inf))

    fit = F.least(*[F.when(need(a) > -inf, c / (2 * need(a))).otherwise(F.lit(inf)) for a, c in (("x", cw), ("y", ch))])
    tight = (need("x") > cw / (2 * F.col("z"))) | (need("y") > ch / (2 * F.col("z")))
    d = d.withColumn("z", F.when(tight, F.greatest(F.lit(1.0), F.least(F.col("z"), fit))).otherwise(F.col("z")))
    any_ = F.col("_lx").isNotNull() | F.col("_ly").isNotNull()

    def moved(c: str, size: float):
        half = size / (2 * F.col("z"))
        lo, hi = F.col(f"_h{c}") + pad - half, F.col(f"_l{c}") - pad + half
        at = F.when(F.col(f"_l{c}").isNull(), F.col(c)).when(lo <= hi, clamp(F.col(c), lo, hi)).otherwise((F.col(f"_l{c}") + F.col(f"_h{c}")) / 2)
        return F.when(any_, clamp(at, half, 1 - half)).otherwise(F.col(c))

    return d.withColumns({"x": moved("x", cw), "y": moved("y", ch)}).drop("_lx", "_hx", "_ly", "_hy")


def contain(path: DataFrame, keys: Sequence[str], cw: float, ch: float, pad: float = 0.035, win: int = 9, soft: bool = False,
            t: str = "frame_no") -> DataFrame:
    """WIN-32: keep the shuttle and the near player inside the crop: shift, smooth, shift again. The path
    carries x, y, z and the frame's shu_x, shu_y, near_cx, near_cy, near_hw, near_hh (null = absent)."""
    d = _shift(path, cw, ch, pad, soft)
    d = _shift(hann(d, keys, t, ["x", "y", "z"], win), cw, ch, pad, soft)
    return d.withColumns({"x": clamp(F.col("x"), cw / (2 * F.col("z")), 1 - cw / (2 * F.col("z"))),
                          "y": clamp(F.col("y"), ch / (2 * F.col("z")), 1 - ch / (2 * F.col("z")))})
