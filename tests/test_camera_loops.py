"""Camera operators against direct loops."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.operators import camera, smoothing


def weights(win):
    k = np.hanning(win)
    return k / k.sum()


def hann(a, win):
    p = win // 2
    return np.convolve(np.concatenate([[a[0]] * p, a, [a[-1]] * p]), weights(win), mode="valid")


@pytest.fixture(scope="module")
def grid(spark):
    n = 150
    r = np.random.default_rng(1)
    rows = []
    for job in range(3):
        for i in range(n):
            t = i / 30
            shuttle = (0.5 + 0.38 * math.sin(3 * t + job), 0.36 + 0.22 * math.sin(5 * t)) if r.random() > 0.3 else (None, None)
            near = (0.5 + 0.24 * math.sin(t), 0.74, 0.06, 0.15) if r.random() > 0.1 else (None,) * 4
            far = (0.5 + 0.2 * math.cos(t), 0.30, 0.03, 0.07) if r.random() > 0.4 else (None,) * 4
            rows.append((job, i, *shuttle, *near, *far))
    cols = "job_id int, frame_no long, shu_x double, shu_y double, " + ", ".join(f"{p}_{c} double" for p in ("near", "far") for c in ("cx", "cy", "hw", "hh"))
    return spark.createDataFrame(rows, cols).cache()


CW, CH = 0.31640625, 1.0


def test_hann_with_tiny_tiles_equals_convolution(spark, monkeypatch):
    r = np.random.default_rng(0)
    xs = {k: r.random(n).tolist() for k, n in ((0, 200), (1, 5), (2, 1))}
    df = spark.createDataFrame([(k, i, x) for k, a in xs.items() for i, x in enumerate(a)], "k int, i long, x double")
    monkeypatch.setattr(smoothing.halo, "__defaults__", (16,))
    got = smoothing.hann(df, ["k"], "i", ["x"], 9).orderBy("k", "i").collect()
    for k, a in xs.items():
        assert [g.x for g in got if g.k == k] == pytest.approx(list(hann(np.array(a), 9)))


def _shift(x, y, z, need, pad=0.035):
    rx, ry = need
    if not rx and not ry:
        return x, y, z
    hw, hh = CW / (2 * z), CH / (2 * z)
    wx, wy = ((max(r) - min(r)) / 2 + pad if r else -math.inf for r in (rx, ry))
    if wx > hw or wy > hh:
        z = max(1.0, min(z, CW / (2 * wx) if rx else math.inf, CH / (2 * wy) if ry else math.inf))
        hw, hh = CW / (2 * z), CH / (2 * z)

    def hold(v, r, half):
        if r:
            lo, hi = max(r) + pad - half, min(r) - pad + half
            v = min(max(v, lo), hi) if lo <= hi else (min(r) + max(r)) / 2
        return min(max(v, half), 1 - half)

    return hold(x, rx, hw), hold(y, ry, hh), z


def test_contain(grid):
    got = smoothing.contain(grid.withColumns({"x": F.lit(0.4), "y": F.lit(0.5), "z": F.lit(1.6)}), ["job_id"], CW, CH).collect()
    rows = grid.collect()
    for job in range(3):
        fr = sorted((r for r in rows if r.job_id == job), key=lambda r: r.frame_no)
        need = []
        for r in fr:
            rx, ry = ([r.shu_x], [r.shu_y]) if r.shu_x is not None else ([], [])
            if r.near_cx is not None:
                rx = rx + [r.near_cx - r.near_hw * 0.6, r.near_cx + r.near_hw * 0.6]
                ry = ry + [r.near_cy - r.near_hh * 0.8, r.near_cy + r.near_hh * 0.8]
            need.append((rx, ry))
        path = [_shift(0.4, 0.5, 1.6, n) for n in need]
        path = list(zip(*[hann(np.array(c), 9) for c in zip(*path)]))
        path = [_shift(*p, n) for p, n in zip(path, need)]
        want = [(min(max(x, CW / (2 * z)), 1 - CW / (2 * z)), min(max(y, CH / (2 * z)), 1 - CH / (2 * z)), z) for x, y, z in path]
        mine = [(g.x, g.y, g.z) for g in sorted((g for g in got if g.job_id == job), key=lambda g: g.frame_no)]
        assert np.allclose(mine, want, atol=1e-9)


def test_follow_targets(spark, grid):
    ral = spark.createDataFrame([(0, 0.5, 0.5, 1.9, 0.2), (1, 0.1, 0.5, 1.6, 0.25), (2, 0.1, 0.1, 1.9, 0.2)], "job_id int, player_quality double, shuttle_quality double, z_rally double, band_lo double")
    got = camera.follow_targets(grid, ral, ["job_id"]).collect()
    assert {g.job_id for g in got} == {0, 1}                         # rally 2 is not trusted
    fit = lambda half: min(CW / 0.17, CH / (2 * max(half, 0.135)))
    for job, z_rally, band, led in ((0, 1.9, 0.2, False), (1, 1.6, 0.25, True)):
        fr = sorted((r for r in grid.collect() if r.job_id == job), key=lambda r: r.frame_no)

        def ext(r, p):
            c = [getattr(r, f"{p}_{n}") for n in ("cx", "cy", "hw", "hh")]
            return None if c[0] is None else (c[0] - c[2] - 0.05, c[0] + c[2] + 0.05, c[1] - c[3] - 0.10, c[1] + c[3] + 0.13)

        spans = []
        for r in fr:
            a = ext(r, "near") or ext(r, "far")
            if a:
                lo, hi = a[2:]
                if r.shu_y is not None:
                    lo, hi = min(lo, max(r.shu_y, band)), max(hi, max(r.shu_y, band))
                spans.append((hi - lo) / 2)
        z = max(1.0, min(fit(float(np.percentile(spans, 92))), z_rally))
        hw, hh = CW / (2 * z), CH / (2 * z)
        xy = []
        for r in fr:
            n, f = ext(r, "near"), ext(r, "far")
            a, s = n or f, (r.shu_x, None if r.shu_y is None else max(r.shu_y, band))
            both = n is not None and f is not None
            if s[0] is not None and a and not led:
                lo, hi = min(a[2], s[1]), max(a[3], s[1])
                if both and fit((max(hi, f[3]) - min(lo, f[2])) / 2) >= z * 0.85:
                    lo, hi = min(lo, f[2]), max(hi, f[3])
                p = 0.62 * s[0] + 0.38 * (a[0] + a[1]) / 2, (lo + hi) / 2
            elif s[0] is not None:
                p = s[0], 0.5 * s[1] + 0.5 * 0.55
            elif a:
                b = list(a)
                if both:
                    w = [min(n[0], f[0]), max(n[1], f[1]), min(n[2], f[2]), max(n[3], f[3])]
                    if min(CW / max(w[1] - w[0], 0.12), CH / max(w[3] - w[2], 0.18)) >= z * 0.85:
                        b = w
                p = (b[0] + b[1]) / 2, (b[2] + b[3]) / 2
            else:
                p = None
            xy.append(p and (min(max(p[0], hw), 1 - hw), min(max(p[1], hh), 1 - hh)))
        filled = []
        for i, p in enumerate(xy):
            before = next((q for q in reversed(xy[:i + 1]) if q), (0.5, 0.55))
            after = next((q for q in xy[i:] if q), (0.5, 0.55))
            filled.append(p or tuple((b + c) / 2 for b, c in zip(before, after)))
        want = np.array([hann(np.array(c), 17) for c in zip(*filled)]).T
        mine = [(g.x, g.y) for g in sorted((g for g in got if g.job_id == job), key=lambda g: g.frame_no)]
        assert np.allclose(mine, want, atol=1e-9) and all(abs(g.z - z) < 1e-9 for g in got if g.job_id == job)
