"""Court plane, boxes and virtual-camera arithmetic as Column expressions."""
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, col, field

# Doubles court, far-left corner is the origin.
COURT_W, COURT_L = 6.10, 13.40
NET_Y = COURT_L / 2
OUT_W, OUT_H = 1080, 1920


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; without it nested formulas repeat their inputs and
    outgrow generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def court_project(h, x, y) -> Column:
    """FN-1: struct(u, v) in court metres; (0, 0) when the point is at infinity."""
    h, x, y = col(h), col(x), col(y)
    w = h[6] * x + h[7] * y + h[8]
    far = F.abs(w) < 1e-9
    return F.struct(
        F.when(far, 0.0).otherwise((h[0] * x + h[1] * y + h[2]) / w).alias("u"),
        F.when(far, 0.0).otherwise((h[3] * x + h[4] * y + h[5]) / w).alias("v"),
    )


def quad_homography(corners) -> Column:
    """FN-2: row-major image-to-court homography from four corners in the order far-left, far-right,
    near-right, near-left. Projective map of the unit square onto the quad, inverted by its
    adjugate and scaled to metres. Null for a degenerate quad."""
    def solve(q: Column) -> Column:
        dx1, dx2, sx = q["x1"] - q["x2"], q["x3"] - q["x2"], q["x0"] - q["x1"] + q["x2"] - q["x3"]
        dy1, dy2, sy = q["y1"] - q["y2"], q["y3"] - q["y2"], q["y0"] - q["y1"] + q["y2"] - q["y3"]
        den = F.nullif(dx1 * dy2 - dx2 * dy1, F.lit(0.0))
        return F.struct(q["x0"].alias("c"), q["y0"].alias("f"), q["x1"].alias("x1"), q["x3"].alias("x3"), q["y1"].alias("y1"), q["y3"].alias("y3"),
                        ((sx * dy2 - dx2 * sy) / den).alias("g"), ((dx1 * sy - sx * dy1) / den).alias("k"))

    def linear(m: Column) -> Column:
        a, b = m["x1"] - m["c"] + m["g"] * m["x1"], m["x3"] - m["c"] + m["k"] * m["x3"]
        d, e = m["y1"] - m["f"] + m["g"] * m["y1"], m["y3"] - m["f"] + m["k"] * m["y3"]
        return F.struct(a.alias("a"), b.alias("b"), m["c"].alias("c"), d.alias("d"), e.alias("e"), m["f"].alias("f"), m["g"].alias("g"), m["k"].alias("k"))

    def inverse(m: Column) -> Column:
        a, b, c, d, e, f, g, k = (m[n] for n in "abcdefgk")
        scale = F.nullif(a * e - b * d, F.lit(0.0))
        rows = [[COURT_W * (e - f * k), COURT_W * (c * k - b), COURT_W * (b * f - c * e)],
                [COURT_L * (f * g - d), COURT_L * (a - c * g), COURT_L * (c * d - a * f)],
                [d * k - e * g, b * g - a * k, scale]]
        h = F.array(*[v / scale for r in rows for v in r])
        return F.when(scale.isNotNull() & g.isNotNull(), h)

    q = col(corners)
    quad = F.struct(*[q[i][j].alias(f"{n}{i}") for i in range(4) for j, n in enumerate("xy")])
    return let(let(let(quad, solve), linear), inverse)


def net_line(h) -> Column:
    """FN-6: image end points [x1, y1, x2, y2] of the net, from the inverse homography (adjugate)."""
    def ends(h: Column) -> Column:
        adj = [
            h[4] * h[8] - h[5] * h[7], h[2] * h[7] - h[1] * h[8], h[1] * h[5] - h[2] * h[4],
            h[5] * h[6] - h[3] * h[8], h[0] * h[8] - h[2] * h[6], h[2] * h[3] - h[0] * h[5],
            h[3] * h[7] - h[4] * h[6], h[1] * h[6] - h[0] * h[7], h[0] * h[4] - h[1] * h[3],
        ]
        out = []
        for u in (0.0, COURT_W):
            x, y, w = (adj[3 * r] * u + adj[3 * r + 1] * NET_Y + adj[3 * r + 2] for r in range(3))
            out += [x / F.nullif(w, F.lit(0.0)), y / F.nullif(w, F.lit(0.0))]
        return F.array(*out)

    return let(col(h), ends)


def centroid(corners) -> tuple[Column, Column]:
    c = col(corners)
    return tuple(sum((c[i][axis] for i in range(1, 4)), c[0][axis]) / 4.0 for axis in (0, 1))


def expand_quad(corners, expand: float, pad: float = 0.0) -> Column:
    """FN-3 helper: quad scaled about its centroid, pushed out by ``pad``, ordered by angle."""
    cx, cy = centroid(corners)

    def grow(p: Column) -> Column:
        dx, dy = p[0] - cx, p[1] - cy
        r = F.hypot(dx, dy)
        r = F.when(r == 0, 1.0).otherwise(r)
        x, y = cx + dx * expand + dx / r * pad, cy + dy * expand + dy / r * pad
        return F.struct(F.atan2(y - cy, x - cx).alias("a"), x.alias("x"), y.alias("y"))

    return F.array_sort(F.transform(col(corners), grow))


def inside_quad(poly, x, y) -> Column:
    """FN-3: inside a convex ring of struct(a, x, y): all edge cross products share a sign."""
    p, x, y = col(poly), col(x), col(y)

    def cross(i: int) -> Column:
        a, b = p[i], p[(i + 1) % 4]
        return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

    cs = [cross(i) for i in range(4)]
    pos = reduce(lambda m, n: m | n, [c >= 1e-12 for c in cs])
    neg = reduce(lambda m, n: m | n, [c <= -1e-12 for c in cs])
    return ~(pos & neg)


def quad_area(corners) -> Column:
    """FN-4: shoelace area."""
    c = col(corners)
    terms = [c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in range(4)]
    return F.abs(sum(terms[1:], terms[0])) / 2.0


def valid_quad(corners) -> Column:
    c = col(corners)
    near_frame = F.forall(c, lambda p: p[0].between(-0.15, 1.15) & p[1].between(-0.15, 1.15))
    return F.coalesce((F.size(c) == 4) & near_frame & (quad_area(c) >= 0.10), F.lit(False))


def valid_corners(corners, lo: float = -0.75, hi: float = 1.75, min_w: float = 0.15, min_h: float = 0.10) -> Column:
    """PRJ-4: user-drawn corners rounded to 4 places, or null when they cannot be a court."""
    def judge(c: Column) -> Column:
        span = [F.array_max(F.transform(c, field(a))) - F.array_min(F.transform(c, field(a))) for a in (0, 1)]
        return F.when((span[0] >= min_w) & (span[1] >= min_h), c)

    c = col(corners)
    within = (F.size(c) == 4) & F.forall(c, lambda p: p[0].between(lo, hi) & p[1].between(lo, hi))
    return F.when(within, let(F.transform(c, lambda p: F.array(F.bround(p[0], 4), F.bround(p[1], 4))), judge))


# -- boxes (FN-7, FN-8) ------------------------------------------------------------------------
def xyxy(x, y, w, h) -> Column:
    x, y, w, h = map(col, (x, y, w, h))
    return F.struct((x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"))


def xywh(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    zero = F.lit(0.0)
    return F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"),
                    F.greatest(zero, x2 - x1).alias("w"), F.greatest(zero, y2 - y1).alias("h"))


def box_foot(x1, y1, x2, y2) -> Column:
    return F.struct(((col(x1) + col(x2)) / 2).alias("x"), col(y2).alias("y"))


def box_area(x1, y1, x2, y2) -> Column:
    return (col(x2) - col(x1)) * (col(y2) - col(y1))


def iou(a: Sequence, b: Sequence) -> Column:
    """FN-8: overlap of two (x1, y1, x2, y2) boxes; 0 when they do not meet."""
    a, b = [col(v) for v in a], [col(v) for v in b]
    zero = F.lit(0.0)
    inter = (F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
             * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])))
    union = box_area(*a) + box_area(*b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def pose_center(keypoints, min_conf: float = 0.05) -> Column:
    """FN-7: mean of confident keypoints, null without any."""
    pts = F.filter(col(keypoints), lambda k: k["confidence"] >= min_conf)

    def mean(axis: str) -> Column:
        total = F.aggregate(pts, F.lit(0.0), lambda acc, k: acc + k[axis])
        return F.try_divide(total, F.size(pts))

    return F.when(F.size(pts) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def pose_height(keypoints, box_h=None, min_conf: float = 0.05) -> Column:
    """FN-7: box height, else the confident keypoints' span, else 0.25."""
    ys = F.transform(F.filter(col(keypoints), lambda k: k["confidence"] >= min_conf), lambda k: k["y"])
    span = F.when(F.size(ys) >= 2, F.array_max(ys) - F.array_min(ys)).otherwise(0.25)
    return span if box_h is None else F.when(col(box_h) > 0, col(box_h)).otherwise(span)


# -- motion (FN-9) -----------------------------------------------------------------------------
def speed(dx, dy, dt) -> Column:
    return F.hypot(col(dx), col(dy)) / col(dt)


def turn_cos(ax, ay, bx, by) -> Column:
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    return F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))


# -- virtual camera (FN-10..12, FN-17) ---------------------------------------------------------
def crop_norms(w, h) -> Column:
    """FN-12: 9:16 crop as a fraction of the frame, struct(cw, ch)."""
    w, h, a = col(w).cast("double"), col(h).cast("double"), OUT_W / OUT_H
    wide = w / h > a
    return F.struct(F.when(wide, h * a / w).otherwise(1.0).alias("cw"), F.when(wide, 1.0).otherwise(w / a / h).alias("ch"))


def crop_rect(fx, fy, z, w, h) -> Column:
    """FN-10: pixel rectangle of one output frame, struct(x0, y0, x1, y1)."""
    fx, fy, z, w, h, a = col(fx), col(fy), col(z), col(w), col(h), OUT_W / OUT_H
    wide = w / h > a
    cw = F.when(wide, h * a).otherwise(w.cast("double")) / z
    ch = F.when(wide, h.cast("double")).otherwise(w / a) / z
    x0 = F.bround(clamp(fx * w, cw / 2, w - cw / 2) - cw / 2, 0).cast("long")
    y0 = F.bround(clamp(fy * h, ch / 2, h - ch / 2) - ch / 2, 0).cast("long")
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x0).alias("x0"), F.greatest(zero, y0).alias("y0"),
                    F.least(x0 + F.floor(cw), w).alias("x1"), F.least(y0 + F.floor(ch), h).alias("y1"))


def invert_crop(x, y, rx, ry, rw, rh, mirror: bool = False, margin: float = 0.12) -> Column:
    """FN-10: source point to the reel's frame; null outside the crop and its margin."""
    nx, ny = (col(x) - col(rx)) / F.nullif(col(rw), F.lit(0.0)), (col(y) - col(ry)) / F.nullif(col(rh), F.lit(0.0))
    nx = 1.0 - nx if mirror else nx
    return F.when(nx.between(-margin, 1 + margin) & ny.between(-margin, 1 + margin), F.struct(nx.alias("x"), ny.alias("y")))


def push(progress, amount: float = 0.02) -> Column:
    """FN-11: smoothstep push-in factor."""
    p = clamp(col(progress), 0.0, 1.0)
    return 1.0 + max(0.0, amount) * (p * p * (3.0 - 2.0 * p))


def punch(t_in, amount: float = 0.0) -> Column:
    return 1.0 + max(0.0, amount) * F.exp(-F.greatest(col(t_in), F.lit(0.0)) / 0.35)


def final_zoom(z, progress, t_in, push_amount: float = 0.02, punch_amount: float = 0.0, cap: float = 1.55) -> Column:
    return F.least(col(z) * push(progress, push_amount) * punch(t_in, punch_amount), F.lit(cap))


def center_interval(player, shuttle, ramp, half, before, after, player_margin, shuttle_margin, extra=0.0) -> tuple:
    """FN-17: crop centres on one axis that hold the player, and the shuttle as far as ``ramp`` asks."""
    player, shuttle, ramp, half = map(col, (player, shuttle, ramp, half))
    inner = half * (1.0 - player_margin) + extra
    lo, hi = player + after - inner, player - before + inner
    allow = half * (1.0 - shuttle_margin) + (1.0 - ramp) * 0.8 + extra
    pull = shuttle.isNotNull() & (ramp > 0)
    return (F.when(pull, F.greatest(lo, shuttle - allow)).otherwise(lo), F.when(pull, F.least(hi, shuttle + allow)).otherwise(hi))


def zoom_feasible(px, py, sx, sy, ramp, cw, ch, *, z_max: float = 1.40, z_min: float = 1.0, step: float = 0.96,
                  margins: dict | None = None, extra: float = 0.0) -> Column:
    """FN-17: largest zoom on the geometric ladder z_max * step^k for which both axes have a centre."""
    m = {"pad_x": 0.08, "up": 0.10, "down": 0.15, "player": 0.06, "shuttle_x": 0.40, "shuttle_y": 0.25, **(margins or {})}
    ladder, z = [], z_max
    while z >= z_min - 1e-9:
        ladder.append(z)
        z *= step

    def fits(z: Column) -> Column:
        xlo, xhi = center_interval(px, sx, ramp, col(cw) / (2 * z), m["pad_x"], m["pad_x"], m["player"], m["shuttle_x"], extra)
        ylo, yhi = center_interval(py, sy, ramp, col(ch) / (2 * z), m["up"], m["down"], m["player"], m["shuttle_y"], extra)
        return (xlo <= xhi) & (ylo <= yhi)

    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, ladder)), fits)), F.lit(float(z_min)))
