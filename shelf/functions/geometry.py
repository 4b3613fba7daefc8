"""Boxes and quads. A box is struct(l, t, r, b); a quad is an array of four struct(x, y) in the order
top-left, top-right, bottom-right, bottom-left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(l, t, r, b) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip("ltrb", (l, t, r, b))])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_quad(b: Column) -> Column:
    return F.array(point(b["l"], b["t"]), point(b["r"], b["t"]), point(b["r"], b["b"]), point(b["l"], b["b"]))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area of two boxes; 0 when the joint area is 0."""
    width = F.greatest(F.lit(0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    height = F.greatest(F.lit(0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    shared = (width * height).cast("double")
    joint = (a["r"] - a["l"]) * (a["b"] - a["t"]) + (b["r"] - b["l"]) * (b["b"] - b["t"]) - shared
    return F.when(joint != 0, shared / joint).otherwise(0.0)


def _each(quad: Column, c: str) -> list[Column]:
    return [F.get(quad, i)[c] for i in range(4)]


def quad_bounds(quad: Column, w: Column, h: Column) -> Column:
    """Whole-pixel box around a quad, inside the photo and at least one pixel wide and high."""
    l = F.greatest(F.lit(0), F.floor(F.least(*_each(quad, "x")))).cast("int")
    t = F.greatest(F.lit(0), F.floor(F.least(*_each(quad, "y")))).cast("int")
    r = F.least(w, F.ceil(F.greatest(*_each(quad, "x")))).cast("int")
    b = F.least(h, F.ceil(F.greatest(*_each(quad, "y")))).cast("int")
    return F.when(quad.isNotNull(), box(l, t, F.greatest(l + 1, r), F.greatest(t + 1, b)))


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _steps(quad: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """For each corner struct(x, y, ux, uy, vx, vy): where it is, and how far the margins move it along the upper and the left side."""
    q = [quad[i] for i in range(4)]
    sides = {"u": q[1], "v": q[3]}

    def units(size: Column) -> Column:
        length = {n: F.when(size[n] == 0, 1.0).otherwise(size[n]) for n in sides}
        return F.struct(*[((to[c] - q[0][c]) / length[n]).alias(n + c) for n, to in sides.items() for c in "xy"])

    def corners(unit: Column) -> Column:
        def step(p: Column, along_u: Column, along_v: Column) -> Column:
            along = {"u": along_u, "v": along_v}
            return F.struct(
                *[p[c].cast("double").alias(c) for c in "xy"], *[(unit[n + c] * along[n]).alias(n + c) for n in sides for c in "xy"]
            )

        return F.array(step(q[0], -left, -top), step(q[1], right, -top), step(q[2], right, bottom), step(q[3], -left, bottom))

    return _once(_once(F.struct(*[_distance(q[0], to).alias(n) for n, to in sides.items()]), units), corners)


def _moved(corner: Column, share: Column, c: str) -> Column:
    return corner[c] + corner["u" + c] * share + corner["v" + c] * share


def expand_quad(quad: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The quad grown outward along its own sides, in pixels; negative values shrink it."""
    whole = F.lit(1.0)
    return F.transform(_steps(quad, left, top, right, bottom), lambda p: point(_moved(p, whole, "x"), _moved(p, whole, "y")))


def fit_inside(quad: Column, w: Column, h: Column, margins: Column) -> Column:
    """The quad with margins struct(l, t, r, b), halved up to six times until all corners lie in the
    photo within a pixel; the plain quad when even that does not fit. How far whole margins move the corners is found once;
    halving by powers of two is exact."""

    def grown(corners: Column) -> Column:
        def fits(share: Column) -> Column:
            xs, ys = ([_moved(corners[i], share, c) for i in range(4)] for c in "xy")
            return (F.least(*xs) >= -1) & (F.least(*ys) >= -1) & (F.greatest(*xs) <= w + 1) & (F.greatest(*ys) <= h + 1)

        share = F.get(F.filter(F.array(*[F.lit(0.5**k) for k in range(7)]), fits), 0)
        return F.transform(F.array(share), lambda s: F.when(
            s.isNotNull(), F.transform(corners, lambda p: point(_moved(p, s, "x"), _moved(p, s, "y")))
        ))[0]

    return F.coalesce(_once(_steps(quad, *[margins[s] for s in "ltrb"]), grown), quad)


def out_size(plan_box: Column, quad: Column, deskew: Column) -> Column:
    """struct(w, h) of the crop: mean side lengths of a straightened quad, else the box."""
    straight_w = F.rint((_distance(quad[0], quad[1]) + _distance(quad[3], quad[2])) / 2)
    straight_h = F.rint((_distance(quad[0], quad[3]) + _distance(quad[1], quad[2])) / 2)
    w = F.when(deskew, straight_w).otherwise(plan_box["r"] - plan_box["l"]).cast("int")
    h = F.when(deskew, straight_h).otherwise(plan_box["b"] - plan_box["t"]).cast("int")
    return F.when(quad.isNotNull(), F.struct(w.alias("w"), h.alias("h")))


def gain_percent(size: Column, w: Column, h: Column) -> Column:
    """Share of the photo that a crop of ``size`` removes, in percent."""
    lost = (1 - (size["w"].cast("long") * size["h"]) / (w.cast("long") * h)) * 100
    return F.when(size.isNull() | (w == 0), 0.0).otherwise(F.greatest(F.lit(0.0), lost))


def confidence_score(fill: Column, frac: Column, contrasts: Column, purity: Column) -> Column:
    """0.40 for a full rectangle, 0.40 for visible edges, 0.20 for a sensible size; less when the
    inside is not of one colour. ``contrasts`` holds one value per side inside the photo."""
    rect = F.least(F.greatest((fill - 0.78) / 0.17, F.lit(0.0)), F.lit(1.0))
    total = F.aggregate(contrasts, F.lit(0.0), lambda acc, c: acc + F.least(F.lit(1.0), c / 25.0))
    edge = F.when(
        F.size(contrasts) > 0,
        0.5 * total / F.size(contrasts) + 0.5 * F.least(F.lit(1.0), F.array_min(contrasts) / 15.0),
    ).otherwise(0.0)
    size = F.when(frac > 0.985, 0.4).when(frac < 0.08, 0.1).when(frac < 0.15, 0.6).otherwise(1.0)
    return (0.40 * rect + 0.40 * edge + 0.20 * size) * (0.45 + 0.55 * purity)
