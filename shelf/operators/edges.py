"""Evidence along the sides of a rectangle: snapping, contrast, purity, inner edges.

One row per rectangle carries its image as flat arrays (``lum``, ``r``, ``g``, ``b`` in reading order,
``gw`` x ``gh`` cells, a bounded grid), so sampling is an index into an array and needs no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SIDES = ("x0", "x1", "y0", "y1")
_INWARD = {"x0": 1.0, "x1": -1.0, "y0": 1.0, "y1": -1.0}


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _let(value: Column, then) -> Column:
    """Bind a value inside an expression: a lambda computes what it names again for every element,
    so anything costly is bound before."""
    return F.transform(F.array(value), then)[0]


def _linspace(low: float, high: float, n: int) -> Column:
    return _numbers(low + (high - low) * i / (n - 1) for i in range(n))


def array_quantile(values: Column, q: float) -> Column:
    """Quantile with linear interpolation; null for an empty array."""

    def pick(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return a + (b - a) * (at - low)

    return F.when(F.size(values) > 0, _let(F.array_sort(values), pick))


def sample(values: Column, px: Column, py: Column) -> Column:
    """Value of the nearest cell; points outside take the nearest cell of the border."""
    w, h = F.col("gw"), F.col("gh")
    xi = F.greatest(F.lit(0), F.least(w - 1, F.rint(px).cast("int")))
    yi = F.greatest(F.lit(0), F.least(h - 1, F.rint(py).cast("int")))
    return F.get(values, yi * w + xi)


def _to_image(fx: Column, fy: Column) -> tuple[Column, Column]:
    c, s = F.cos("ang"), F.sin("ang")
    return fx * c - fy * s, fx * s + fy * c


def _on_side(side: str, across: Column, along: Column) -> tuple[Column, Column]:
    """Image point of a frame position: ``across`` the side, ``along`` it."""
    return _to_image(across, along) if side in ("x0", "x1") else _to_image(along, across)


def _span_ends(side: str) -> tuple[Column, Column]:
    low, high = ("y0", "y1") if side in ("x0", "x1") else ("x0", "x1")
    return F.col(low), F.col(high)


def _span(side: str, shares: Column) -> Column:
    low, high = _span_ends(side)
    return F.transform(shares, lambda t: low + t * (high - low))


def snap_sides(rects: DataFrame) -> DataFrame:
    """Move each side onto the strongest brightness edge nearby, where there is a clear one.

    Along 25 lines across the side the steepest place is found; the side moves by the median when
    at least half of the lines have a strong edge and these agree.
    """
    before = F.struct(*SIDES)
    short = F.least("gw", "gh")
    snapped = rects.withColumn("_before", before).withColumn(
        "_win", F.greatest(F.lit(6), F.rint(short * 0.025).cast("int"))
    )
    for side in SIDES:
        offsets = F.sequence(-F.col("_win"), F.col("_win"))

        def steepest(at: Column, side=side, offsets=offsets) -> Column:
            def across(o: Column) -> Column:
                return sample(F.col("lum"), *_on_side(side, F.col(side) + o, at))

            def smooth(line: Column) -> Column:
                last = F.size(line) - 1

                def mean(i: Column) -> Column:
                    near = [F.get(line, F.greatest(F.lit(0), F.least(last, i + d))) for d in (-2, -1, 0, 1, 2)]
                    return sum(near[1:], near[0]) / 5

                return F.transform(F.sequence(F.lit(0), last), mean)

            def steps(line: Column) -> Column:
                return F.transform(
                    F.sequence(F.lit(0), F.size(line) - 3),
                    lambda i: F.struct(F.abs(F.get(line, i + 2) - F.get(line, i)).alias("step"), (-i).alias("at")),
                )

            profile = F.transform(offsets, across)
            return _let(profile, lambda p: _let(smooth(p), lambda line: F.array_max(steps(line))))

        spans = _span(side, _linspace(0.15, 0.85, 25))
        found = F.filter(F.transform(spans, _one(steepest)), lambda e: e["step"] > 6.0)
        # the first and last offset have no step of their own
        shifts = F.transform(found, lambda e: (-e["at"] + 1 - F.col("_win")).cast("double"))
        snapped = snapped.withColumn("_shifts", shifts).withColumn("_median", array_quantile(F.col("_shifts"), 0.5))
        agree = _let(
            F.col("_median"), lambda m: array_quantile(F.transform("_shifts", lambda d: F.abs(d - m)), 0.75)
        )
        move = (F.size("_shifts") >= 12.5) & (agree <= F.greatest(F.lit(2.0), F.col("_win") * 0.3))
        snapped = snapped.withColumn(side, F.col(side) + F.when(move, F.col("_median")).otherwise(0.0))
    kept = (F.col("x1") - F.col("x0") >= 4) & (F.col("y1") - F.col("y0") >= 4)
    snapped = snapped.withColumn("_kept", kept)
    return snapped.withColumns(
        {s: F.when(F.col("_kept"), F.col(s)).otherwise(F.col(f"_before.{s}")) for s in SIDES}
    ).drop("_before", "_win", "_shifts", "_median", "_kept")


def _one(function):
    """A lambda with exactly one parameter, as the array functions expect."""
    return lambda value: function(value)


def near_border(side: str, depth: Column) -> Column:
    """The middle of the side lies on or close to the border of the photo."""
    low, high = _span_ends(side)
    px, py = _on_side(side, F.col(side), 0.5 * (low + high))
    m = F.greatest(F.lit(2.0), depth * 0.8)
    return (px < m) | (py < m) | (px > F.col("gw") - m) | (py > F.col("gh") - m)


def side_contrasts(rects: DataFrame) -> DataFrame:
    """Add contrasts (sides inside the photo), touching (number of the others) and purity.

    A strip just inside a side is compared with one just outside; of each strip only the brighter
    half counts, which leaves print out. The four inner strips of a sheet have one colour. Sides are
    looked at as rows and brought together again without the image.
    """
    key = [c for c in ("image_id", "mask", "rank") if c in rects.columns]
    depth = F.greatest(F.lit(3.0), F.least("gw", "gh") * 0.012)
    sides = F.array(*[
        F.struct(
            F.lit(i).alias("side"), F.lit(side in ("x0", "x1")).alias("upright"), F.col(side).alias("at"),
            *[c.alias(n) for c, n in zip(_span_ends(side), ("low", "high"))],
            F.lit(_INWARD[side]).alias("inward"), near_border(side, depth).alias("near"),
        )
        for i, side in enumerate(SIDES)
    ])
    rows = rects.select(
        *key, "gw", "gh", "r", "g", "b", "lum", F.cos("ang").alias("c"), F.sin("ang").alias("s"),
        depth.alias("depth"), F.inline(sides),
    )
    shares = [i / 24 * 0.7 + 0.15 for i in range(25)]

    def strip(sign: int) -> Column:
        """Cells of three lines along the side, inside (1) or outside (-1) of it."""
        places = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(t).alias("t")) for d in (0.5, 1.0, 1.5) for t in shares])

        def cell(place: Column) -> Column:
            across = F.col("at") + F.col("inward") * F.col("depth") * sign * place["d"]
            along = F.col("low") + place["t"] * (F.col("high") - F.col("low"))
            fx = F.when(F.col("upright"), across).otherwise(along)
            fy = F.when(F.col("upright"), along).otherwise(across)
            return F.struct(place["d"].alias("d"), (fx * F.col("c") - fy * F.col("s")).alias("x"), (fx * F.col("s") + fy * F.col("c")).alias("y"))

        return F.transform(places, cell)

    def looked_up(p: Column) -> Column:
        beyond = (p["x"] < 0) | (p["x"] > F.col("gw") - 1) | (p["y"] < 0) | (p["y"] > F.col("gh") - 1)
        return F.struct(p["d"], beyond.alias("beyond"), *[sample(F.col(k), p["x"], p["y"]).alias(k) for k in ("r", "g", "b", "lum")])

    def summary(cells: Column) -> Column:
        lines = [F.size(F.filter(cells, _beyond_on(d))) / F.lit(25.0) for d in (0.5, 1.0, 1.5)]
        level = array_quantile(F.transform(cells, lambda c: c["lum"]), 0.5)
        bright = _let(level, lambda bound: F.filter(cells, lambda c: c["lum"] >= bound))
        mean = _let(bright, lambda part: F.struct(*[
            (F.aggregate(part, F.lit(0.0), _add(c)) / F.size(part)).alias(c) for c in "rgb"
        ]))
        return F.struct(F.greatest(*lines).alias("beyond"), mean.alias("mean"))

    rows = rows.select(
        *key, "side", "near",
        _let(F.transform(strip(1), looked_up), summary).alias("inner"),
        _let(F.transform(strip(-1), looked_up), summary).alias("outer"),
    )
    on_edge = (F.greatest("inner.beyond", "outer.beyond") > 0.3) | F.col("near")
    gap = F.greatest(*[F.abs(F.col(f"inner.mean.{c}") - F.col(f"outer.mean.{c}")) for c in "rgb"])
    apart = F.greatest(*[F.max(f"inner.mean.{c}") - F.min(f"inner.mean.{c}") for c in "rgb"])
    judged = rows.withColumn("on_edge", on_edge).groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("on_edge"), F.struct("side", gap.alias("gap"))))), lambda e: e["gap"]
        ).alias("contrasts"),
        F.count_if("on_edge").alias("touching"),
        F.least(F.greatest(1.0 - (apart - 12.0) / 30.0, F.lit(0.0)), F.lit(1.0)).alias("purity"),
    )
    return rects.join(judged, key)


def _beyond_on(d: float):
    return lambda c: c["beyond"] & (c["d"] == d)


def _add(channel: str):
    return lambda acc, c: acc + c[channel]


def inner_edge(rects: DataFrame) -> DataFrame:
    """Add ``inner``: a side on the border of the photo has a long weak edge parallel to it further
    in, so the rectangle is too large.

    Positions from 4 % to 65 % of the width are tried under nine small tilts; print gives broken or
    very strong edges, a sheet a continuous weak one.
    """
    depth = F.greatest(F.lit(3.0), F.least("gw", "gh") * 0.012)
    tilts = _numbers(math.tan(math.radians(-6.0 + 1.5 * i)) for i in range(9))
    shares = _linspace(0.12, 0.88, 40)
    any_inner = F.lit(False)
    for side in SIDES:
        low, high = ("x0", "x1") if side in ("x0", "x1") else ("y0", "y1")
        length = F.col(high) - F.col(low)
        a, b = _span_ends(side)
        middle = (a + b) / 2
        spans = _span(side, shares)
        first = 0.04 * length
        count = F.greatest(F.ceil((0.65 * length - first) / 2.0).cast("int"), F.lit(0))
        places = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: first + (i - 1) * 2.0)

        def cover(tilt: Column, place: Column, along: Column, side=side, middle=middle) -> Column:
            def weak(sp: Column) -> Column:
                at = F.col(side) + _INWARD[side] * place + (sp - middle) * tilt
                one = sample(F.col("lum"), *_on_side(side, at - 2.0, sp))
                two = sample(F.col("lum"), *_on_side(side, at + 2.0, sp))
                step = F.abs(two - one)
                return (step > 4.0) & (step < 45.0)

            return F.size(F.filter(along, weak)) / F.lit(40.0)

        best = _let(spans, lambda along: F.array_max(F.flatten(F.transform(tilts, _over(places, along, cover)))))
        any_inner = any_inner | (near_border(side, depth) & (count > 0) & (best > 0.88))
    return rects.withColumn("inner", any_inner)


def _over(places: Column, along: Column, cover):
    return lambda tilt: F.transform(places, lambda place: cover(tilt, place, along))
