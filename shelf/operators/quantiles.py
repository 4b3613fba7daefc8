"""Exact medians of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.session import write_down

# Up to this many values the built-in median may hold them in one task.
MEDIAN_ROWS = 1_000_000
# How far from the wanted rank, as a share of all values, the two estimates around it are asked for, and their accuracy.
NEAR, ACCURACY = 0.001, 5_000


def exact_medians(df: DataFrame, columns: list[str], rows: int | None = None) -> tuple[int, dict[str, float | None]]:
    """(number of rows, median of each column), nulls left out of the medians.

    Small inputs use the built-in aggregate. Otherwise the columns are written down and all of them go together: two
    estimated quantiles enclose each wanted rank, one aggregation counts the values below, at and between them, and
    so on between the two, until so few are left that a task sorts them. A round leaves some 500th of the
    values, so three or four passes do, however many values and columns there are.
    """
    rows = MEDIAN_ROWS if rows is None else rows
    n = df.count()
    if n <= rows:
        found = df.agg(*[F.median(c).alias(c) for c in columns]).first()
        return n, found.asDict()
    values = write_down(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "values")
    counts = values.agg(*[F.count(c) for c in values.columns]).first()
    wanted = {(c, r): m for c, m in zip(values.columns, counts) if m for r in {(m + 1) // 2, m // 2 + 1}}
    at = _at_ranks(values, wanted, rows)
    middle = [[v for (c, _), v in sorted(at.items()) if c == f"v{i}"] for i in range(len(columns))]
    return n, {c: (m[0] + m[-1]) / 2 if m else None for c, m in zip(columns, middle)}


def _at_ranks(values: DataFrame, wanted: dict[tuple[str, int], int], rows: int) -> dict[tuple[str, int], float]:
    """The value at each wanted (column, rank from 1), given how many values the column has."""
    found: dict[tuple[str, int], float] = {}
    # the value lies above the first and below the second bound, where there is one; its rank there, the values there
    left = {key: (None, None, key[1], m) for key, m in wanted.items()}

    def inside(key: tuple[str, int]) -> Column:
        low, high, _, _ = left[key]
        kept = F.col(key[0]).isNotNull()
        kept = kept if low is None else kept & (F.col(key[0]) > low)
        return kept if high is None else kept & (F.col(key[0]) < high)

    while left:
        keys = list(left)
        few = [k for k in keys if left[k][3] <= rows]
        many = [k for k in keys if left[k][3] > rows]
        # quantiles of the same stretch are the same aggregate, also for the two ranks in the middle
        ends = [
            [min(max(left[k][2] / left[k][3] + by, 0.0), 1.0) for by in (-NEAR, NEAR)] for k in many
        ]
        asked = [F.sort_array(F.collect_list(F.when(inside(k), F.col(k[0]))))[left[k][2] - 1] for k in few]
        asked += [F.percentile_approx(F.when(inside(k), F.col(k[0])), e, ACCURACY) for k, e in zip(many, ends)]
        got = values.agg(*[a.alias(f"a{i}") for i, a in enumerate(asked)]).first()
        found.update(zip(few, got))
        bounds = dict(zip(many, got[len(few) :]))
        if not many:
            return found
        parts = []
        for k in many:
            (a, b), v = bounds[k], F.col(k[0])
            parts += [F.count_if(inside(k) & x) for x in (v < a, v == a, (v > a) & (v < b), (v == b) & (v > a))]
        sizes = values.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
        after = {}
        for i, k in enumerate(many):
            low, high, rank, m = left[k]
            a, b = bounds[k]
            for size, value, stretch in zip(
                (*sizes[4 * i : 4 * i + 4], m - sum(sizes[4 * i : 4 * i + 4])), (None, a, None, b, None), ((low, a), None, (a, b), None, (b, high))
            ):
                if rank <= size:
                    if stretch is None:
                        found[k] = value
                    else:
                        after[k] = (*stretch, rank, size)
                    break
                rank -= size
        left = after
    return found
