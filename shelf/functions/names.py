"""Dates inside names, natural order, sizes for people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelf.functions.paths import as_column, plain_digits

_DATE = r"(?<!\d)(\d{2})[-._](\d{2})[-._](\d{4})(?!\d)"


def date_in_name(name: Column | str) -> Column:
    """First ``DD-MM-YYYY`` of a name as struct(day, month, year), else null.

    Separators are ``-``, ``.`` and ``_``. Only the first match counts: when its day or month is
    out of range the result is null. The calendar is not consulted (31-02 passes).
    """
    text = plain_digits(name)
    day, month, year = (F.regexp_extract(text, _DATE, k).try_cast("int") for k in (1, 2, 3))
    return F.when(
        day.between(1, 31) & month.between(1, 12),
        F.struct(day.alias("day"), month.alias("month"), year.alias("year")),
    )


def natural_key(text: Column | str) -> Column:
    """Sort key that reads digit runs as numbers: ``a2`` before ``a10``.

    A number is kept as (count of digits, digits) without leading zeros, so its size is not bounded
    by a numeric type.
    """
    runs = F.regexp_extract_all(F.lower(plain_digits(text)), F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(run: Column) -> Column:
        is_text = ~((run >= "0") & (run < ":"))
        number = F.ltrim(run, F.lit("0"))
        return F.struct(
            is_text.alias("is_text"),
            F.when(is_text, F.lit(0)).otherwise(F.length(number)).alias("digits"),
            F.when(is_text, run).otherwise(number).alias("text"),
        )

    return F.transform(runs, piece)


def human_size(size: Column | str) -> Column:
    """``512 B``, ``1.2 KB`` … up to GB; halves round to even."""
    n = as_column(size).cast("double")

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**power), 1))

    return (
        F.when(n < 1024, F.format_string("%.0f B", F.bround(n, 0)))
        .when(n < 1024**2, scaled(1, "KB"))
        .when(n < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )
