"""64-bit hashes: text form, distance, median-threshold hash of a vector."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelf.functions.paths import as_column


def hash_from_hex(text: Column | str) -> Column:
    """16 hex digits to a signed 64-bit integer."""
    return F.conv(as_column(text), 16, -10).cast("bigint")


def hash_to_hex(value: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(as_column(value)), 16, "0"))


def distance(a: Column | str, b: Column | str) -> Column:
    """Number of different bits."""
    return F.bit_count(as_column(a).bitwiseXOR(as_column(b))).cast("int")


def median_hash(vector: Column | str) -> Column:
    """Bit i is set when component i lies above the median of the 64 components."""
    def hashed(bound: Column) -> Column:
        values, median = bound["values"], bound["median"]
        above = F.transform(values, lambda x: F.when(x > median, F.expr("1L")).otherwise(F.expr("0L")))
        # one bit per position; the bits are disjoint
        return F.aggregate(
            F.arrays_zip(above.alias("bit"), F.sequence(F.lit(0), F.lit(63)).alias("at")),
            F.expr("0L"),
            lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", x["bit"], x["at"])),
        )

    # values and median are bound first: a lambda computes what it names again for every element
    values = F.transform(as_column(vector), lambda x: x.cast("double"))
    middle = F.slice(F.array_sort(values), 32, 2)
    median = F.aggregate(middle, F.lit(0.0), lambda acc, x: acc + x) / 2
    return F.transform(F.array(F.struct(values.alias("values"), median.alias("median"))), hashed)[0]
