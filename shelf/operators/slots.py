"""Collision-free names: ``name.ext``, ``name (1).ext``, ``name (2).ext`` …

Slot 0 of (folder, stem, ext) is the plain name, slot n is ``stem (n)ext``. The k-th file that arrives
takes the k-th free slot. With c = slot minus the number of taken slots before it, a taken slot
comes before arrival k exactly when c <= k, so merging taken slots and arrivals in that order makes
the slot of an arrival its place in the merged order. No slot list is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions import paths as P
from shelf.operators.numbering import largest_group, row_numbers
from shelf.session import write_down

_KEY = ["_dir", "_stem", "_ext"]
_NUMBERED = r"(?s)^(.*) \((0|[1-9]\d{0,17})\)$"


def _slots_of(listing: DataFrame) -> DataFrame:
    """Every slot an existing path occupies: its own plain name, and a numbered one if it reads so. Slots may repeat."""
    name = P.basename("full_path")
    base, ext = P.stem(name), P.extension(name)
    plain = F.struct(base.alias("_stem"), F.lit(0).cast("long").alias("slot"))
    numbered = F.struct(
        F.regexp_extract(base, _NUMBERED, 1).alias("_stem"),
        F.regexp_extract(base, _NUMBERED, 2).try_cast("long").alias("slot"),
    )
    return (
        listing.select(
            P.dirname("full_path").alias("_dir"),
            ext.alias("_ext"),
            F.explode(F.array(plain, numbered)).alias("_s"),
        )
        .select("_dir", "_s._stem", "_ext", "_s.slot")
        .filter((F.col("slot") == 0) & (F.col("_stem") != "") | (F.col("slot") > 0))
    )


def _slot_name(folder: Column, stem: Column, ext: Column, slot: Column) -> Column:
    number = F.when(slot > 0, F.concat(F.lit(" ("), slot.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(folder, F.lit("/"), stem, number, ext)


def _assign(arrivals: DataFrame, taken: DataFrame, first_slot: int) -> DataFrame:
    """``slot`` for arrivals that carry their 1-based turn ``_k`` inside the key."""
    used = taken.filter(F.col("slot") >= first_slot)
    most_used, most_arrivals = largest_group(used, _KEY), largest_group(arrivals, _KEY)
    used = row_numbers(used, _KEY, ["slot"], "_i", largest=most_used)
    # number of free slots below this taken slot
    merged = used.select(
        *_KEY, (F.col("slot") - first_slot - (F.col("_i") - 1)).alias("_c"),
        F.lit(0).alias("_is_arrival"), "slot",
    ).unionByName(
        arrivals.select(
            *_KEY, (F.col("_k") - 1).cast("long").alias("_c"), F.lit(1).alias("_is_arrival"),
            F.lit(0).cast("long").alias("slot"),
        )
    )
    merged = row_numbers(merged, _KEY, ["_c", "_is_arrival", "slot"], "_m", largest=most_used + most_arrivals)
    return merged.filter("_is_arrival = 1").select(
        *_KEY, (F.col("_c") + 1).alias("_k"), (F.col("_m") - 1 + first_slot).cast("long").alias("slot")
    )


def free_destinations(
    plan: DataFrame,
    listing: DataFrame,
    order: list[str],
    dest_dir: str = "dest_dir",
    filename: str = "filename",
    first_slot: int = 0,
    name: str = "destination",
) -> DataFrame:
    """Add ``name``, a path no existing file and no other row of the plan has.

    Rows are served in ``order``. Existing names are those before the batch; names that the batch
    itself frees are not reused. ``first_slot=1`` never tries the plain name.
    """
    columns = plan.columns
    keyed = (
        plan.withColumn("_dir", F.col(dest_dir))
        .withColumn("_stem", P.stem(filename))
        .withColumn("_ext", P.extension(filename))
    )
    # read several times below: ranked once, then written down
    keyed = write_down(row_numbers(keyed, _KEY, order, "_k"), "arrivals")
    groups = keyed.select(*_KEY).distinct()
    taken = _slots_of(listing).join(groups, _KEY, "left_semi").distinct()
    numbered_groups = _entangled(groups) if first_slot == 0 else None
    if numbered_groups is not None:
        taken = _settle(keyed, taken, numbered_groups, order)
    slots = _assign(keyed, write_down(taken, "taken"), first_slot)
    return (
        keyed.join(slots, _KEY + ["_k"])
        .withColumn(name, _slot_name(F.col("_dir"), F.col("_stem"), F.col("_ext"), F.col("slot")))
        .select(*columns, name)
    )


def _entangled(groups: DataFrame) -> DataFrame | None:
    """Arriving names ``stem (n)ext`` whose ``stem`` arrives in the same folder as well."""
    literal = groups.select(
        *_KEY,
        F.regexp_extract("_stem", _NUMBERED, 1).alias("_parent"),
        F.regexp_extract("_stem", _NUMBERED, 2).try_cast("long").alias("_n"),
    ).filter("_n > 0")
    parents = groups.select("_dir", F.col("_stem").alias("_parent"), "_ext")
    found = literal.join(parents, ["_dir", "_parent", "_ext"], "left_semi")
    return None if found.isEmpty() else write_down(found, "literal-names")


def _settle(keyed: DataFrame, taken: DataFrame, literal: DataFrame, order: list[str]) -> DataFrame:
    """Taken slots when literal numbered names and generated ones compete.

    A literal ``a (3).jpg`` keeps its name when the files arriving as ``a.jpg`` before it have not
    used slot 3; then that slot is closed to them. Whether this holds depends only on literals with
    smaller numbers, so repeating the assignment settles at least the next number each time.
    """
    timed = write_down(row_numbers(keyed, [], order, "_t"), "arrivals")
    first = timed.filter("_k = 1").select(*_KEY, F.col("_t").alias("_first"))
    literal = literal.join(first, _KEY)
    parent_key = [F.col("_dir"), F.col("_parent").alias("_stem"), F.col("_ext")]
    # arrivals of the parent before the literal: place among parent arrivals and literal markers
    marks = timed.join(literal.select(*parent_key).distinct(), _KEY, "left_semi").select(
        *_KEY, "_t", F.lit(None).cast("string").alias("_literal"), F.lit(0).cast("long").alias("_n")
    ).unionByName(
        literal.select(*parent_key, F.col("_first").alias("_t"), F.col("_stem").alias("_literal"), "_n")
    )
    marks = row_numbers(marks, _KEY, ["_t"], "_place")
    only = row_numbers(marks.filter("_literal is not null"), _KEY, ["_t"], "_own")
    only = write_down(
        only.select(*_KEY, "_literal", "_n", (F.col("_place") - F.col("_own")).alias("_k")), "turns"
    )
    existing = write_down(taken, "taken")
    free = only.join(
        existing.filter("slot = 0").select("_dir", F.col("_stem").alias("_literal"), "_ext"),
        ["_dir", "_literal", "_ext"], "left_anti",
    )
    keeps = free.select(*_KEY, "_literal", "_n")
    before, n_before = None, 0
    while True:
        lost = only.join(keeps, [*_KEY, "_literal"], "left_anti")
        now = write_down(
            existing.unionByName(keeps.select(*_KEY, F.col("_n").alias("slot")))
            .unionByName(
                lost.select("_dir", F.col("_literal").alias("_stem"), "_ext", F.lit(0).cast("long").alias("slot"))
            )
            .distinct(),
            "taken",
        )
        n = now.count()
        # sets of equal size are equal when nothing of one is missing in the other
        if before is not None and n == n_before and now.subtract(before).isEmpty():
            return now
        before, n_before = now, n
        slots = _assign(timed, now, 0).select(*_KEY, "_k", F.col("slot").alias("_used"))
        keeps = free.join(slots, _KEY + ["_k"], "left").filter(
            F.coalesce("_used", F.lit(-1)) < F.col("_n")
        ).select(*_KEY, "_literal", "_n")
