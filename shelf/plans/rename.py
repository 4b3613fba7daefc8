"""Batch renames: names, counters, invoice numbers, conflicts, what a commit will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions import paths as P
from shelf.functions.names import natural_key
from shelf.functions.templates import Rename, renamed
from shelf.operators.folds import Effect, running
from shelf.operators.index import paths_there
from shelf.operators.numbering import row_numbers
from shelf.operators.pointers import reachable, resolve
from shelf.operators.slots import free_destinations
from shelf.session import write_down


def rename_plan(
    files: DataFrame,
    settings: Rename,
    start: int = 1,
    invoice: bool = False,
    listing: DataFrame | None = None,
    taken_at: Column | None = None,
    today: Column | None = None,
) -> DataFrame:
    """One row per file in natural order of the names: position, full_path, new_path, err, same,
    conflict.

    The counter grows only on rows that really rename. A new name is in conflict when another file
    has it or an earlier row of the batch took it.
    """
    listing = files if listing is None else listing
    ordered = row_numbers(
        files.withColumn("_natural", natural_key(P.basename("full_path"))), [], ["_natural", "full_path"], "position"
    ).drop("_natural")

    def name(counter: Column | None) -> Column:
        return renamed(settings, "full_path", counter, "mtime", taken_at, today)

    if settings.parsed().uses("n"):
        ordered = write_down(_with_counter(write_down(ordered, "files"), name, start), "counted")
        planned = ordered.withColumn("_r", name(F.col("_counter"))).drop("_counter")
    else:
        planned = ordered.withColumn("_r", name(F.lit(start)))
    planned = planned.select("position", "full_path", F.col("_r.new_path").alias("new_path"), F.col("_r.err").alias("err"))
    if invoice and not settings.parsed().uses("n"):
        # the names are built once, not again in each expression that reads them
        planned = write_down(planned, "names")
        planned = invoice_numbers(planned, listing)
    planned = write_down(planned, "planned")
    real = F.col("new_path").isNotNull() & (F.col("new_path") != F.col("full_path"))
    first = planned.filter(real).groupBy(F.col("new_path").alias("_wanted")).agg(F.min("position").alias("_first"))
    there = paths_there(listing, planned.filter(real), "new_path", "_there").withColumnRenamed("new_path", "_wanted")
    return (
        planned.withColumn("_wanted", _wanted())
        .join(first, "_wanted", "left")
        .join(there, "_wanted", "left")
        .select(
            "position", "full_path", "new_path", "err",
            ((F.coalesce(F.col("new_path") == F.col("full_path"), F.lit(False)))
             | (F.col("new_path").isNull() & F.col("err").isNull())).alias("same"),
            F.coalesce(real & (F.col("_there").isNotNull() | (F.col("position") > F.col("_first"))), F.lit(False)).alias("conflict"),
        )
    )


def _wanted() -> Column:
    """Join key of the new name. Rows without one use their own path, so that they do not all meet in
    one task under null; what they find there is not used."""
    return F.coalesce("new_path", "full_path")


def _with_counter(ordered: DataFrame, name, start: int) -> DataFrame:
    """Add ``_counter``, the number a row gets.

    Rows that rename with any number are counted in order. A row whose own name is what the template
    gives for its number does not rename and uses no number up; with s such rows before it, row i
    has the number start + i - s. So it stays when s = start + i - own, and the rows that stay form a
    chain in which this difference runs through 0, 1, 2 …; the chain is followed by doubling.
    """
    # a number far outside any batch: the row renames unless something else keeps it
    elsewhere = name(F.lit(-987654321))
    eligible = ordered.filter(elsewhere["new_path"].isNotNull() & elsewhere["err"].isNull())
    counted = row_numbers(eligible, [], ["position"], "_i").withColumn("_i", F.col("_i") - 1)
    # the candidate numbers are those written in the file's own name
    stays = (
        _written_numbers(counted).withColumn("_r", name(F.col("_own")))
        .filter(F.col("_r.new_path").isNull() & F.col("_r.err").isNull())
        .select("_i", (F.lit(start) + F.col("_i") - F.col("_own")).alias("_q"))
        .filter("_q >= 0")
        .distinct()
    )
    stays = write_down(stays, "self-matches")
    head = stays.filter("_q = 0").agg(F.min("_i")).first()[0]
    if head is None:
        return ordered.join(
            counted.select("position", (F.col("_i") + start).alias("_counter")), "position", "left"
        ).withColumn("_counter", F.coalesce("_counter", F.lit(start)))
    # next row of the chain: the first later one with a difference larger by one
    marks = stays.select("_q", "_i", F.lit(0).alias("_mark")).unionByName(
        stays.select((F.col("_q") + 1).alias("_q"), "_i", F.lit(1).alias("_mark"))
    )
    placed = row_numbers(marks, ["_q"], ["_i", "_mark"], "_m")
    marked = row_numbers(placed.filter("_mark = 1"), ["_q"], ["_i"], "_own")
    ranked = row_numbers(stays, ["_q"], ["_i"], "_rank")
    chain = marked.select(F.col("_i").alias("id"), "_q", (F.col("_m") - F.col("_own") + 1).alias("_rank")).join(
        ranked.select("_q", "_rank", F.col("_i").alias("next")), ["_q", "_rank"], "left"
    ).select("id", "next")
    kept = reachable(chain, head).select(F.col("id").alias("_i"), F.lit(1).alias("_stay"))
    marked_rows = counted.join(kept, "_i", "left").withColumn("_stay", F.coalesce("_stay", F.lit(0)))
    # number of rows that stay before each row: place in the order minus place among the others
    moving = row_numbers(marked_rows.filter("_stay = 0"), [], ["_i"], "_n").select(
        "position", (F.col("_n") - 1 + start).alias("_counter")
    )
    staying = row_numbers(marked_rows.filter("_stay = 1"), [], ["_i"], "_s").select(
        "position", (F.col("_i") - (F.col("_s") - 1) + start).alias("_counter")
    )
    return ordered.join(moving.unionByName(staying), "position", "left").withColumn(
        "_counter", F.coalesce("_counter", F.lit(start))
    )


def _written_numbers(counted: DataFrame) -> DataFrame:
    """Every number that a digit run of the name contains, as a whole or as a part."""
    runs = F.regexp_extract_all(P.basename("full_path"), F.lit(r"(\d+)"), F.lit(1))
    parts = F.flatten(F.transform(
        runs,
        lambda run: F.flatten(F.transform(
            F.sequence(F.lit(1), F.least(F.length(run), F.lit(18))),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.length(run) - size + 1), lambda at: F.substring(run, at, size).try_cast("long")
            ),
        )),
    ))
    return counted.withColumn("_own", F.explode(F.array_distinct(parts)))


_NUMBERED = r"(?s)^(.*)-(\d{1,18})$"


def _invoice_cases(planned: DataFrame) -> DataFrame:
    """Add _case (none, same, keep or number), _folder and _key: the name that a file's number belongs to."""
    base, own = P.stem(P.basename("new_path")), P.stem(P.basename("full_path"))
    real = F.col("new_path").isNotNull() & F.col("err").isNull()
    keeps = (F.lower(F.regexp_extract(own, _NUMBERED, 1)) == F.lower(base)) & F.rlike(own, F.lit(_NUMBERED))
    case = F.when(~real, "none").when(F.lower(base) == F.lower(own), "same").when(keeps, "keep").otherwise("number")
    rows = planned.withColumn("_case", case).withColumn("_folder", P.dirname("full_path"))
    # only rows to be numbered look for a name; the others are spread by a key no name can have
    return rows.withColumn("_key", F.when(F.col("_case") == "number", F.lower(base)).otherwise(F.col("full_path")))


def _highest_numbers(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """(_folder, _key, _highest): the highest number that a listed file of that name and folder has."""
    wanted = rows.filter("_case = 'number'").select("_folder", "_key").distinct()
    stem = P.stem(P.basename("full_path"))
    return (
        listing.select(
            P.dirname("full_path").alias("_folder"), F.lower(F.regexp_extract(stem, _NUMBERED, 1)).alias("_key"),
            F.regexp_extract(stem, _NUMBERED, 2).try_cast("long").alias("_n"),
        )
        .filter("_n is not null")
        .join(wanted, ["_folder", "_key"], "left_semi")
        .groupBy("_folder", "_key").agg(F.max("_n").alias("_highest"))
    )


def _numbered_path(number: Column) -> Column:
    """The planned path with the number of its case."""
    name = P.basename("new_path")
    base, ext, own, folder = P.stem(name), P.extension(name), P.stem(P.basename("full_path")), P.dirname("full_path")
    return (
        F.when(F.col("_case") == "number", F.concat(folder, F.lit("/"), base, F.lit("-"), number.cast("string"), ext))
        .when(F.col("_case") == "keep", F.concat(folder, F.lit("/"), own, ext))
        .otherwise(F.col("new_path"))
    )


def single_invoices(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """``planned`` (written, unique full_path) with the path and ``invoice_n`` of each file as if it were the only one: it keeps the
    number it has, or gets one more than the highest there."""
    rows = _invoice_cases(planned)
    rows = rows.join(_highest_numbers(rows, listing), ["_folder", "_key"], "left")
    kept = F.regexp_extract(P.stem(P.basename("full_path")), _NUMBERED, 2).try_cast("long")
    number = F.when(F.col("_case") == "number", F.coalesce("_highest", F.lit(0)) + 1).when(F.col("_case") == "keep", kept)
    return rows.withColumn("invoice_n", number).withColumn("new_path", _numbered_path(F.col("invoice_n"))).drop("_case", "_folder", "_key", "_highest")


def invoice_numbers(planned: DataFrame, listing: DataFrame) -> DataFrame:
    """Invoices get ``-n`` after the planned name.

    A file that keeps its stem is left alone; one that already is number k of that name in its
    folder keeps k. Any other gets one more than the highest number of that name, in its folder or
    handed out earlier in the batch. Handing out is a fold of functions x -> max(c, x + d), so it
    runs in blocks like the feedback folds even when all files share one name.
    """
    base, own = P.stem(P.basename("new_path")), P.stem(P.basename("full_path"))
    rows = _invoice_cases(planned)
    highest = _highest_numbers(rows, listing)
    rows = write_down(rows.join(highest, ["_folder", "_key"], "left"), "invoices")
    # names that are kept as they are count as handed out for the name they extend
    kept_stem = F.when(F.col("_case") == "keep", own).otherwise(base)
    events = rows.filter("_case = 'number'").select(
        "position", "_key", (F.coalesce("_highest", F.lit(0)) + 1).alias("c"), F.lit(1).alias("d")
    ).unionByName(
        rows.filter("_case in ('same', 'keep')").select(
            "position", F.lower(F.regexp_extract(kept_stem, _NUMBERED, 1)).alias("_key"),
            F.regexp_extract(kept_stem, _NUMBERED, 2).try_cast("long").alias("c"), F.lit(0).alias("d"),
        ).filter("c is not null")
    )

    def raise_to(c, d) -> Column:
        return F.struct(c.cast("long").alias("c"), d.cast("long").alias("d"))

    effect = Effect(
        raise_to(F.col("c"), F.col("d")),
        raise_to(F.lit(0), F.lit(0)),
        lambda f, g: raise_to(F.greatest(g["c"], f["c"] + g["d"]), f["d"] + g["d"]),
        lambda f, x: F.greatest(f["c"], x + f["d"]),
    )
    given = running(events, ["_key"], F.lit(0).cast("long"), effect, order="position").select(
        "position", F.col("after").alias("_number")
    )
    return rows.join(given, "position", "left").withColumn("new_path", _numbered_path(F.col("_number"))).select(*planned.columns)


def commit_plan(plan: DataFrame, listing: DataFrame, keep_both: bool = False) -> DataFrame:
    """What a commit does with each row: (position, full_path, destination, status).

    Rows without a usable new name are skipped, and so is a row whose source is gone. A name is
    free when no file has it, or when the file that had it was renamed by an earlier row; the first
    such row gets it. Others are skipped, or with ``keep_both`` get the next free numbered name: then
    every row leaves its old name. Numbered names avoid all names there before the commit and those
    that its rows asked for and got.
    """
    usable = plan.filter("err is null and not same and new_path is not null")
    usable = write_down(usable.select("position", "full_path", "new_path"), "usable")
    names = usable.select("full_path").unionByName(usable.select(F.col("new_path").alias("full_path")))
    there = write_down(paths_there(listing, names, "full_path", "_held"), "there").select("full_path")
    rows = write_down(usable.join(there, "full_path", "left_semi").select("position", "full_path", "new_path"), "ops")
    # the file that holds the wanted name, and the row of the plan that takes it away
    holder = rows.select(F.col("full_path").alias("new_path"), F.col("position").alias("_leaves"))
    held = there.select(F.col("full_path").alias("new_path"), F.lit(True).alias("_held"))
    asked = rows.join(held, "new_path", "left").join(holder, "new_path", "left")
    could = F.col("_held").isNull() | (F.col("_leaves") < F.col("position"))
    asked = asked.withColumn("_could", F.coalesce(could, F.lit(False)))
    first = asked.filter("_could").groupBy("new_path").agg(F.min("position").alias("_first"))
    asked = write_down(asked.join(first, "new_path", "left").withColumn(
        "_could", F.col("_could") & (F.col("position") == F.col("_first"))
    ), "asked")
    if keep_both:
        settled = asked.withColumn("_free", F.col("_could"))
    else:
        nodes = asked.select(
            F.col("position").alias("id"),
            F.when(F.col("_could") & F.col("_held"), F.col("_leaves")).alias("next"),
            F.when(~F.col("_could"), False).when(F.col("_held").isNull(), True).alias("value"),
        )
        settled = asked.join(resolve(nodes).select(F.col("id").alias("position"), F.col("value").alias("_free")), "position")
        settled = write_down(settled, "settled")
    done = settled.filter("_free").select("position", "full_path", F.col("new_path").alias("destination"))
    late = settled.filter("not _free").select("position", "full_path", "new_path")
    if keep_both:
        seen = listing.select("full_path").unionByName(done.select(F.col("destination").alias("full_path")))
        late = free_destinations(
            late.withColumn("dest_dir", P.dirname("new_path")).withColumn("filename", P.basename("new_path")),
            seen, ["position"], first_slot=1,
        ).select("position", "full_path", "destination")
        done = done.unionByName(late)
    return plan.select("position", "full_path").join(
        done.select("position", "destination"), "position", "left"
    ).withColumn("status", F.when(F.col("destination").isNotNull(), "done").otherwise("skipped"))


def commit_counts(committed: DataFrame) -> DataFrame:
    return committed.groupBy("status").agg(F.count("*").alias("files"))


def single_plans(
    files: DataFrame, settings: Rename, duplicates: DataFrame, start: int = 1, listing: DataFrame | None = None, invoice: bool = False
) -> DataFrame:
    """Each file planned on its own (no counter shared with others), with its nearest duplicate
    (full_path, other, distance) unless the name is in error. A column ``taken_at`` of ``files`` is the capture date. With
    ``invoice`` names get an invoice number, given as ``invoice_n``; a template with a counter has its own."""
    listing = files if listing is None else listing
    taken_at = F.col("taken_at") if "taken_at" in files.columns else None
    name = renamed(settings, "full_path", F.lit(start), taken_at=taken_at)
    planned = write_down(files.select("full_path", name.alias("_r")).select("full_path", "_r.new_path", "_r.err"), "names")
    if invoice and not settings.parsed().uses("n"):
        planned = write_down(single_invoices(planned, listing), "numbered")
    elif invoice:
        planned = planned.withColumn("invoice_n", F.lit(None).cast("long"))
    there = paths_there(listing, planned, "new_path", "_there").withColumnRenamed("new_path", "_wanted")
    other = F.col("new_path") != F.col("full_path")
    return (
        planned.withColumn("_wanted", _wanted())
        .join(there, "_wanted", "left")
        .join(duplicates.select("full_path", "other", "distance"), "full_path", "left")
        .select(
            "full_path", "new_path", "err",
            ((F.col("new_path").isNull() & F.col("err").isNull()) | F.coalesce(~other, F.lit(False))).alias("same"),
            F.coalesce(F.col("_there") & other, F.lit(False)).alias("conflict"),
            F.when(F.col("err").isNull(), F.col("other")).alias("dup_path"),
            F.when(F.col("err").isNull(), F.col("distance")).alias("dup_distance"),
            *(["invoice_n"] if invoice else []),
        )
    )
