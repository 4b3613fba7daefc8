"""One book (PDF) per folder: its pages in order, its summary, the link report; export; calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions import paths as P
from shelf.functions.names import natural_key
from shelf.operators.index import insert_if_absent, paths_there
from shelf.operators.numbering import first_per, row_numbers
from shelf.session import write_down
from shelf.sources.listing import index_scan


def export_selection(index: DataFrame) -> DataFrame:
    """``0.jpeg`` and ``dd-mm-yyyy.jpeg`` of every folder, named ``<folder>_0``.

    Later rows overwrite earlier ones; ``overwritten`` counts the earlier ones.
    """
    chosen = index.filter(
        (F.lower(P.extension("filename")) == ".jpeg")
        & ((F.col("filename") == "0.jpeg") | F.rlike("filename", F.lit(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}\.jpeg$")))
    )
    return (
        chosen.groupBy(F.concat("folder_name", F.lit("_0")).alias("export_name"))
        .agg(
            F.max_by("full_path", "id").alias("full_path"),
            (F.count("*") - 1).alias("overwritten"),
        )
    )


def day_calendar(months: DataFrame) -> DataFrame:
    """31 folder names for each (month, year) row, whatever the month; wrong months are an error."""
    valid = F.col("month").between(1, 12) & (F.col("year") >= 1)
    checked = F.when(valid, F.sequence(F.lit(1), F.lit(31))).otherwise(
        F.raise_error(F.lit("month must be 1-12 and year positive"))
    )
    return months.select("month", "year", F.explode(checked).alias("day")).withColumn(
        "folder_name", F.format_string("%02d-%02d-%d", "day", "month", "year")
    )


def day_coverage(months: DataFrame, index: DataFrame) -> DataFrame:
    """Files per calendar day folder, zero where the folder is empty or missing."""
    counts = index.groupBy("folder_name").agg(F.count("*").alias("n"))
    return (
        day_calendar(months)
        .join(counts, "folder_name", "left")
        .withColumn("files", F.coalesce("n", F.lit(0).cast("long")))
        .drop("n")
    )


def _book_folders(index: DataFrame) -> DataFrame:
    # `_` in the pattern stands for any one character and case does not matter; the second
    # comparison is with a literal question mark
    return index.filter(
        ~F.col("folder_name").ilike("export_output") & ~F.col("folder_name").ilike("?")
    )


def book_name(folder: Column | str) -> Column:
    return F.concat(F.replace(P.as_column(folder), F.lit("."), F.lit("-")), F.lit(".pdf"))


def page_manifest(index: DataFrame) -> DataFrame:
    """Pages of each folder's book in natural order of the file name.

    Folders of the same name are one book, wherever they lie; a PDF that carries the name of any
    book is a product of an earlier run and left out.
    """
    rows = _book_folders(index)
    products = rows.select(F.lower(book_name("folder_name")).alias("_product")).distinct()
    ext = F.lower(P.extension("filename"))
    printable = rows.withColumn("is_pdf", ext == ".pdf").filter(F.col("is_pdf") | ext.isin(*P.IMAGE_TYPES))
    # only PDFs can be products; images take no part in the join
    own = printable.filter("is_pdf").withColumn("_product", F.lower("filename"))
    pages = (
        own.join(products, "_product", "left_anti").drop("_product")
        .unionByName(printable.filter("not is_pdf"))
        .withColumn("natural", natural_key("filename"))
    )
    return row_numbers(pages, ["folder_name"], ["natural", "id"], "page_no")


def book_paths(manifest: DataFrame) -> DataFrame:
    """Where each book goes: next to its first page."""
    first = manifest.groupBy("folder_name").agg(F.min_by("full_path", "page_no").alias("first"))
    return first.select(
        "folder_name", F.concat(P.dirname("first"), F.lit("/"), book_name("folder_name")).alias("pdf_path")
    )


def book_summary(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages per folder; ``skipped`` where a folder has nothing printable."""
    found = manifest.groupBy("folder_name").agg(
        F.count("*").alias("pages"),
        F.count_if("is_pdf").alias("pdfs"),
        F.sum("length").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    return (
        _book_folders(index).select("folder_name").distinct()
        .join(found, "folder_name", "left")
        .select(
            "folder_name",
            *[F.coalesce(c, zero).alias(c) for c in ("pages", "pdfs", "bytes")],
            F.col("pages").isNull().alias("skipped"),
        )
    )


def link_report(index: DataFrame, listing: DataFrame, link_dir: str) -> DataFrame:
    """Per folder the book it should have, whether it exists, and whether a link is replaced.

    The folder's first path in natural order of the file name decides where the book is looked for.
    """
    first = first_per(
        _book_folders(index).withColumn("natural", natural_key("filename")),
        ["folder_name"], ["natural", "id"],
    )
    expected = first.select(
        "folder_name",
        F.concat(P.dirname("full_path"), F.lit("/"), book_name("folder_name")).alias("pdf_path"),
        F.concat(F.lit(link_dir + "/"), book_name("folder_name")).alias("link_path"),
    )
    expected = write_down(expected, "books")
    exists = paths_there(listing, expected, "pdf_path", "_book")
    linked = paths_there(listing, expected, "link_path", "_link")
    return (
        expected.join(exists, "pdf_path", "left")
        .join(linked, "link_path", "left")
        .select(
            "folder_name", "pdf_path", "link_path",
            F.when(F.col("_book"), "linked").otherwise("missing").alias("status"),
            F.coalesce(F.col("_book") & F.col("_link"), F.lit(False)).alias("replaced"),
        )
    )


def one_click(index: DataFrame, listing: DataFrame, root: str, link_dir: str) -> DataFrame:
    """Index new files, list the books, report the links: one row per folder."""
    scanned = index_scan(listing, root)
    added = insert_if_absent(index, scanned.select(*index.columns))
    full = index.unionByName(added)
    manifest = page_manifest(full)
    pages = manifest.groupBy("folder_name").agg(F.count("*").alias("pages"))
    built = book_paths(manifest).select(F.col("pdf_path").alias("full_path"))
    return (
        link_report(full, listing.select("full_path").unionByName(built), link_dir)
        .join(pages, "folder_name", "left")
        .withColumn("pages", F.coalesce("pages", F.lit(0).cast("long")))
    )
