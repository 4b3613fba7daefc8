"""Text fields of files: which a type supports, tag tables, merging new values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions.paths import as_column

# The six fields, and those a PDF has.
FIELDS = ("title", "description", "author", "keywords", "copyright", "comment")
PDF_FIELDS = ("title", "description", "author", "keywords")


def supported_fields(ext: Column | str) -> Column:
    ext = F.lower(as_column(ext))
    every, pdf, none = (F.array(*map(F.lit, names)).cast("array<string>") for names in (FIELDS, PDF_FIELDS, ()))
    return F.when(ext == ".pdf", pdf).when(ext.isin(".jpg", ".jpeg", ".png"), every).otherwise(none)


def _without_nuls(text: Column) -> Column:
    return F.regexp_replace(text, "\\x00+$", "")


def wide_text(raw: Column | str) -> Column:
    """Text of a two-byte tag."""
    return F.coalesce(_without_nuls(F.decode(as_column(raw), "UTF-16LE")), F.lit(""))


def plain_text(raw: Column | str) -> Column:
    """Text of a one-byte tag; bytes that are no UTF-8 become the replacement character."""
    return F.coalesce(_without_nuls(F.make_valid_utf8(as_column(raw).cast("string"))), F.lit(""))


def fields_from_tags(tags: DataFrame, by: str = "path") -> DataFrame:
    """One row per file from a table (path, tag, bytes)."""

    def raw(tag: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.col("bytes")))

    wide = ("XPTitle", "XPAuthor", "XPKeywords", "XPComment")
    plain = ("ImageDescription", "Artist", "Copyright")
    found = tags.groupBy(by).agg(*[raw(tag).alias(tag) for tag in wide + plain])
    artist = plain_text("Artist")
    return found.select(
        by,
        wide_text("XPTitle").alias("title"),
        plain_text("ImageDescription").alias("description"),
        F.when(artist != "", artist).otherwise(wide_text("XPAuthor")).alias("author"),
        wide_text("XPKeywords").alias("keywords"),
        plain_text("Copyright").alias("copyright"),
        wide_text("XPComment").alias("comment"),
    )


def merge_fields(files: DataFrame, values: dict[str, str], ext: str = "ext") -> DataFrame:
    """Write non-blank ``values`` into the fields each file supports; ``status`` done or skipped."""
    filled = {k: v for k, v in values.items() if (v or "").strip()}
    if not filled:
        raise ValueError("no field to fill in")
    have = supported_fields(ext)
    touched, new = F.lit(False), {}
    for name, value in filled.items():
        old = F.coalesce(F.col(name), F.lit("")) if name in files.columns else F.lit("")
        writable = F.array_contains(have, name)
        touched = touched | (writable & (old != value))
        new[name] = F.when(writable, F.lit(value)).otherwise(old)
    # the status reads the old values, so it is taken before they change
    return files.withColumn("status", F.when(touched, "done").otherwise("skipped")).withColumns(new)
