"""File listings: from a folder, or from any table with a ``full_path`` column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelf.functions import paths as P
from shelf.functions.names import human_size, natural_key
from shelf.operators.numbering import first_per, row_numbers
from shelf.sources.walk import reachable, walk


# Folders that Spark's file sources leave out unless a path or glob names them.
_UNDERSCORE = r"^_(?!metadata|common_metadata)[^=]*$"


def underscore_globs(spark: SparkSession, root: str) -> Iterator[tuple[int, str]]:
    """(level, glob) for each level below ``root`` that has folders starting with ``_``: how many folders lie between,
    and a glob of them. Only the file system's names are asked for, as a file source does itself."""
    folder, level = root.rstrip("/") or "", 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    while files.globStatus(path(f"{folder}/[^.]*")):
        if files.globStatus(path(f"{folder}/_*/")):
            yield level, f"{folder}/_*/"
        folder, level = f"{folder}/[^.]*", level + 1


def read_below(spark: SparkSession, root: str, source: str, path: Column) -> DataFrame:
    """Every file below ``root`` that ``source`` reads, each once; ``path`` is the column with its path.

    A file source skips folders that start with ``_``, but not those that a glob names. So there is one more read for
    each level with such folders, which keeps the files whose last skipped folder is on that level. Files whose own
    name starts with ``_`` cannot be had from Spark's file sources; see :func:`read_listing`."""

    def load(at: str) -> DataFrame:
        return spark.read.format(source).option("recursiveFileLookup", "true").load(at)

    at_root = spark._jvm.org.apache.hadoop.fs.Path(root)
    depth = at_root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at_root).depth()
    names = F.split(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    found = load(root)
    for level, glob in underscore_globs(spark, root):
        own = depth + 1 + level
        later = F.slice(names, own + 2, F.greatest(F.lit(0), F.size(names) - own - 1))
        here = F.get(names, F.lit(own)).rlike(_UNDERSCORE) & ~F.exists(later, lambda name: name.rlike(_UNDERSCORE))
        found = found.unionByName(load(glob).filter(here))
    return found


def underscore_files(spark: SparkSession, root: str) -> DataFrame:
    """(full_path, mtime, length) of the files below ``root`` whose own name starts with ``_``, for stores that only the JVM
    reaches: one glob per level, whose matches pass through the driver."""
    folder, rows = root.rstrip("/"), []
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    while files.globStatus(path(f"{folder}/[^.]*")):
        found = files.globStatus(path(f"{folder}/_*"))
        rows += [(f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in found if f.isFile()]
        folder = f"{folder}/[^.]*"
    listed = spark.createDataFrame(rows, "path string, ms bigint, length bigint")
    return listed.select(P.path_from_scheme("path").alias("full_path"), F.timestamp_millis("ms").alias("mtime"), "length")


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: full_path, mtime, length. File bytes are never read. Names that start with ``.`` and what is
    in such folders are left out; names that start with ``_`` are files and folders like any other.

    Folders are listed by tasks, level by level. For a store that only the JVM reaches, Spark's file source lists them, and
    the files it skips come from globs. A file that cannot be looked at has neither mtime nor length."""
    if reachable(root):
        return walk(spark, root).withColumn("full_path", P.path_from_scheme("full_path"))
    return read_below(spark, root, "binaryFile", F.col("path")).select(
        P.path_from_scheme("path").alias("full_path"),
        F.col("modificationTime").alias("mtime"),
        "length",
    ).unionByName(underscore_files(spark, root))


def index_scan(listing: DataFrame, root: Column | str, output_folders=P.OUTPUT_FOLDERS) -> DataFrame:
    """Files for the index: JPEG, PNG and PDF, except those directly in ``root`` or in a folder that
    is itself hidden or an output folder. Folders below such a folder still count."""
    folder = P.dirname("full_path")
    return (
        listing.filter(P.in_scope("full_path", root))
        .withColumn("filename", P.basename("full_path"))
        .withColumn("folder_name", P.basename(folder))
        .withColumn("extension", F.lower(P.extension("filename")))
        .filter(F.col("extension").isin(*P.INDEX_TYPES))
        .filter(~P.skipped_folder("folder_name", output_folders))
        .filter(folder != P.as_root(root))
    )


def image_scan(
    listing: DataFrame, root: Column | str, recursive: bool = True, output_folders=P.OUTPUT_FOLDERS
) -> DataFrame:
    """Images below ``root``: hidden and output folders are left out with all they contain, hidden
    files too."""
    name = P.basename("full_path")
    found = listing.filter(
        P.in_scope("full_path", root)
        & F.lower(P.extension(name)).isin(*P.IMAGE_TYPES)
        & ~name.startswith(".")
    )
    if recursive:
        return found.filter(~P.pruned("full_path", root, output_folders))
    return found.filter(P.dirname("full_path") == P.as_root(root))


def rename_listing(listing: DataFrame, folder: Column | str, subfolders: bool) -> DataFrame:
    """Files the renamer offers, with ``position`` in natural order of the file name."""
    name = P.basename("full_path")
    found = listing.filter(
        P.in_scope("full_path", folder) & F.lower(P.extension(name)).isin(*P.RENAME_TYPES)
    )
    if not subfolders:
        found = found.filter(P.dirname("full_path") == P.as_root(folder))
    found = found.withColumn("natural", natural_key(name))
    return row_numbers(found, [], ["natural", "full_path"], "position")


def file_payload(listing: DataFrame, folder: Column | str) -> DataFrame:
    """What a file list shows about each file."""
    name = P.basename("full_path")
    ext = F.lower(P.extension(name))
    return listing.select(
        F.col("full_path").alias("path"),
        name.alias("name"),
        P.relative_to("full_path", folder).alias("rel"),
        ext.alias("ext"),
        human_size("length").alias("size"),
        F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("mtime"),
        (ext == ".pdf").alias("is_pdf"),
        (ext.isin(*P.RENAME_TYPES) & (ext != ".pdf")).alias("is_image"),
    )


def child_folders(listing: DataFrame, folder: Column | str) -> DataFrame:
    """Distinct visible folders directly below ``folder``, with ``position`` in natural order."""
    segments = P.folders_below("full_path", folder)
    children = (
        listing.filter(P.in_scope("full_path", folder))
        .select(F.get(segments, 0).alias("child"))
        .filter(F.col("child").isNotNull() & ~F.col("child").startswith("."))
        .distinct()
        .withColumn("natural", natural_key("child"))
    )
    return row_numbers(children, [], ["natural", "child"], "position").drop("natural")


def distinct_paths(listing: DataFrame, order: str = "id") -> DataFrame:
    """One row per path: the one that comes first."""
    return first_per(listing, ["full_path"], [order])
