"""The file index as a table that is stored by the hash of its paths.

Known paths lie in buckets, so the join of a new listing with them moves the listing only. Every insert appends a file per
bucket; compaction writes the buckets anew, one file each, into a folder of its own, and the table then reads that.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.operators.numbering import first_per
from shelf.session import write_down

BUCKETS = 64


class StoredIndex:
    """An index below ``folder``: full_path and whatever other columns its first listing has.

    The folder holds versions (v1, v2, …); the latest complete one counts. One writer at a time; a repeated insert adds
    nothing, and a compaction that stops half way leaves a version that is not read."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.table = f"shelf_index_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._files = path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.folder))]
        whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and self._files.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole)

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        rows.write.mode(mode).format("parquet").option("path", f"{self.folder}/v{version}").bucketBy(self.buckets, "full_path").saveAsTable(self.table)

    def known(self) -> DataFrame | None:
        """The stored rows, laid out by path; None before the first insert."""
        versions = self._versions()
        if not versions:
            return None
        at = f"{self.folder}/v{versions[-1]}"
        if not self.spark.catalog.tableExists(self.table) or not self._reads(at):
            self.spark.sql(f"drop table if exists {self.table}")
            columns = self.spark.read.parquet(at).schema
            listed = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
            self.spark.sql(f"create table {self.table} ({listed}) using parquet clustered by (full_path) into {self.buckets} buckets location '{at}'")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _reads(self, at: str) -> bool:
        rows = self.spark.sql(f"describe formatted {self.table}").filter("col_name = 'Location'").collect()
        return bool(rows) and rows[0]["data_type"].rstrip("/").endswith(at.split(":")[-1])

    def missing(self, listing: DataFrame, order: str = "mtime") -> DataFrame:
        """The rows of ``listing`` whose path is not known, one per path. Only the listing is shuffled."""
        fresh = first_per(listing, ["full_path"], [order])
        known = self.known()
        return fresh if known is None else fresh.join(known.select("full_path"), "full_path", "left_anti").select(listing.columns)

    def insert(self, listing: DataFrame, order: str = "mtime") -> None:
        """Add the paths that are not there yet."""
        fresh = write_down(self.missing(listing, order), "fresh").repartition(self.buckets, "full_path")
        versions = self._versions()
        if not versions:
            self.spark.sql(f"drop table if exists {self.table}")
        self._write(fresh, versions[-1] if versions else 1, "append" if versions else "errorifexists")

    def files(self) -> int:
        """Data files of the version that is read."""
        versions = self._versions()
        found = self._files.listStatus(self._path(f"{self.folder}/v{versions[-1]}")) if versions else []
        return sum(f.getPath().getName().startswith("part-") for f in found)

    def compact(self) -> None:
        """One file per bucket again. Rows stay in their buckets; nothing is shuffled."""
        rows, versions = self.known(), self._versions()
        if rows is None:
            return
        place = f"{self.folder}/v{versions[-1] + 1}"
        name = f"{self.table}_new"
        self.spark.sql(f"drop table if exists {name}")
        option = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = self.spark.conf.get(option)
        self.spark.conf.set(option, "false")  # read bucket by bucket, though nothing is joined
        try:
            rows.sortWithinPartitions("full_path").write.mode("overwrite").format("parquet").option("path", place).bucketBy(self.buckets, "full_path").sortBy("full_path").saveAsTable(name)
        finally:
            self.spark.conf.set(option, before)
        self.spark.sql(f"drop table if exists {name}")  # only its name; the files belong to the version
        self.spark.sql(f"drop table if exists {self.table}")
