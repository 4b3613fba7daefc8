"""The file index kept up to date from a stream of listings or files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelf.functions import paths as P
from shelf.operators.numbering import first_per
from shelf.sources.listing import index_scan
from shelf.sources.walk import FolderFiles, reachable


def watch_files(spark: SparkSession, root: str, settle: float = 0.1) -> DataFrame:
    """A stream of (full_path, mtime, length) of files that appear below ``root``, names with ``_`` among them.

    Offsets are times, ``settle`` seconds behind the clock, which must exceed how far the clocks of writers and readers
    differ. A file that changes comes again. Tasks list the folders, so the store must be one that they reach."""
    if not reachable(root):
        raise ValueError(f"tasks cannot list {root}; follow a stream of listings instead")
    spark.dataSource.register(FolderFiles)
    files = spark.readStream.format("folder_files").option("settle", settle).load(root)
    return files.withColumn("full_path", P.path_from_scheme("full_path"))


def follow_index(listing: DataFrame, index_path: str, root: str, checkpoint: str) -> StreamingQuery:
    """Append new paths of a listing stream to the Parquet index, one folder per batch.

    A repeated batch overwrites its own folder and compares with the other folders only, so a restart
    leaves each path in the index once.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = first_per(index_scan(batch, root), ["full_path"], ["mtime"])
        before = read_index(spark, index_path)
        if before is not None:
            earlier = before.filter(F.col("batch") < batch_id)
            found = found.join(earlier.select("full_path"), "full_path", "left_anti")
        found.write.mode("overwrite").parquet(os.path.join(index_path, f"batch={batch_id}"))

    return (
        listing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """The index written so far, or None before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(index_path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return None
    return spark.read.parquet(index_path)
