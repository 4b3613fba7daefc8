"""Where dated files belong: month folders, or day folders inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions import paths as P
from shelf.functions.names import date_in_name
from shelf.operators.slots import free_destinations


def month_moves(
    listing: DataFrame, root: Column | str, recursive: bool = True, by_day: bool = False,
    output_folders=P.OUTPUT_FOLDERS,
) -> DataFrame:
    """Files whose name holds a date and which are not yet in the folder of that date."""
    date = F.col("_date")
    month = F.format_string("%02d-%04d", date["month"], date["year"])
    folder = F.concat_ws("/", P.as_text(root), month)
    if by_day:
        # the year of a day folder is not padded
        folder = F.concat_ws(
            "/", folder, F.format_string("%02d-%02d-%d", date["day"], date["month"], date["year"])
        )
    files = (
        listing.filter(P.in_scope("full_path", root))
        .withColumn("filename", P.basename("full_path"))
        .filter(~F.col("filename").startswith("."))
        .withColumn("_date", date_in_name("filename"))
        .filter("_date is not null")
    )
    if recursive:
        files = files.filter(~P.pruned("full_path", root, output_folders))
    else:
        files = files.filter(P.dirname("full_path") == P.as_text(root))
    return (
        files.withColumn("dest_dir", folder)
        .filter(P.dirname("full_path") != F.col("dest_dir"))
        .withColumnRenamed("full_path", "source")
        .drop("_date")
    )


def month_destinations(moves: DataFrame, listing: DataFrame) -> DataFrame:
    """Give each planned move a free name, in order of the source paths."""
    return free_destinations(moves, listing, ["source"])


def month_report(destinations: DataFrame) -> DataFrame:
    renamed = P.basename("destination") != F.col("filename")
    return destinations.groupBy("dest_dir").agg(
        F.count("*").alias("moved"), F.count_if(renamed).alias("renamed")
    )
