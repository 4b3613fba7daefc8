"""Hand-drawn boxes from a JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.functions import paths as P
from shelf.operators.numbering import first_per

_SCHEMA = "image_size array<int>, type string, boxes map<string, array<int>>"


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, ew, eh, l, t, r, b): one row per named box, in pixels of a photo of ew x eh."""
    raw = spark.read.schema(_SCHEMA).option("multiLine", "true").json(path)
    return box_rows(raw)


def box_rows(raw: DataFrame) -> DataFrame:
    size = F.col("image_size")
    named = raw.select(
        F.coalesce("type", F.lit("invoice")).alias("type"),
        F.coalesce(F.get(size, 0), F.lit(0)).alias("ew"), F.coalesce(F.get(size, 1), F.lit(0)).alias("eh"),
        F.explode("boxes").alias("name", "box"),
    )
    return named.select("name", "type", "ew", "eh", *[F.get("box", i).alias(s) for i, s in enumerate("ltrb")])


def import_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Match boxes to images (full_path, w, h) by file name, the first path winning, and scale them to
    the size of the image; a box whose image is missing keeps a null path."""
    named = first_per(images.withColumn("name", P.basename("full_path")), ["name"], ["full_path"])
    known = (F.col("ew") != 0) & (F.col("eh") != 0)
    sx = F.when(known, F.col("w") / F.col("ew")).otherwise(1.0)
    sy = F.when(known, F.col("h") / F.col("eh")).otherwise(1.0)
    scale = {"l": sx, "t": sy, "r": sx, "b": sy}
    return boxes.join(named.select("name", "full_path", "w", "h"), "name", "left").select(
        "name", "type", "full_path", "w", "h", *[(F.col(s) * scale[s]).alias(s) for s in "ltrb"]
    )


def import_counts(imported: DataFrame) -> DataFrame:
    missing = F.col("full_path").isNull()
    return imported.agg(F.count_if(~missing).alias("added"), F.count_if(missing).alias("missing"))
