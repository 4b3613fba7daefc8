"""Trained locators that are kept: one folder per version, found by the signature of the examples they were trained on.

``folder`` holds the models, each in a folder of its own name, and two tables that are only appended to: ``versions``
(signature, path, n, at) and ``scores`` (signature, cv_iou, at). A version's row is written after its model, so a run that
stops half way leaves a model that nothing points to.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.operators import locate

_VERSIONS = "signature string, path string, n long, at timestamp"
_SCORES = "signature string, cv_iou double, at timestamp"


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _append(spark: SparkSession, folder: str, name: str, row: tuple, schema: str) -> None:
    one = spark.createDataFrame([(*row, None)], schema).withColumn("at", F.current_timestamp())
    one.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def saved_models(spark: SparkSession, folder: str) -> DataFrame:
    """(signature, path, n, cv_iou) of the versions in ``folder``: the latest of each signature, and its latest score."""
    latest = _table(spark, folder, "versions", _VERSIONS).groupBy("signature").agg(F.max_by(F.struct("path", "n"), "at").alias("v"))
    scores = _table(spark, folder, "scores", _SCORES).groupBy("signature").agg(F.max_by("cv_iou", "at").alias("cv_iou"))
    return latest.select("signature", "v.path", "v.n").join(scores, "signature", "left")


def stored_model(folder: str, samples: DataFrame, cells: DataFrame) -> RandomForestClassificationModel | None:
    """The locator for these examples: loaded where one was trained on the same, else trained and kept. None for fewer
    than three photos.

    ``samples`` has image_id, path, box (fractions) and mtime; ``cells`` the features of these photos with gw and gh."""
    spark = samples.sparkSession
    now = signature_of(samples)
    if now["n"] < locate.MIN_PHOTOS:
        return None
    known = saved_models(spark, folder).filter(F.col("signature") == now["signature"]).first()
    if known is not None:
        return RandomForestClassificationModel.load(known["path"])
    model = locate.train(locate.cell_labels(cells, samples), now["n"])
    path = f"{folder}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    _append(spark, folder, "versions", (now["signature"], path, now["n"]), _VERSIONS)
    return model


def signature_of(samples: DataFrame):
    """Row (n, signature) of examples with path, box and mtime."""
    flat = samples.select("path", "mtime", *[F.col(f"box.{s}").alias(f"box_{s}") for s in "ltrb"])
    return locate.examples_signature(flat).first()


def record_accuracy(folder: str, samples: DataFrame, cells: DataFrame, folds: int = 5) -> float | None:
    """The mean shared area over the folds, kept beside the model of these examples; None below four photos."""
    scores = locate.evaluate_folds(cells.drop("gw", "gh"), samples.select("image_id", "path", "box"), folds)
    if scores is None:
        return None
    mean = scores.agg(F.avg("iou")).first()[0]
    _append(samples.sparkSession, folder, "scores", (signature_of(samples)["signature"], mean), _SCORES)
    return mean


def status(folder: str, samples: DataFrame) -> DataFrame:
    """(n, needed, trained, cv_iou) of these examples and what is kept in ``folder``."""
    flat = samples.select("path", "mtime", *[F.col(f"box.{s}").alias(f"box_{s}") for s in "ltrb"])
    return locate.model_status(flat, saved_models(samples.sparkSession, folder).select("signature", "cv_iou"))
