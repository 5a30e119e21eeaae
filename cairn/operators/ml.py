"""Random forests on point features through Spark ML, with a model registry in a folder."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import STANDARD_ATTRIBUTES
from . import metrics, sample

#: Most trees and depth, and the fewest rows of a leaf. Spark has no least size for a split; the
#: least size of a leaf is its nearest setting and not equivalent.
DEFAULTS = {"trees": 200, "depth": 15, "leaf": 1, "seed": 0}
POSITION = ("X", "Y", "Z")


def trainable_features(columns: Sequence[str]) -> list[str]:
    """Position and all other columns but time, class and label."""
    return list(dict.fromkeys([*POSITION, *[c for c in columns if c.lower() not in ("gps_time", "classification", "labels") and c not in POSITION]]))


def inference_features(columns: Sequence[str]) -> list[str]:
    """Position, intensity, colour and the extra columns."""
    keep = {"x", "y", "z", "intensity", "red", "green", "blue"}
    return [c for c in columns if c.lower() in keep or c.lower() not in {a.replace(" ", "_") for a in STANDARD_ATTRIBUTES} | set(STANDARD_ATTRIBUTES)]


def present_features(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Those the table has, and those it lacks."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def require_features(wanted: Sequence[str], df: DataFrame, what: str) -> None:
    """An error if the table lacks a feature: two tables of one training have the same features."""
    lacking = present_features(df, wanted)[1]
    if lacking:
        raise ValueError(f"the {what} table lacks {lacking}")


def memory_cap(budget: int, features: int) -> int:
    """Points that a training budget in bytes allows."""
    return max(100_000, int(budget * 0.5 / (8 * features + 8)))


def train_forest(points: DataFrame, features: Sequence[str], label: str = "labels", cap: int | None = None, trees: int = DEFAULTS["trees"], depth: int = DEFAULTS["depth"], leaf: int = DEFAULTS["leaf"], seed: int = DEFAULTS["seed"]) -> PipelineModel:
    """Fit on a stratified sample of at most about ``cap`` points."""
    have, lacking = present_features(points, features)
    if not have:
        raise ValueError(f"no feature of {lacking} is in the table")
    if lacking:
        warnings.warn(f"features that the table lacks are left out: {lacking}", stacklevel=2)
    df = sample.stratified_sample(points, cap, class_id=label) if cap else points
    df = df.withColumn("__label", F.col(label).cast("string"))
    stages = [
        StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=have, outputCol="__features", handleInvalid="skip"),
        RandomForestClassifier(labelCol="__index", featuresCol="__features", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed),
    ]
    return Pipeline(stages=stages).fit(df)


def classify(model: PipelineModel, points: DataFrame) -> DataFrame:
    """The points with an integer ``prediction``; rows with a missing feature get null."""
    assembler = model.stages[1]
    lacking = [c for c in assembler.getInputCols() if c not in points.columns]
    if lacking:
        raise ValueError(f"the table lacks the model's features {lacking}")
    labels = F.array(*[F.lit(int(float(x))) for x in model.stages[0].labels])
    df = points.withColumn("__label", F.lit(model.stages[0].labels[0]))
    made = PipelineModel(stages=[assembler.copy({assembler.handleInvalid: "keep"}), model.stages[2]]).transform(df.drop("prediction"))
    complete = F.lit(True)
    for c in assembler.getInputCols():
        complete = complete & F.col(c).isNotNull()
    return made.select(*[c for c in points.columns if c != "prediction"], F.when(complete, F.element_at(labels, F.col("prediction").cast("int") + 1)).alias("prediction"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features with their impurity importance, most important first."""
    values = model.stages[2].featureImportances.toArray()
    return sorted(zip(model.stages[1].getInputCols(), map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def evaluate(model: PipelineModel, points: DataFrame, label: str = "labels") -> DataFrame:
    """The confusion matrix on labelled points."""
    return metrics.confusion(classify(model, points).select(F.col(label).cast("int").alias("y"), F.col("prediction").alias("yhat")))


class Registry:
    """Saved models in one folder, each with its metadata; reads and writes go through Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_\-.]+", name) or name.startswith("."):
            raise ValueError(f"not a model name: {name!r}")
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, name: str, model: PipelineModel, metadata: dict) -> None:
        model.write().overwrite().save(f"{self._path(name)}/model")
        text = json.dumps({**metadata, "features": model.stages[1].getInputCols()}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._path(name)}/metadata")

    def load(self, name: str) -> tuple[PipelineModel, dict]:
        text = self.spark.read.text(f"{self._path(name)}/metadata").first().value
        return PipelineModel.load(f"{self._path(name)}/model"), json.loads(text)

    def exists(self, name: str) -> bool:
        p, fs = self._fs(self._path(name))
        return fs.exists(p)

    def delete(self, name: str) -> bool:
        p, fs = self._fs(self._path(name))
        return fs.delete(p, True)

    def names(self) -> list[str]:
        p, fs = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
