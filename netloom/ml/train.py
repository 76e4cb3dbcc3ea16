"""Train, evaluate, store and load flow classifiers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.metrics import binary_metrics, confusion
from netloom.operators.scaling import Scaler, fit_robust, fit_standard, with_class_weight
from netloom.operators.splits import require_both_classes
from netloom.schema import LABELS


def random_forest(trees: int = 100, depth: int = 30, balanced: bool = False, seed: int = 42):
    """``depth`` 30 is the deepest that Spark grows."""
    kind = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return kind.setWeightCol("weight") if balanced else kind


def logistic_regression(total_weight: float, max_iter: int = 1000, balanced: bool = True):
    """Penalty 1 per unit of total weight, as the usual C=1."""
    kind = LogisticRegression(
        labelCol="label", featuresCol="features", maxIter=max_iter, regParam=1.0 / max(total_weight, 1.0),
        standardization=False,
    )
    return kind.setWeightCol("weight") if balanced else kind


def gradient_boosting(rounds: int = 100, balanced: bool = True, seed: int = 42):
    """Two classes only."""
    kind = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, seed=seed)
    return kind.setWeightCol("weight") if balanced else kind


#: Training rows from which they are dealt out evenly, the tasks each core gets then, and the most rows of one.
DEAL_FROM, TASKS, ROWS = 500_000, 3, 500_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in even partitions, on the executors' disks until ``unpersist``; few rows as they are.

    A classifier passes over its rows once for each level or step, and a pass lasts as long as its longest
    task. As files, rows come in fewer and unlike parts, and those past the cores wait for a second turn.
    Kept, they are dealt once: training reads them four times before its passes and plans them again after.
    """
    if n < DEAL_FROM:
        return rows
    tasks = max(TASKS * rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    return rows.repartition(tasks).persist(StorageLevel.DISK_ONLY)


@dataclass
class FlowModel:
    """Scaler and classifier that belong together, so training and scoring cannot differ."""

    name: str
    features: list
    scaler: Scaler
    pipeline: PipelineModel

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``, ``predicted_class`` and ``confidence`` (the top probability)."""
        absent = [c for c in self.features if c not in rows.columns]
        if absent:
            raise ValueError(f"features missing: {', '.join(absent)}")
        # Scale copies, so the caller's columns stay as they are.
        scaled = [
            ((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"_z_{c}")
            for c, m, s in zip(self.scaler.columns, self.scaler.center, self.scaler.scale)
        ]
        out = self.pipeline.transform(rows.select("*", *scaled))
        names = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
        number = F.col("prediction").cast("int")
        return out.withColumns(
            {
                "prediction": number,
                "predicted_class": F.coalesce(F.try_element_at(names, number), number.cast("string")),
                "confidence": F.array_max(vector_to_array("probability")),
            }
        ).drop("features", "rawPrediction", "probability", *[f"_z_{c}" for c in self.features])

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = {"name": self.name, "features": self.features, "scaler": self.scaler.to_json()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FlowModel":
        """Fails at once when a part is missing."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return FlowModel(
            meta["name"], meta["features"], Scaler.from_json(meta["scaler"]), PipelineModel.load(f"{path}/pipeline")
        )


def fit(train: DataFrame, features: list[str], classifier, name: str = "RandomForest", scaling: str = "standard") -> FlowModel:
    """Fit the scaler on the training rows, then the classifier on scaled rows."""
    scaler = (fit_robust if scaling == "robust" else fit_standard)(train, features)
    if classifier.hasParam("weightCol") and classifier.isSet("weightCol") and "weight" not in train.columns:
        train = with_class_weight(train)
    scaled = [
        ((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"_z_{c}")
        for c, m, s in zip(scaler.columns, scaler.center, scaler.scale)
    ]
    assembler = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="features", handleInvalid="error")
    named = [p for p in classifier.params if p.name.endswith("Col") and classifier.isDefined(p)]
    used = {classifier.getOrDefault(p).lower() for p in named}
    rows = train.select(*[F.col(f"`{c}`") for c in train.columns if c.lower() in used], *scaled)
    rows = _dealt(rows, train.count())
    try:
        pipeline = Pipeline(stages=[assembler, classifier]).fit(rows)
    finally:
        rows.unpersist()
    return FlowModel(name, list(features), scaler, pipeline)


def evaluate(model: FlowModel, rows: DataFrame) -> DataFrame:
    """One row of binary metrics on held-out rows."""
    return binary_metrics(confusion(model.predict(rows)))


def train_and_report(
    rows: DataFrame, features: list[str], classifiers: dict, path: str | None = None, scaling: str = "standard",
    test: str = "test",
) -> DataFrame:
    """Fit each classifier on ``split = 'train'``, report metrics on ``split = test``."""
    require_both_classes(rows, needed=("train", test))
    reports = None
    for name, classifier in classifiers.items():
        model = fit(rows.filter(F.col("split") == "train"), features, classifier, name, scaling)
        report = evaluate(model, rows.filter(F.col("split") == test)).withColumn("model", F.lit(name))
        if path:
            model.save(rows.sparkSession, f"{path}/{name}")
        reports = report if reports is None else reports.unionByName(report)
    if path:
        reports.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    return reports
