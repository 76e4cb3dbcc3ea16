"""Classification quality from (label, prediction) counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("rows"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio is undefined."""
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).alias("hits")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("rows").alias("predicted"),
                     F.lit(0).cast("bigint").alias("hits")),
        )
    )
    sums = cm.select(sides.alias("s")).select("s.*").groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return sums.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), "support",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages, one row each."""
    n = F.sum("support")
    wide = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        n.alias("support"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("average"), *[F.col(f"{k}_{m}").alias(m) for m in ("precision", "recall", "f1")], F.col("support"))
            for k in ("macro", "weighted")
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def binary_metrics(cm: DataFrame, positive: int = 1) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 and false-positive rate."""
    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))

    actual, said = F.col("label") == positive, F.col("prediction") == positive
    counts = cm.agg(
        n(actual & said).alias("tp"), n(~actual & said).alias("fp"),
        n(actual & ~said).alias("fn"), n(~actual & ~said).alias("tn"),
        n(F.col("label") == F.col("prediction")).alias("_right"), n(F.lit(True)).alias("_all"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        "tp", "fp", "fn", "tn", _ratio(F.col("_right"), F.col("_all")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(fp, fp + tn).alias("fpr"),
    )
