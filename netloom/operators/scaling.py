"""Scalers and class weights, fitted on training rows only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordering import exact_quantiles
from netloom.session import materialize


@dataclass(frozen=True)
class Scaler:
    """``(x - center) / scale`` per column; a zero spread scales by 1."""

    columns: list
    center: list
    scale: list

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.center, self.scale)
            }
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Scaler":
        return Scaler(**json.loads(text))


def fit_standard(train: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population standard deviation."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return Scaler(
        list(columns), [row[f"m_{c}"] for c in columns], [row[f"s_{c}"] or 1.0 for c in columns]
    )


def fit_robust(train: DataFrame, columns: list[str]) -> Scaler:
    """Median and interquartile range, exact."""
    rows = exact_quantiles(train, columns, [0.25, 0.5, 0.75]).collect()
    at = {(r["name"], r["q"]): r["value"] for r in rows}
    return Scaler(
        list(columns),
        [at[c, 0.5] for c in columns],
        [(at[c, 0.75] - at[c, 0.25]) or 1.0 for c in columns],
    )


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(float(total["n"] or 0)) / (F.lit(max(total["k"], 1)) * F.col("rows"))
    return counts.withColumn("weight", weight)


def with_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    weights = materialize(class_weights(rows, label).select(label, "weight"), "weights")
    return rows.join(weights, label)


def drop_unusable(rows: DataFrame, columns: list[str], policy: str = "reject", label: str = "label") -> DataFrame:
    """Rows fit for training: a known label, and missing features rejected or set to 0."""
    known = rows.filter(F.col(label) >= 0)
    if policy == "reject":
        return known.dropna(subset=columns)
    if policy == "impute":
        return known.fillna(0.0, subset=columns)
    raise ValueError(f"unknown missing-value policy: {policy}")
