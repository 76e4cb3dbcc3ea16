"""Model verdicts for flow rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.ml.train import FlowModel
from netloom.operators.features import flow_features


def flow_scorer(model: FlowModel) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``detect_ddos``: flow rows in, ``predicted_class`` added."""

    def score(flows: DataFrame) -> DataFrame:
        keep = [c for c in flows.columns if c not in model.features]
        made = flow_features()
        scored = model.predict(flows.select(*keep, *[made[n].alias(n) for n in model.features]))
        return scored.select(*keep, "predicted_class", F.col("confidence").alias("model_confidence"))

    return score
