"""Shape of a verdict, and the protocol a custom detector follows.

A detector returns rows only for flow windows where it has something to say. A flow
window without a row counts as NOT_DETECTED, so ordinary traffic never reaches the
shuffle that combines verdicts.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.features import FLOW_ID_COLUMNS
from netloom.schema import RESULT_TYPE


class Detector(Protocol):
    """Any callable from flow rows to verdict rows (see ``verdict_rows``)."""

    def __call__(self, flows: DataFrame) -> DataFrame: ...


def evidence(**values: Column) -> Column:
    """Named evidence values as a string map."""
    pairs = []
    for name, value in values.items():
        pairs += [F.lit(name), value.cast("string")]
    return F.create_map(*pairs)


def verdict(
    detector: str,
    status: Column | str,
    threat_type: str | None = None,
    severity: str | None = None,
    confidence: Column | None = None,
    score: Column | None = None,
    evidence: Column | None = None,
    error: Column | None = None,
) -> Column:
    """A ``RESULT_TYPE`` struct; threat fields are filled only for DETECTED/UNVALIDATED."""
    status = F.lit(status) if isinstance(status, str) else status
    fires = status.isin("DETECTED", "UNVALIDATED")

    def when_fired(value, kind):
        value = F.lit(value) if not isinstance(value, Column) else value
        return F.when(fires, value).cast(kind)

    return F.struct(
        F.lit(detector).alias("detector"),
        status.alias("status"),
        when_fired(threat_type, "string").alias("threat_type"),
        when_fired(severity, "string").alias("severity"),
        when_fired(confidence, "double").alias("confidence"),
        when_fired(score, "double").alias("score"),
        (F.when(fires, evidence) if evidence is not None else F.lit(None))
        .cast("map<string,string>")
        .alias("evidence"),
        (error if error is not None else F.lit(None)).cast("string").alias("error_message"),
    ).cast(RESULT_TYPE)


def verdict_rows(flows: DataFrame, result: Column) -> DataFrame:
    return flows.select(*FLOW_ID_COLUMNS, result.alias("result"))


def unreadable(columns: list[str]) -> Column:
    """What is wrong with a flow's numbers; null where each is present and not negative."""
    checks = []
    for c in columns:
        checks += [F.when(F.col(c).isNull(), f"{c} is missing"), F.when(F.col(c) < 0, f"{c} is negative")]
    return F.coalesce(*checks)


def error_rows(flows: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """Verdict rows with status ``error``, one for each detector that cannot judge a flow.

    ``needs`` names the columns that each detector computes with. The flows are read once,
    and the filter on their numbers reaches the scan, so clean files are skipped.
    """
    every = sorted({c for columns in needs.values() for c in columns})
    broken = F.lit(False)
    for c in every:
        broken = broken | F.col(c).isNull() | (F.col(c) < 0)
    entries = F.array(*[
        F.struct(F.lit(name).alias("detector"), unreadable(columns).alias("message"))
        for name, columns in needs.items()
    ])
    found = flows.filter(broken).select(*FLOW_ID_COLUMNS, F.inline(F.filter(entries, lambda e: e["message"].isNotNull())))
    return found.select(
        *FLOW_ID_COLUMNS, "detector",
        F.struct(
            F.col("detector"), F.lit("error").alias("status"), F.lit(None).alias("threat_type"), F.lit(None).alias("severity"),
            F.lit(None).alias("confidence"), F.lit(None).alias("score"), F.lit(None).alias("evidence"),
            F.col("message").alias("error_message"),
        ).cast(RESULT_TYPE).alias("result"),
    )


def status_rows(flows: DataFrame, verdicts: DataFrame, detector: str) -> DataFrame:
    """One result per flow window of ``flows``, NOT_DETECTED where the detector is silent."""
    silent = verdict(detector, "NOT_DETECTED")
    return (
        flows.select(*FLOW_ID_COLUMNS)
        .join(verdicts, FLOW_ID_COLUMNS, "left")
        .withColumn("result", F.coalesce("result", silent))
    )
