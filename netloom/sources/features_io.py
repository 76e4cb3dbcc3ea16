"""Feature tables and alert reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.columns import parse_double
from netloom.schema import FEATURES_13
from netloom.sources.tabular import read_text_table


def write_features(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """13 features and a label; CSV gets a header."""
    rows.select(*FEATURES_13, "label").write.mode("overwrite").option("header", True).format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read ``write_features`` output; blank features are 0.0, labels may read ``1.0``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = read_text_table(spark, path)
    label = "label" if "label" in raw.columns else "Label"
    return raw.select(
        *[F.coalesce(parse_double(F.col(c)), F.lit(0.0)).alias(c) for c in FEATURES_13],
        F.floor(parse_double(F.col(label))).cast("int").alias("label"),
    )


def run_header(source: str, packets: DataFrame, results: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row that describes a run: packets, results, alerts, and whether alerts are complete."""
    from netloom.operators.alerts import schema_check

    check = schema_check(alerts).select("total_alerts", (F.col("missing_keys") == 0).alias("schema_valid"))
    counted = packets.agg(F.count(F.lit(1)).alias("total_packets"))
    results = results.agg(F.count(F.lit(1)).alias("total_results"))
    # Three one-row tables side by side.
    key = F.lit(1).alias("_one")
    return (
        counted.select(F.lit(source).alias("source"), "*", key)
        .join(results.select("*", key), "_one")
        .join(check.select("*", key), "_one")
        .drop("_one")
    )


def write_report(alerts: DataFrame, header: DataFrame, path: str) -> None:
    """Alerts as JSON lines under ``alerts/``, the run's header under ``run/``."""
    alerts.write.mode("overwrite").json(f"{path}/alerts")
    header.coalesce(1).write.mode("overwrite").json(f"{path}/run")
