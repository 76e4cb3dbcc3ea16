"""Alert rows and what is reported from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import first_truthy, ipv4_in

# Keys an alert must have, severity weights of the level meter.
REQUIRED_KEYS = ["flow_id", "timestamp", "threat_class", "confidence", "evidence"]
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
OTHER_WEIGHT = 0.1


def to_alerts(fused: DataFrame, provenance: str | None = None) -> DataFrame:
    """DETECTED results as alerts, with defaults for what a detector leaves open."""
    no_evidence = F.create_map().cast("map<string,string>")
    out = fused.filter(F.col("status") == "DETECTED").select(
        "stream_id",
        "flow_id",
        F.col("window_end_us").alias("timestamp"),
        F.coalesce(F.when(F.col("threat_type") != "", F.col("threat_type")), F.lit("BENIGN")).alias("threat_class"),
        F.coalesce("confidence", "score", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.when(F.col("severity") != "", F.col("severity")), F.lit("LOW")).alias("severity"),
        F.coalesce("evidence", no_evidence).alias("evidence"),
    )
    return out.withColumn("provenance", F.lit(provenance)) if provenance else out


def live_alerts(fused: DataFrame) -> DataFrame:
    """What a live feed sends: every result that is neither an error nor benign.

    ``confidence`` falls back to the score, so scan and DNS alerts carry a number.
    """
    return fused.filter(
        (F.col("status") != "error") & F.col("threat_type").isNotNull() & (F.col("threat_type") != "BENIGN")
    ).select(
        "stream_id", "flow_id", F.col("window_end_us").alias("timestamp"),
        F.col("threat_type").alias("threat_class"),
        F.coalesce("confidence", "score").alias("confidence"),
        "evidence", "severity", "fusion_reason", "all_detector_results",
    )


def detection_responses(fused: DataFrame, source: str = "REAL_PCAP") -> DataFrame:
    """All results of any status, as returned to a caller that submitted packets."""
    return fused.select(
        "stream_id", "flow_id", F.col("window_end_us").alias("timestamp"), "status", "threat_type",
        "severity", "confidence", "score", "detector_name",
        F.lit(source).alias("validation_source"), "evidence", "error_message",
    )


def alerts_json(alerts: DataFrame) -> DataFrame:
    """Alerts as one JSON text per row."""
    return alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value"))


def schema_check(alerts: DataFrame) -> DataFrame:
    """One row: alerts, alerts that lack a required key, alerts with an odd confidence."""
    present = [k for k in REQUIRED_KEYS if k in alerts.columns]
    missing = F.lit(len(present) < len(REQUIRED_KEYS))
    for k in present:
        missing = missing | F.col(k).isNull()
    confidence = F.col("confidence") if "confidence" in present else F.lit(None).cast("double")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(missing).alias("missing_keys"),
        F.count_if(~confidence.between(0.0, 1.0)).alias("confidence_out_of_range"),
    )


def dedup_alerts(fused: DataFrame) -> DataFrame:
    """One row per (flow, threat): windows it fired in, and its first evidence."""
    fired = fused.filter(F.col("status") == "DETECTED")
    first = F.struct("evidence", "severity", "confidence", "score")
    return (
        fired.groupBy("stream_id", "flow_id", "threat_type")
        .agg(F.count(F.lit(1)).alias("count"), F.min_by(first, "window_end_us").alias("first"))
        .select(
            "stream_id", "flow_id", "threat_type", "count", "first.evidence", "first.severity",
            first_truthy(F.col("first.confidence"), F.col("first.score")).alias("confidence"),
        )
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per threat class with one sample, the earliest."""
    at = F.struct("timestamp", "flow_id")
    return alerts.groupBy("threat_class").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("flow_id", at).alias("sample_flow_id")
    )


def newest_alerts(alerts: DataFrame, n: int = 1000) -> DataFrame:
    return alerts.orderBy(F.col("timestamp").desc(), "stream_id", "flow_id").limit(n)


def is_high(severity: Column, confidence: Column) -> Column:
    return severity.isin("HIGH", "CRITICAL") | F.coalesce(confidence >= 0.9, F.lit(False))


def severity_summary(alerts: DataFrame) -> DataFrame:
    """All alerts, those of high severity, and those high by severity or confidence."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_severity"),
        F.count_if(is_high(F.col("severity"), F.col("confidence"))).alias("high_alerts"),
    )


def with_model_flag(live: DataFrame) -> DataFrame:
    """Flag alerts whose flood detector fired with a confidence."""
    return live.withColumn(
        "ml_assisted",
        F.exists(
            "all_detector_results",
            lambda r: (r["detector"] == "DDoSDetector") & (r["status"] == "DETECTED")
            & r["confidence"].isNotNull(),
        ),
    )


def threat_levels(alerts: DataFrame, now_us: Column | int, span_s: float = 15.0) -> DataFrame:
    """Level per threat class: worst recent severity, fading to zero over ``span_s``."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    age = (now - F.col("timestamp")).cast("double") / 1e6
    weight = F.lit(OTHER_WEIGHT)
    for name, w in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == name, F.lit(w)).otherwise(weight)
    return (
        alerts.withColumns({"age": age, "weight": weight})
        .filter(F.col("age") < span_s)
        .groupBy(F.upper("threat_class").alias("threat_class"))
        .agg(
            (F.max("weight") * F.greatest(F.lit(0.0), 1.0 - F.min("age") / span_s)).alias("level")
        )
    )


def threat_level_of(alerts: DataFrame, names: list[str], now_us: int, span_s: float = 15.0) -> DataFrame:
    """Levels for meter names; a name stands for every class that contains it."""
    levels = threat_levels(alerts, now_us, span_s)
    wanted = F.explode(
        F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.col("threat_class").contains(F.upper(n)))
    )
    return (
        levels.withColumn("meter", wanted).groupBy("meter").agg(F.max("level").alias("level"))
    )


def alerted_ips(alerts: DataFrame) -> DataFrame:
    return alerts.select("stream_id", F.explode(ipv4_in(F.col("flow_id"))).alias("ip")).distinct()


def flag_alerted_hosts(hosts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Hosts with ``alerted``: whether their address is part of an alert's flow."""
    marked = alerted_ips(alerts).withColumn("_hit", F.lit(True))
    return (
        hosts.join(marked, ["stream_id", "ip"], "left")
        .withColumn("alerted", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def metric_history(metrics: DataFrame, value: str, keep: int = 100, floor: float = 100.0) -> DataFrame:
    """Running scale of a live metric: max of the last ``keep`` values and ``floor``.

    Values are ordered per stream by window end; blocks of windows with a ``keep``-sized
    run-up keep each task's share bounded.
    """
    step = F.col("window_no")
    block = ((step - F.pmod(step, F.lit(10 * keep))) / (10 * keep)).cast("bigint")
    next_block = F.when(F.pmod(step, F.lit(10 * keep)) >= 9 * keep, F.array(block, block + 1))
    rows = metrics.withColumn("_home", block).withColumn(
        "_block", F.explode(F.coalesce(next_block, F.array(block)))
    )
    last = Window.partitionBy("stream_id", "_block").orderBy("window_no").rangeBetween(-(keep - 1), 0)
    return (
        rows.withColumn("scale", F.greatest(F.lit(floor), F.max(value).over(last)))
        .filter(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )
