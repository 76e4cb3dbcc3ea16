"""Command-channel beaconing: small, regular packets kept up over many windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import MICROS, BeaconConfig
from netloom.functions.columns import joined_reasons, seconds
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.history import trailing_windows

NAME = "C2BeaconingDetector"


def beacon_history(flows: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    """Flow rows with their active windows and time span in the trailing history.

    Endpoints are fixed per flow id, so infrastructure flows leave before the history.
    """
    return trailing_windows(
        flows.filter(~is_infrastructure(cfg)).select(
            "stream_id", "window_end_us", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port",
            "packet_count", "byte_count", "iat_count", "iat_mean", "iat_std",
        ),
        round(cfg.history_s * MICROS),
    )


def is_infrastructure(cfg: BeaconConfig) -> Column:
    ports, ips = list(cfg.infra_ports), list(cfg.infra_ips)
    return (
        F.col("src_port").isin(ports) | F.col("dst_port").isin(ports)
        | F.col("src_ip").isin(ips) | F.col("dst_ip").isin(ips)
    )


def beacon_scores(seen: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    """Rows of ``beacon_history`` that pass every gate, with ``cv`` and ``confidence``."""
    cv = F.when((F.col("iat_count") >= 2) & (F.col("iat_mean") > 0), F.col("iat_std") / F.col("iat_mean"))
    seen = seen.withColumns({"cv": cv, "observation_span": seconds(F.col("observed_us"))})
    passing = seen.filter(
        ~is_infrastructure(cfg)
        & (F.col("cv") <= cfg.max_cv)
        & (F.col("windows_seen") >= cfg.min_windows)
        & (F.col("observation_span") >= cfg.min_span_s)
        & (F.col("byte_count") / F.col("packet_count") < cfg.max_mean_packet)
        & (F.col("packet_count") >= cfg.min_packets)
    )
    regular = 1.0 - F.col("cv") / cfg.max_cv
    sustained = F.least(F.lit(1.0), (F.col("windows_seen") - cfg.min_windows) / 20.0)
    volume = F.least(F.lit(1.0), (F.col("packet_count") - cfg.min_packets) / 50.0)
    return passing.withColumn("confidence", 0.5 * regular + 0.35 * sustained + 0.15 * volume)


def detect_beacon(flows: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    return judge_beacon(beacon_history(flows, cfg), cfg)


def judge_beacon(seen: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    rows = beacon_scores(seen, cfg).filter(F.col("confidence") >= cfg.min_confidence)
    reason = joined_reasons(
        F.format_string("Highly regular timing (CV=%.3f)", "cv"),
        F.format_string("Sustained over %d windows (%.1fs)", "windows_seen", "observation_span"),
        F.format_string("Non-infrastructure port (%d)", "dst_port"),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, "DETECTED", "C2_BEACONING", "HIGH",
            confidence=F.col("confidence"),
            evidence=evidence(
                periodicity_cv=F.col("cv"),
                windows_seen=F.col("windows_seen"),
                observation_span=F.col("observation_span"),
                packet_count=F.col("packet_count"),
                dst_ip=F.col("dst_ip"),
                dst_port=F.col("dst_port"),
                reason=reason,
            ),
        ),
    )
