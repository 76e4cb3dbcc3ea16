"""Data exfiltration: a lasting, large and one-sided transfer to the outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import MICROS, ExfilConfig
from netloom.functions.columns import joined_reasons, starts_with_any
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.history import pair_history

NAME = "ExfiltrationDetector"


def outbound_history(flows: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    """Inside-to-outside flow rows with the host pair's largest flow and evaluations so far.

    A pair's direction is fixed, so other pairs can be left out before the history.
    """
    rows = flows.filter(goes_outside(cfg)).select(
        "stream_id", "window_end_us", "flow_id", "src_ip", "dst_ip", "first_seq",
        "fwd_byte_count", "rev_byte_count", F.lit(1).cast("bigint").alias("one"),
    )
    return pair_history(
        rows,
        {
            "fwd_max": ("max", "fwd_byte_count"),
            "rev_max": ("max", "rev_byte_count"),
            "windows_active": ("sum", "one"),
        },
        round(cfg.idle_s * MICROS),
    )


def goes_outside(cfg: ExfilConfig) -> Column:
    return starts_with_any(F.col("src_ip"), cfg.internal_prefixes) & ~starts_with_any(
        F.col("dst_ip"), cfg.internal_prefixes
    )


def detect_exfil(flows: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    return judge_exfil(outbound_history(flows, cfg), cfg)


def judge_exfil(seen: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    seen = seen.withColumn("ratio", F.col("fwd_max") / F.greatest(F.col("rev_max"), F.lit(1)))
    rows = seen.filter(
        (F.col("fwd_max") >= cfg.min_bytes)
        & (F.col("ratio") >= cfg.min_ratio)
        & (F.col("windows_active") >= cfg.min_windows)
    )
    reason = joined_reasons(
        F.format_string("High outbound volume (%d bytes)", "fwd_max"),
        F.format_string("Highly asymmetric transfer (Out/In ratio: %.1f)", "ratio"),
        F.format_string("Sustained transfer (%d windows)", "windows_active"),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, "DETECTED", "DATA_EXFILTRATION", "HIGH",
            confidence=F.least(F.lit(1.0), F.col("fwd_max") / F.lit(cfg.min_bytes) * 0.5 + 0.5),
            evidence=evidence(
                outbound_bytes=F.col("fwd_max"),
                inbound_bytes=F.col("rev_max"),
                outbound_inbound_ratio=F.col("ratio"),
                windows_active=F.col("windows_active"),
                reason=reason,
            ),
        ),
    )
