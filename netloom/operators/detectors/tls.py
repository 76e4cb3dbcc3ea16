"""Suspicious TLS: a ClientHello without a server name, kept up over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import MICROS, TlsConfig
from netloom.functions.columns import joined_reasons
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.history import running_history

NAME = "EncryptedMalwareDetector"


def tls_history(flows: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    """TCP flow rows to the TLS port, with what the flow has shown so far."""
    rows = flows.filter((F.col("protocol") == "TCP") & (F.col("dst_port") == cfg.port)).select(
        "stream_id", "window_end_us", "flow_id", "fwd_byte_count", "rev_byte_count",
        F.col("tls_client_hello").cast("int").alias("hello"),
        F.col("tls_has_sni").cast("int").alias("sni"),
        F.lit(1).cast("bigint").alias("one"),
    )
    return running_history(
        rows,
        ["stream_id", "flow_id"],
        {
            "windows_seen": ("sum", "one"),
            "hello_seen": ("max", "hello"),
            "sni_seen": ("max", "sni"),
            "fwd_max": ("max", "fwd_byte_count"),
            "rev_max": ("max", "rev_byte_count"),
        },
        round(cfg.idle_s * MICROS),
    )


def detect_tls(flows: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    return judge_tls(tls_history(flows, cfg), cfg)


def judge_tls(seen: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    rows = seen.filter(
        (F.col("hello_seen") == 1) & (F.col("sni_seen") == 0) & (F.col("windows_seen") >= cfg.min_windows)
    )
    reason = joined_reasons(
        F.lit("Missing SNI in TLS ClientHello"),
        F.format_string("Suspicious TLS behavior (%d windows)", "windows_seen"),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, "DETECTED", "ENCRYPTED_MALWARE", "HIGH",
            confidence=F.lit(cfg.confidence),
            evidence=evidence(
                tls_sni_present=F.lit(False),
                windows_seen=F.col("windows_seen"),
                total_bytes=F.col("fwd_max") + F.col("rev_max"),
                reason=reason,
            ),
        ),
    )
