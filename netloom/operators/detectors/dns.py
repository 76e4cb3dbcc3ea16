"""DNS tunnelling and generated domains: many random-looking names per host pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import MICROS, DnsConfig
from netloom.functions.columns import char_entropy, joined_reasons
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.history import pair_history, running_history
from netloom.session import materialize

NAME = "DNSTunnelDetector"
_PAIR = ["stream_id", "src_ip", "dst_ip"]


def query_history(flows: DataFrame, queries: DataFrame, cfg: DnsConfig = DnsConfig()) -> DataFrame:
    """DNS flow rows with the pair's distinct names so far and sums over those names.

    ``queries`` has one row per query of a window's flow (``flows.dns_queries``). A name
    counts once per session of its host pair, at its first use.
    """
    dns = flows.filter(
        (F.col("protocol") == "UDP") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
    ).select("stream_id", "window_end_us", "flow_id", "src_ip", "dst_ip", "first_seq")
    sessions = running_history(
        dns.select(*_PAIR, "window_end_us").distinct(), _PAIR, {}, round(cfg.idle_s * MICROS)
    )
    sessions = materialize(sessions, "dns-sessions")
    at = F.struct("window_end_us", "first_seq")
    firsts = (
        queries.join(sessions, [*_PAIR, "window_end_us"])
        .groupBy(*_PAIR, "session_start", "name")
        .agg(F.min(at).alias("at"))
        .withColumn("entropy", char_entropy(F.col("name")))
    )
    added = firsts.groupBy(
        *_PAIR, "session_start", F.col("at.window_end_us").alias("window_end_us"),
        F.col("at.first_seq").alias("first_seq"),
    ).agg(
        F.count(F.lit(1)).alias("new_names"),
        F.sum("entropy").alias("new_entropy"),
        F.sum(F.length("name")).alias("new_length"),
        F.count_if(F.col("entropy") > cfg.min_entropy).alias("new_high"),
    )
    rows = (
        dns.join(sessions, [*_PAIR, "window_end_us"])
        .join(added, [*_PAIR, "session_start", "window_end_us", "first_seq"], "left")
        .fillna(0, ["new_names", "new_length", "new_high"])
        .fillna(0.0, ["new_entropy"])
        .withColumnRenamed("session_start", "pair_session")
    )
    return pair_history(
        materialize(rows, "dns-rows"),
        {
            "names": ("sum", "new_names"),
            "entropy_sum": ("sum", "new_entropy"),
            "length_sum": ("sum", "new_length"),
            "high_names": ("sum", "new_high"),
        },
        None,
        keys=[*_PAIR, "pair_session"],
    )


def detect_dns(flows: DataFrame, queries: DataFrame, cfg: DnsConfig = DnsConfig()) -> DataFrame:
    return judge_dns(query_history(flows, queries, cfg), cfg)


def judge_dns(seen: DataFrame, cfg: DnsConfig = DnsConfig()) -> DataFrame:
    """DETECTED rows, and INSUFFICIENT_DATA rows for pairs with too few names so far."""
    seen = seen.withColumns(
        {
            "mean_entropy": F.try_divide("entropy_sum", "names"),
            "mean_length": F.try_divide("length_sum", "names"),
            "high_share": F.try_divide("high_names", "names"),
        }
    )
    entropic = F.col("mean_entropy") >= cfg.min_entropy
    mostly_high = F.col("high_share") >= cfg.min_high_share
    long = F.col("mean_length") >= cfg.min_mean_length
    seen = seen.withColumn("signals", sum((c.cast("int") for c in (mostly_high, long)), entropic.cast("int")))
    enough = F.col("names") >= cfg.min_queries
    rows = seen.withColumn(
        "status",
        F.when(~enough, "INSUFFICIENT_DATA").when(F.col("signals") >= cfg.min_signals, "DETECTED"),
    ).filter(F.col("status").isNotNull())
    reason = joined_reasons(
        F.when(entropic, F.format_string("High average domain entropy (%.2f)", "mean_entropy")),
        F.when(
            mostly_high,
            F.format_string("High ratio of high-entropy domains (%d/%d)", "high_names", "names"),
        ),
        F.when(long, F.format_string("Abnormal average domain length (%.1f chars)", "mean_length")),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, F.col("status"), "DNS_DGA_TUNNEL", "HIGH",
            score=F.least(F.lit(1.0), F.col("signals") / F.lit(3.0)),
            evidence=evidence(
                unique_queries_across_windows=F.col("names"),
                domain_entropy_avg=F.col("mean_entropy"),
                domain_length_avg=F.col("mean_length"),
                high_entropy_queries=F.col("high_names"),
                reason=reason,
            ),
        ),
    )
