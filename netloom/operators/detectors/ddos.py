"""Volumetric flood: many flows or sources, or a burst, on one service of a host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import DdosConfig
from netloom.functions.columns import joined_reasons
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.features import destination_load, rate

NAME = "DDoSDetector"
_WINDOW_DST = ["stream_id", "window_end_us", "dst_ip"]


def signals(flows: DataFrame, cfg: DdosConfig = DdosConfig()) -> DataFrame:
    """Flow rows that can reach ``cfg.min_signals``, with the evidence columns.

    The packet rate is worth one signal, a busy destination two each. So unless one
    signal is enough, only flows to busy destinations matter, and idle destinations are
    dropped before the join.
    """
    busy_sources = (F.col("flows_to_dst") > cfg.flows_to_dst) | (
        F.col("unique_src_count") > cfg.sources_to_dst
    )
    bursting = (F.col("packets_to_dst") > cfg.burst_packets) & (
        F.col("flows_to_dst") > cfg.burst_min_flows
    )
    busy = destination_load(flows).withColumns({"concentrated": busy_sources, "burst": bursting})
    pps = rate("fwd_packet_count") + rate("rev_packet_count")
    service = F.col("dst_port") <= cfg.max_service_port
    if cfg.min_signals >= 2:
        busy = busy.filter(F.col("concentrated") | F.col("burst"))
        candidates = flows.filter(service).join(busy, _WINDOW_DST)
    else:
        candidates = flows.join(busy, _WINDOW_DST).withColumns(
            {c: F.col(c) & service for c in ("concentrated", "burst")}
        )

    def weight(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    return candidates.withColumns(
        {
            "packets_per_sec": pps,
            "bytes_per_sec": rate("fwd_byte_count") + rate("rev_byte_count"),
            "signals": weight(pps > cfg.high_rate_pps, 1)
            + weight(F.col("concentrated"), 2)
            + weight(F.col("burst"), 2),
        }
    )


def detect_ddos(
    flows: DataFrame,
    cfg: DdosConfig = DdosConfig(),
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Verdict rows for flows whose signals reach ``cfg.min_signals``.

    ``scorer`` adds a string column ``predicted_class`` to flow rows (see
    ``netloom.ml.score``). It sees one flow per flooded destination and window, the
    first in packet order, and its verdict holds for all flows to that destination.
    """
    rows = signals(flows, cfg)
    by_model = F.lit(False)
    if scorer is not None:
        firsts = rows.filter(F.col("signals") >= 2).groupBy(*_WINDOW_DST).agg(
            F.min_by(F.struct(*[F.col(c) for c in flows.columns if c not in _WINDOW_DST]), "first_seq").alias("flow")
        )
        scored = scorer(firsts.select(*_WINDOW_DST, "flow.*")).select(
            *_WINDOW_DST, F.upper("predicted_class").contains("DDOS").alias("model_says_ddos")
        )
        rows = rows.join(scored, _WINDOW_DST, "left")
        by_model = (F.col("signals") >= 2) & F.coalesce(F.col("model_says_ddos"), F.lit(False))
    rows = rows.withColumns(
        {"by_model": by_model, "signals": F.col("signals") + by_model.cast("int")}
    ).filter(F.col("signals") >= cfg.min_signals)
    reason = joined_reasons(
        F.when(
            F.col("packets_per_sec") > cfg.high_rate_pps,
            F.format_string("High traffic volume (%.2f pkts/sec)", "packets_per_sec"),
        ),
        F.when(
            F.col("concentrated"),
            F.format_string(
                "High flow concentration (%d flows, %d src IPs to %s)",
                "flows_to_dst", "unique_src_count", "dst_ip",
            ),
        ),
        F.when(
            F.col("burst"),
            F.format_string("Distributed burst traffic (%d total packets to %s)", "packets_to_dst", "dst_ip"),
        ),
        F.when(F.col("by_model"), F.lit("ML model predicted DDoS")),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, "DETECTED", "DDoS", "HIGH",
            confidence=F.least(F.lit(1.0), F.col("signals") / F.lit(3.0)),
            evidence=evidence(
                packets_per_sec=F.col("packets_per_sec"),
                bytes_per_sec=F.col("bytes_per_sec"),
                flows_to_dst=F.col("flows_to_dst"),
                reason=reason,
            ),
        ),
    )
