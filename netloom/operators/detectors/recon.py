"""Scanning: one source touching many ports of few hosts, or many hosts on few ports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import ReconConfig
from netloom.functions.columns import joined_reasons
from netloom.operators.detectors.base import evidence, verdict, verdict_rows
from netloom.operators.features import source_fanout

NAME = "ReconnaissanceDetector"


def scanning_sources(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """Sources that scan in a window; few rows whatever the traffic."""
    ports, ips = F.col("unique_dst_ports"), F.col("unique_dst_ips")
    fanout = source_fanout(flows).withColumns(
        {
            "port_scan": (ports >= cfg.port_fanout) & (ips <= cfg.max_ips_for_port_scan),
            "ip_scan": (ips >= cfg.ip_fanout) & (ports <= cfg.max_ports_for_ip_scan),
        }
    )
    return fanout.filter(F.col("port_scan") | F.col("ip_scan"))


def detect_recon(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    rows = flows.select("stream_id", "window_end_us", "src_ip", "flow_id").join(
        scanning_sources(flows, cfg), ["stream_id", "window_end_us", "src_ip"]
    )
    reason = joined_reasons(
        F.when(F.col("port_scan"), F.lit("high destination-port fan-out (port scan)")),
        F.when(F.col("ip_scan"), F.lit("high destination-ip fan-out (subnet scan)")),
    )
    return verdict_rows(
        rows,
        verdict(
            NAME, "DETECTED", "RECONNAISSANCE", "HIGH",
            score=F.lit(1.0),
            evidence=evidence(
                unique_destination_ports=F.col("unique_dst_ports"),
                unique_destination_ips=F.col("unique_dst_ips"),
                reason=reason,
            ),
        ),
    )
