"""Per-flow features and the host context they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.columns import byte_ratio, seconds, unidirectional
from netloom.schema import FEATURES_13, FEATURES_16


def source_fanout(flows: DataFrame, approximate: bool = False) -> DataFrame:
    """Per (window, source): flows, distinct destinations, distinct destination ports."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return flows.groupBy("stream_id", "window_end_us", "src_ip").agg(
        F.count(F.lit(1)).alias("flow_count"),
        distinct("dst_ip").alias("unique_dst_ips"),
        distinct("dst_port").alias("unique_dst_ports"),
    )


def destination_load(flows: DataFrame) -> DataFrame:
    """Per (window, destination): flows, packets, distinct sources."""
    return flows.groupBy("stream_id", "window_end_us", "dst_ip").agg(
        F.count(F.lit(1)).alias("flows_to_dst"),
        F.sum("packet_count").alias("packets_to_dst"),
        F.count_distinct("src_ip").alias("unique_src_count"),
    )


def with_source_fanout(flows: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    stats = source_fanout(flows) if stats is None else stats
    return flows.join(stats, ["stream_id", "window_end_us", "src_ip"])


def duration_s() -> Column:
    return seconds(F.col("last_seen_us") - F.col("first_seen_us"))


def rate(amount: str) -> Column:
    """Amount per second of the flow; 0.0 when the flow has no duration."""
    span = duration_s()
    return F.when(span > 0, F.col(amount) / span).otherwise(F.lit(0.0))


def flow_features() -> dict[str, Column]:
    """The features that depend on the flow alone, in model order."""
    fwd, rev = F.col("fwd_byte_count"), F.col("rev_byte_count")
    made = {
        "flow_duration": duration_s(),
        "fwd_packet_count": F.col("fwd_packet_count").cast("double"),
        "rev_packet_count": F.col("rev_packet_count").cast("double"),
        "fwd_byte_count": fwd.cast("double"),
        "rev_byte_count": rev.cast("double"),
        "fwd_bytes_per_sec": rate("fwd_byte_count"),
        "rev_bytes_per_sec": rate("rev_byte_count"),
        "fwd_pkts_per_sec": rate("fwd_packet_count"),
        "rev_pkts_per_sec": rate("rev_packet_count"),
        "byte_ratio": byte_ratio(fwd, rev),
        "is_unidirectional": unidirectional(fwd, rev),
        "is_tcp": (F.col("protocol") == "TCP").cast("double"),
        "is_udp": (F.col("protocol") == "UDP").cast("double"),
    }
    return {name: made[name] for name in FEATURES_13}


FLOW_ID_COLUMNS = ["stream_id", "window_end_us", "flow_id"]


def features13(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The model's 13 inputs per flow; needs no join."""
    keep = FLOW_ID_COLUMNS if keep is None else keep
    return flows.select(*keep, *[c.alias(n) for n, c in flow_features().items()])


def features16(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All 16 features per flow: its own 13 plus the source's fan-out in the window."""
    keep = FLOW_ID_COLUMNS if keep is None else keep
    made = flow_features() | {
        "src_ip_flow_count": F.col("flow_count").cast("double"),
        "src_ip_unique_dst_ips": F.col("unique_dst_ips").cast("double"),
        "src_ip_unique_dst_ports": F.col("unique_dst_ports").cast("double"),
    }
    return with_source_fanout(flows).select(*keep, *[made[n].alias(n) for n in FEATURES_16])


def to_model_input(features: DataFrame) -> DataFrame:
    """Reduce a feature table to the model's 13 inputs; a missing column or value is an error."""
    absent = [n for n in FEATURES_13 if n not in features.columns]
    if absent:
        raise ValueError(f"required feature missing: {', '.join(absent)}")

    def required(name: str) -> Column:
        problem = F.raise_error(F.lit(f"feature '{name}' is null")).cast("double")
        return F.when(F.col(name).isNull(), problem).otherwise(F.col(name).cast("double")).alias(name)

    ids = [c for c in features.columns if c not in FEATURES_16]
    return features.select(*ids, *[required(n) for n in FEATURES_13])


def native_dataset(flows: DataFrame, label: int, min_packets: int = 3) -> DataFrame:
    """Training rows from captured flows: 13 features and a label per flow window."""
    kept = flows.filter(F.col("packet_count") >= min_packets)
    return features13(kept).withColumn("label", F.lit(label))
