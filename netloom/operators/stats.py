"""Traffic statistics over packets, flows and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import MICROS, int_floor_div
from netloom.operators.ordering import order_statistics
from netloom.operators.prepare import protocol_label, with_time_us
from netloom.session import materialize


def capture_stats(packets: DataFrame) -> DataFrame:
    """Per stream: packets, first and last packet's time, packets/s (null at no duration)."""
    out = with_time_us(packets).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.min_by("ts_us", "seq").alias("first_us"),
        F.max_by("ts_us", "seq").alias("last_us"),
    )
    span = (F.col("last_us") - F.col("first_us")) / MICROS
    return out.withColumn("packets_per_sec", F.when(span > 0, F.col("packets") / span))


def protocol_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("stream_id", protocol_label(F.col("protocol")).alias("protocol")).agg(
        F.count(F.lit(1)).alias("packets")
    )


def traffic_bins(packets: DataFrame, bin_s: float = 10.0) -> DataFrame:
    """IPv4 traffic per bin from the stream's first IPv4 packet.

    Packet numbers count from 1 over all packets of the capture, IP or not.
    """
    rows = with_time_us(packets).filter(
        F.col("src_ip").isNotNull() & ~F.coalesce(F.col("src_ip").contains(":"), F.lit(False))
    )
    start = rows.groupBy("stream_id").agg(F.min_by("ts_us", "seq").alias("t0"))
    # Written first, so that its size decides between broadcast and shuffle.
    rows = rows.join(materialize(start, "starts"), "stream_id")
    query = F.coalesce(F.col("dns_query_name") != "", F.lit(False)) if "dns_query_name" in packets.columns else F.lit(False)
    return rows.groupBy(
        "stream_id", F.expr(f"(ts_us - t0) div {round(bin_s * MICROS)}L").alias("bin")
    ).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("length").alias("bytes"),
        F.count_distinct("src_ip").alias("unique_src_ips"),
        F.count_distinct("dst_ip").alias("unique_dst_ips"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp"),
        F.count_if(F.col("protocol") == "UDP").alias("udp"),
        F.count_if(query).alias("dns"),
        (F.min("seq") + 1).alias("first_packet"),
        (F.max("seq") + 1).alias("last_packet"),
    )


# The count that ranks bins for each threat.
RANK_BY = {"DDoS": "packets", "DNS_DGA_TUNNEL": "dns", "C2_BEACONING": "tcp", "ENCRYPTED_MALWARE": "tcp"}


def top_bins(bins: DataFrame, threat: str, n: int = 3) -> DataFrame:
    """The ``n`` busiest bins for a threat; the earlier bin wins a tie."""
    return bins.orderBy(F.col(RANK_BY[threat]).desc(), "bin", "stream_id").limit(n)


def peak_rates(totals: DataFrame) -> DataFrame:
    return totals.groupBy("stream_id").agg(
        F.max("total_packets").alias("peak_packets"), F.max("flow_count").alias("peak_flows")
    )


def host_rollup(flows: DataFrame) -> DataFrame:
    """Per (window, host): volume sent as initiator plus received replies, first protocol."""
    sides = F.array(
        F.struct(
            F.col("src_ip").alias("ip"),
            (F.col("fwd_byte_count") + F.col("fwd_packet_count")).alias("volume"),
            F.lit(0).alias("side"),
        ),
        F.struct(
            F.col("dst_ip").alias("ip"),
            (F.col("rev_byte_count") + F.col("rev_packet_count")).alias("volume"),
            F.lit(1).alias("side"),
        ),
    )
    rows = flows.select("stream_id", "window_end_us", "protocol", "first_seq", F.explode(sides).alias("s")).select(
        "stream_id", "window_end_us", "protocol", "s.ip", "s.volume", F.struct("first_seq", "s.side").alias("at")
    )
    return (
        rows.groupBy("stream_id", "window_end_us", "ip")
        .agg(F.min_by("protocol", "at").alias("protocol"), F.sum("volume").alias("volume"), F.min("at").alias("at"))
        .select(
            "stream_id", "window_end_us", "ip", "protocol", "volume",
            F.col("at.first_seq").alias("first_seq"), F.col("at.side").alias("side"),
        )
    )


def first_hosts(hosts: DataFrame, n: int = 30, by: str = "first_seen") -> DataFrame:
    """Per window, ``n`` hosts in order of appearance (or by ``volume``)."""
    order = ["first_seq", "side"] if by == "first_seen" else [F.col("volume").desc(), F.col("ip")]
    rank = F.row_number().over(Window.partitionBy("stream_id", "window_end_us").orderBy(*order))
    return hosts.withColumn("rank", rank).filter(F.col("rank") <= n)


def window_metrics(totals: DataFrame, hosts: DataFrame, window_s: float) -> DataFrame:
    """Live metrics per window, from the window's true byte count."""
    host_counts = hosts.groupBy("stream_id", "window_end_us").agg(F.count(F.lit(1)).alias("hosts"))
    return totals.join(host_counts, ["stream_id", "window_end_us"], "left").select(
        "stream_id", "window_end_us",
        (F.col("total_packets") / window_s).alias("packets_per_second"),
        (F.col("total_bytes") / window_s).alias("bytes_per_second"),
        F.coalesce("hosts", F.lit(0)).alias("hosts"),
        F.col("flow_count").alias("active_flows"),
    )


def latency_percentiles(latencies: DataFrame, value: str = "latency_us") -> DataFrame:
    """p50 and p95 as elements of the sorted values, without interpolation."""
    return order_statistics(latencies, value, {"p50": 0.5, "p95": 0.95})


def run_counters(fused: DataFrame) -> DataFrame:
    """Windows with results, results, errors and detections of a run."""
    return fused.agg(
        F.count_distinct("stream_id", "window_end_us").alias("windows_completed"),
        F.count_if(F.col("status") != "error").alias("detections_generated"),
        F.count_if(F.col("status") == "error").alias("processing_errors"),
        F.count_if(F.col("status") == "DETECTED").alias("alerts"),
    )
