"""Packet filters and projections that run before windowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.columns import flow_id
from netloom.session import materialize

# Addresses dropped at ingestion. Link-local and multicast, IPv4 and IPv6.
OUT_OF_SCOPE = r"^(169\.254\.|224\.|239\.|(?=[^:]*:)([fF][eE][89aAbB]|[fF][fF]))"
# The same with all of 224.0.0.0/4.
OUT_OF_SCOPE_ALL = r"^(169\.254\.|22[4-9]\.|23\d\.|(?=[^:]*:)([fF][eE][89aAbB]|[fF][fF]))"
V4_BROADCAST = "255.255.255.255"

FLOW_KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]


def in_scope(src: Column, dst: Column, all_multicast: bool = False) -> Column:
    """True for unicast addresses that are not link-local."""
    pattern = OUT_OF_SCOPE_ALL if all_multicast else OUT_OF_SCOPE
    return ~(src.rlike(pattern) | dst.rlike(pattern) | (dst == V4_BROADCAST))


def scope_filter(packets: DataFrame, all_multicast: bool = False) -> DataFrame:
    """Keep IP packets with in-scope addresses; IPv6 text becomes lower case."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    kept = packets.filter(src.isNotNull() & dst.isNotNull() & in_scope(src, dst, all_multicast))
    return kept.withColumns(
        {
            c: F.when(F.col(c).contains(":"), F.lower(F.col(c))).otherwise(F.col(c))
            for c in ("src_ip", "dst_ip")
        }
    )


def validate_packets(raw: DataFrame) -> DataFrame:
    """Type a table of raw packet fields and add ``reject_reason`` (null = accepted)."""
    ts = F.col("timestamp").try_cast("double")
    length = F.col("length").try_cast("bigint")
    typed = raw.select(
        *[c for c in raw.columns if c not in ("timestamp", "length", "src_port", "dst_port")],
        ts.alias("timestamp"),
        length.alias("length"),
        *[F.col(p).try_cast("bigint").alias(p) for p in ("src_port", "dst_port")],
        *[
            (F.col(p).isNotNull() & F.col(p).try_cast("bigint").isNull()).alias(f"_{p}_bad")
            for p in ("src_port", "dst_port")
        ],
    )

    def port_problem(p: str) -> Column:
        bad = F.col(f"_{p}_bad") | ~F.col(p).between(0, 65535)
        return F.when(F.coalesce(bad, F.col(f"_{p}_bad")), F.lit(f"{p} out of range"))

    reason = F.coalesce(
        F.when(F.col("timestamp").isNull(), F.lit("timestamp missing")),
        F.when(F.col("length").isNull(), F.lit("length missing")),
        F.when(F.col("length") < 0, F.lit("length negative")),
        port_problem("src_port"),
        port_problem("dst_port"),
    )
    return typed.withColumn("reject_reason", reason).drop("_src_port_bad", "_dst_port_bad")


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows of ``validate_packets``."""
    checked = validate_packets(raw)
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.filter(F.col("reject_reason").isNotNull())


def in_flow() -> Column:
    """True for packets that can belong to a flow: full endpoints and TCP or UDP."""
    full = F.lit(True)
    for c in ("src_ip", "dst_ip", "src_port", "dst_port"):
        full = full & F.col(c).isNotNull()
    return full & F.col("protocol").isin("TCP", "UDP")


def flow_eligible(packets: DataFrame) -> DataFrame:
    return packets.filter(in_flow())


def with_time_us(packets: DataFrame) -> DataFrame:
    """Event time as whole microseconds; rows without a time are dropped."""
    if "ts_us" in packets.columns:
        return packets.filter(F.col("ts_us").isNotNull())
    return packets.withColumn("ts_us", F.unix_micros("ts")).filter(F.col("ts_us").isNotNull())


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Direction-free flow key plus ``a_to_b``, the packet's direction in that key."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.withColumns(
        {
            "ip_a": low["ip"],
            "port_a": low["port"],
            "ip_b": high["ip"],
            "port_b": high["port"],
            "a_to_b": src < dst,
        }
    )


def with_packet_flow_id(packets: DataFrame) -> DataFrame:
    return packets.withColumn(
        "flow_id",
        flow_id(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]),
    )


def protocol_label(protocol: Column) -> Column:
    return F.coalesce(F.when(protocol != "", protocol), F.lit("Other"))


def packet_range(packets: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Packets ``start <= seq < start + limit``; min/max statistics prune the scan."""
    out = packets.filter(F.col("seq") >= start)
    return out.filter(F.col("seq") < start + limit) if limit is not None else out


def replay(packets: DataFrame, loops: int) -> DataFrame:
    """Repeat each stream ``loops`` times, each copy later by the stream's span + 1 s."""
    packets = with_time_us(packets)
    span = packets.groupBy("stream_id").agg(
        (F.max("ts_us") - F.min("ts_us") + F.lit(1_000_000)).alias("_span"),
        (F.max("seq") - F.min("seq") + 1).alias("_count"),
    )
    copies = packets.withColumn("_loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    shifted = copies.join(materialize(span, "replay-span"), "stream_id")
    out = shifted.withColumns(
        {
            "ts_us": F.col("ts_us") + F.col("_loop") * F.col("_span"),
            "seq": F.col("seq") + F.col("_loop") * F.col("_count"),
        }
    ).drop("_loop", "_span", "_count")
    return out.withColumn("ts", F.timestamp_micros("ts_us")) if "ts" in packets.columns else out
