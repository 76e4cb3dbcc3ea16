"""Bidirectional flows per closed sliding window.

``build_flows`` shuffles each packet once (plus a one-window overlap per chunk) on
(stream, grid, chunk of windows, flow key). Everything after that reuses the same
partitioning: packets collapse into runs (consecutive packets of one flow in one
pane), runs are copied to the windows that contain their pane, and runs of a window
combine into its flow rows. A flow of any length is spread over many chunks. Where the
time profile shows that packets are dense, flows are counted per chunk first, and those of
more than ``split_packets`` packets are collapsed into runs in blocks of arrivals: a run cut
at a block border is two runs with an exact gap between them, so nothing else changes. Only
the runs of such flows are shuffled a second time.

A window is a set of whole panes, and every window's packets are a sequence of whole
runs in arrival order, so inter-arrival statistics are exact whatever the disorder.
Window edges are closed on both sides: instants on a pane boundary are panes of their
own and belong to the windows on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.functions.columns import flow_id, int_floor_div, seconds
from netloom.operators.grid import on_grid
from netloom.operators.prepare import FLOW_KEY, flow_eligible, with_flow_key, with_time_us
from netloom.session import materialize

FLOW_COLUMNS = [
    "stream_id", "window_start_us", "window_end_us", "flow_id",
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "first_seq", "first_seen_us", "last_seen_us",
    "packet_count", "byte_count",
    "fwd_packet_count", "rev_packet_count", "fwd_byte_count", "rev_byte_count",
    "iat_count", "iat_mean", "iat_std",
    "dns_query_count", "tls_client_hello", "tls_has_sni",
]


def window_span(cfg: WindowConfig) -> tuple[Column, Column]:
    """First and last window number that contain a packet, within what was emitted."""
    rel = "ts_us - anchor_us"
    first = F.greatest(-int_floor_div(f"-({rel})", cfg.slide_us), F.lit(1).cast("bigint"))
    last = F.least(
        int_floor_div(f"{rel} + {cfg.window_us}L", cfg.slide_us),
        int_floor_div("last_us - anchor_us", cfg.slide_us),
    )
    return first, last


def _optional(packets: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in packets.columns else F.lit(None).cast(kind)


def _gridded(packets: DataFrame, cfg: WindowConfig, anchor_us: int | None) -> DataFrame:
    # The grid follows every packet, also those that cannot belong to a flow.
    return with_flow_key(flow_eligible(on_grid(with_time_us(packets), cfg, anchor_us)))


def _iat(prev: Column, now: Column) -> Column:
    """Gap to the previous packet; null when there is none or time went back."""
    return F.when((prev > 0) & (now >= prev), now - prev)


def _flow_row(group: DataFrame, keys: list[str], cfg: WindowConfig) -> DataFrame:
    """Final flow columns from per-window sums (``group`` has one row per flow)."""
    fwd = F.col("first_a_to_b")
    n, s1, s2 = F.col("iat_count"), F.col("iat_sum").cast("double"), F.col("iat_sq")
    variance = F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))

    def pick(ab: str, ba: str) -> Column:
        return F.when(fwd, F.col(ab)).otherwise(F.col(ba))

    rev_packets = F.col("packet_count") - F.col("packets_ab")
    rev_bytes = F.col("byte_count") - F.col("bytes_ab")
    out = group.select(
        *keys,
        "window_end_us",
        (F.col("window_end_us") - cfg.window_us).alias("window_start_us"),
        pick("ip_a", "ip_b").alias("src_ip"),
        pick("ip_b", "ip_a").alias("dst_ip"),
        pick("port_a", "port_b").alias("src_port"),
        pick("port_b", "port_a").alias("dst_port"),
        "first_seq", "first_seen_us", "last_seen_us", "packet_count", "byte_count",
        F.when(fwd, F.col("packets_ab")).otherwise(rev_packets).alias("fwd_packet_count"),
        F.when(fwd, rev_packets).otherwise(F.col("packets_ab")).alias("rev_packet_count"),
        F.when(fwd, F.col("bytes_ab")).otherwise(rev_bytes).alias("fwd_byte_count"),
        F.when(fwd, rev_bytes).otherwise(F.col("bytes_ab")).alias("rev_byte_count"),
        "iat_count",
        F.when(n > 0, s1 / n / 1e6).otherwise(F.lit(0.0)).alias("iat_mean"),
        F.when(n > 1, F.sqrt(variance) / 1e6).alias("iat_std"),
        "dns_query_count", "tls_client_hello", "tls_has_sni",
    )
    return out.withColumn(
        "flow_id",
        flow_id(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]),
    )


def build_flows(packets: DataFrame, cfg: WindowConfig, anchor_us: int | None = None) -> DataFrame:
    """One row per (stream, window, flow) over all packets in ``[end - window, end]``."""
    gridded = _gridded(packets, cfg, anchor_us)
    base, part = _chunked(gridded, cfg), ["stream_id", "anchor_us", "chunk", *FLOW_KEY]
    if "crowded" in gridded.columns:
        counts = base.groupBy(*part).agg(F.count("*").alias("packets"))
        hot = materialize(counts.filter(F.col("packets") > cfg.split_packets).drop("packets"), "hot-flows")
        if not hot.isEmpty():
            block = int_floor_div("seq", cfg.split_packets).alias("seq_block")
            busy = base.join(hot, part, "left_semi").select("*", block)
            calm = base.join(hot, part, "left_anti")
            return _flows_of(calm, part, [], cfg).unionByName(_flows_of(busy, part, ["seq_block"], cfg))
    return _flows_of(base, part, [], cfg)


def _chunked(gridded: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Packets with their pane and span of windows, once for each chunk of windows they lie in."""
    pane_us = cfg.pane_us
    first, last = window_span(cfg)
    hello = F.coalesce(_optional(gridded, "tls_is_client_hello", "boolean"), F.lit(False))
    has_query = F.coalesce(_optional(gridded, "dns_query_name", "string") != "", F.lit(False))
    has_sni = hello & F.coalesce(_optional(gridded, "tls_sni", "string") != "", F.lit(False))
    rel = "(ts_us - anchor_us)"
    # Even panes are boundary instants, odd panes the open stretches between them.
    pane = 2 * int_floor_div(rel, pane_us) + F.when(
        F.pmod(F.expr(rel), F.lit(pane_us)) == 0, 0
    ).otherwise(1)
    size = cfg.chunk_slides
    return (
        gridded.withColumns({"k_first": first, "k_last": last})
        .select(
            "stream_id", "anchor_us", *FLOW_KEY, "seq", "ts_us", "a_to_b",
            F.col("length").cast("bigint").alias("length"),
            pane.cast("bigint").alias("pane"), "k_first", "k_last",
            has_query.alias("has_query"), hello.alias("hello"), has_sni.alias("has_sni"),
            # An outer explode keeps the condition out of the scan's filter, where every
            # input expression would be repeated.
            F.explode_outer(
                F.when(
                    F.col("k_first") <= F.col("k_last"),
                    F.sequence(int_floor_div("k_first", size), int_floor_div("k_last", size)),
                )
            ).alias("chunk"),
        )
        .filter(F.col("chunk").isNotNull())
    )


def _flows_of(base: DataFrame, part: list[str], blocks: list[str], cfg: WindowConfig) -> DataFrame:
    """Flow rows of chunked packets; runs are made within ``part`` and ``blocks`` of arrivals."""
    size = cfg.chunk_slides
    arrivals = Window.partitionBy(*part, *blocks).orderBy("seq")
    packets_in_order = base.withColumns(
        {"prev_us": F.lag("ts_us").over(arrivals), "prev_pane": F.lag("pane").over(arrivals)}
    ).withColumn("starts", F.coalesce(F.col("pane") != F.col("prev_pane"), F.lit(True)))
    packets_in_order = packets_in_order.withColumns(
        {
            "run": F.sum(F.col("starts").cast("bigint")).over(
                arrivals.rowsBetween(Window.unboundedPreceding, 0)
            ),
            "iat": F.when(~F.col("starts"), _iat(F.col("prev_us"), F.col("ts_us"))),
        }
    )
    ones, starts = F.lit(1).cast("bigint"), F.col("starts")

    def count_where(cond: Column) -> Column:
        return F.sum(F.when(cond, ones).otherwise(F.lit(0).cast("bigint")))

    runs = packets_in_order.groupBy(*part, *blocks, "run", "pane", "k_first", "k_last").agg(
        F.count(ones).alias("n"),
        F.sum("length").alias("bytes"),
        count_where(F.col("a_to_b")).alias("n_ab"),
        F.sum(F.when(F.col("a_to_b"), F.col("length")).otherwise(0)).alias("b_ab"),
        F.min("seq").alias("seq"),
        F.max(F.when(starts, F.col("a_to_b"))).alias("dir"),
        F.max(F.when(starts, F.col("ts_us"))).alias("head_us"),
        F.max_by("ts_us", "seq").alias("tail_us"),
        F.min("ts_us").alias("min_us"),
        F.max("ts_us").alias("max_us"),
        F.count("iat").alias("iat_n"),
        F.sum("iat").alias("iat_s"),
        F.sum(F.col("iat").cast("double") * F.col("iat")).alias("iat_q"),
        count_where(F.col("has_query")).alias("queries"),
        count_where(F.col("has_query") & ~starts).alias("queries_rest"),
        F.max("hello").alias("hello"),
        F.max(F.col("hello") & ~starts).alias("hello_rest"),
        F.max("has_sni").alias("sni"),
        F.max(F.col("has_sni") & ~starts).alias("sni_rest"),
    )
    lo = F.greatest(F.col("k_first"), F.col("chunk") * size)
    hi = F.least(F.col("k_last"), F.col("chunk") * size + (size - 1))
    in_window = runs.withColumn("k", F.explode(F.sequence(lo, hi)))
    order = Window.partitionBy(*part, "k").orderBy("seq")
    in_window = in_window.withColumn("prev_tail", F.lag("tail_us").over(order)).withColumns(
        {
            # The first packet of a window's flow opens it and leaves no metadata.
            "opens": F.col("prev_tail").isNull(),
            "joint": _iat(F.col("prev_tail"), F.col("head_us")),
        }
    )
    opens = F.col("opens")

    def rest(name: str) -> Column:
        return F.when(opens, F.col(f"{name}_rest")).otherwise(F.col(name))

    group = in_window.groupBy(*part, "k").agg(
        F.sum("n").alias("packet_count"),
        F.sum("bytes").alias("byte_count"),
        F.sum("n_ab").alias("packets_ab"),
        F.sum("b_ab").alias("bytes_ab"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(opens, F.col("dir"))).alias("first_a_to_b"),
        F.min("min_us").alias("first_seen_us"),
        F.max("max_us").alias("last_seen_us"),
        (F.sum("iat_n") + F.count("joint")).alias("iat_count"),
        (F.coalesce(F.sum("iat_s"), F.lit(0)) + F.coalesce(F.sum("joint"), F.lit(0))).alias("iat_sum"),
        (
            F.coalesce(F.sum("iat_q"), F.lit(0.0))
            + F.coalesce(F.sum(F.col("joint").cast("double") * F.col("joint")), F.lit(0.0))
        ).alias("iat_sq"),
        F.sum(rest("queries")).alias("dns_query_count"),
        F.max(rest("hello")).alias("tls_client_hello"),
        F.max(rest("sni")).alias("tls_has_sni"),
    )
    group = group.withColumn("window_end_us", F.col("anchor_us") + F.col("k") * cfg.slide_us)
    return _flow_row(group, ["stream_id", "protocol"], cfg).select(*FLOW_COLUMNS)


def window_packets(
    packets: DataFrame,
    cfg: WindowConfig,
    membership: str = "event_time",
    anchor_us: int | None = None,
) -> DataFrame:
    """Flow-eligible packets copied to every window that contains them.

    ``event_time`` takes all packets in ``[end - window, end]``. ``arrival_exact`` also
    asks that the packet did not arrive after the one whose time closed the window, so
    late packets and ties on a window end miss windows that were already closed.
    """
    if membership not in ("event_time", "arrival_exact"):
        raise ValueError(f"unknown membership: {membership}")
    gridded = on_grid(with_time_us(packets), cfg, anchor_us)
    copies = _copies(with_flow_key(flow_eligible(gridded)), cfg)
    if membership == "event_time":
        return copies
    closers = closing_packets(gridded, cfg)
    return copies.join(closers, ["stream_id", "window_end_us"]).filter(
        F.col("seq") <= F.col("closed_by_seq")
    ).drop("closed_by_seq")


def _copies(gridded: DataFrame, cfg: WindowConfig) -> DataFrame:
    first, last = window_span(cfg)
    return (
        gridded.withColumns({"_k1": first, "_k2": last})
        .withColumn("_k", F.explode_outer(F.when(F.col("_k1") <= F.col("_k2"), F.sequence("_k1", "_k2"))))
        .filter(F.col("_k").isNotNull())
        .withColumn("window_end_us", F.col("anchor_us") + F.col("_k") * cfg.slide_us)
        .drop("_k", "_k1", "_k2")
    )


def closing_packets(gridded: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Arrival number of the packet that closed each window.

    That packet is less than two windows past the end, so only panes that near count.
    """
    slide = cfg.slide_us
    heads = gridded.groupBy(
        "stream_id", "anchor_us", "last_us", int_floor_div("ts_us - anchor_us", slide).alias("_step")
    ).agg(F.min("seq").alias("seq"))
    reach = 2 * cfg.window_us // slide + 1
    return (
        heads.withColumns(
            {
                "_lo": F.greatest(F.lit(1).cast("bigint"), F.col("_step") - reach),
                "_hi": F.least(F.col("_step"), int_floor_div("last_us - anchor_us", slide)),
            }
        )
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        .groupBy("stream_id", (F.col("anchor_us") + F.col("_k") * slide).alias("window_end_us"))
        .agg(F.min("seq").alias("closed_by_seq"))
    )


def flows_from_window_packets(copies: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Flow rows from packets already copied to windows (any membership rule)."""
    hello = F.coalesce(_optional(copies, "tls_is_client_hello", "boolean"), F.lit(False))
    has_query = F.coalesce(_optional(copies, "dns_query_name", "string") != "", F.lit(False))
    has_sni = hello & F.coalesce(_optional(copies, "tls_sni", "string") != "", F.lit(False))
    keys = ["stream_id", "window_end_us", *FLOW_KEY]
    order = Window.partitionBy(*keys).orderBy("seq")
    prev = F.lag("ts_us").over(order)
    rows = copies.select(
        *keys, "seq", "ts_us", "length", "a_to_b",
        prev.isNull().alias("opens"), _iat(prev, F.col("ts_us")).alias("iat"),
        has_query.alias("has_query"), hello.alias("hello"), has_sni.alias("has_sni"),
    )
    later = ~F.col("opens")
    group = rows.groupBy(*keys).agg(
        F.count("seq").alias("packet_count"),
        F.sum("length").alias("byte_count"),
        F.count_if("a_to_b").alias("packets_ab"),
        F.sum(F.when(F.col("a_to_b"), F.col("length")).otherwise(0)).alias("bytes_ab"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(F.col("opens"), F.col("a_to_b"))).alias("first_a_to_b"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.count("iat").alias("iat_count"),
        F.coalesce(F.sum("iat"), F.lit(0)).alias("iat_sum"),
        F.coalesce(F.sum(F.col("iat").cast("double") * F.col("iat")), F.lit(0.0)).alias("iat_sq"),
        F.count_if(F.col("has_query") & later).alias("dns_query_count"),
        F.max(F.col("hello") & later).alias("tls_client_hello"),
        F.max(F.col("has_sni") & later).alias("tls_has_sni"),
    )
    return _flow_row(group, ["stream_id", "protocol"], cfg).select(*FLOW_COLUMNS)


def snapshot(packets: DataFrame, cfg: WindowConfig, end_us: int) -> DataFrame:
    """Flows of one window ending at ``end_us``, on demand."""
    rows = with_time_us(packets).filter(
        F.col("ts_us").between(max(0, end_us - cfg.window_us), end_us)
    )
    copies = with_flow_key(flow_eligible(rows)).withColumn("window_end_us", F.lit(end_us).cast("bigint"))
    return flows_from_window_packets(copies, cfg)


def window_totals(flows: DataFrame) -> DataFrame:
    """Packets, bytes and flows per window."""
    return flows.groupBy("stream_id", "window_start_us", "window_end_us").agg(
        F.sum("packet_count").alias("total_packets"),
        F.sum("byte_count").alias("total_bytes"),
        F.count(F.lit(1)).alias("flow_count"),
    )


def with_empty_windows(totals: DataFrame, ends: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Totals of every emitted window; windows without packets get zeros."""
    out = ends.withColumn("window_start_us", F.col("window_end_us") - cfg.window_us).join(
        totals.drop("window_start_us"), ["stream_id", "window_end_us"], "left"
    )
    return out.fillna(0, ["total_packets", "total_bytes", "flow_count"])


def dns_queries(packets: DataFrame, flows: DataFrame, cfg: WindowConfig, anchor_us: int | None = None) -> DataFrame:
    """One row per DNS query of a window's flow, leaving out the flow's first packet."""
    named = _metadata_packets(packets, flows, cfg, F.col("dns_query_name") != "", anchor_us)
    return named.select(
        "stream_id", "window_end_us", "flow_id", "src_ip", "dst_ip", "first_seq", "seq",
        F.col("dns_query_name").alias("name"), F.col("dns_query_type").alias("type"),
    )


def _metadata_packets(packets, flows, cfg, cond, anchor_us) -> DataFrame:
    for name, kind in (("dns_query_type", "int"), ("tls_version", "int"),
                       ("tls_cipher_suites_count", "int"), ("tls_extensions_count", "int")):
        if name not in packets.columns:
            packets = packets.withColumn(name, F.lit(None).cast(kind))
    kept = _gridded(packets, cfg, anchor_us).filter(cond)
    copies = _copies(kept, cfg).drop("src_ip", "dst_ip", "src_port", "dst_port")
    keyed = with_flow_key(
        flows.select(
            "stream_id", "window_end_us", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port",
            "protocol", "first_seq",
        )
    ).drop("a_to_b")
    return copies.join(keyed, ["stream_id", "window_end_us", *FLOW_KEY]).filter(
        F.col("seq") > F.col("first_seq")
    )


def tls_details(packets: DataFrame, flows: DataFrame, cfg: WindowConfig, anchor_us: int | None = None) -> DataFrame:
    """Last non-empty ClientHello fields per window's flow, first packet left out."""
    hellos = _metadata_packets(
        packets, flows.filter("tls_client_hello"), cfg, F.col("tls_is_client_hello"), anchor_us
    )

    def last_set(name: str, empty) -> Column:
        present = F.when(F.col(name) != F.lit(empty), F.struct("seq", name))
        return F.max(present)[name].alias(name)

    return hellos.groupBy("stream_id", "window_end_us", "flow_id").agg(
        F.lit(True).alias("tls_client_hello"),
        last_set("tls_sni", ""),
        last_set("tls_version", 0),
        last_set("tls_cipher_suites_count", 0),
        last_set("tls_extensions_count", 0),
    )
