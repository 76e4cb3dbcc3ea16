"""Where windows end: late packets, gaps, and the per-stream window grid.

Rules that the results must follow, for packets in arrival order (``seq``):

* a packet older than the running maximum time by more than the window is dropped;
* window ends are ``anchor + k * slide`` (k >= 1) up to the newest packet's time;
* the first packet's time is the anchor; when a packet is more than two windows
  past the last emitted end, the grid starts again at that packet's time - window.

A running maximum over a whole stream would put the stream into one task. Instead a
map-side combined profile per (stream, time bucket) proves, for almost every bucket,
that no packet in it can be late or start a new grid. Only buckets without that proof
are looked at packet by packet. The profile and the grid grow with the stream's
duration, not with its packets; running values over the profile are computed in time blocks
(``operators/scan.py``), and gaps are resolved by composing functions of time blocks
(``operators/anchors.py``), so a stream of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.functions.columns import int_floor_div
from netloom.operators.anchors import restarts
from netloom.operators.scan import before_blocks, running, with_halo
from netloom.session import materialize

#: Longest array that one step of a numbered range makes.
RANGE = 4096


def _buckets_per_window(cfg: WindowConfig) -> int:
    return 4 if cfg.window_us % 4 == 0 else 1


def _bucket_us(cfg: WindowConfig) -> int:
    return cfg.window_us // _buckets_per_window(cfg)


def time_profile(packets: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Per (stream, time bucket): first/last arrival number and time bounds."""
    bucket = int_floor_div("ts_us", _bucket_us(cfg)).alias("bucket")
    return (
        packets.select("stream_id", "seq", "ts_us", bucket)
        .groupBy("stream_id", "bucket")
        .agg(
            F.min("seq").alias("min_seq"),
            F.max("seq").alias("max_seq"),
            F.min_by("ts_us", "seq").alias("first_us"),
            F.max("ts_us").alias("max_us"),
            F.count("*").alias("n"),
        )
    )


def _is_crowded(profile: DataFrame, cfg: WindowConfig) -> bool:
    """Whether any window length of time holds so many packets that one flow may need splitting."""
    window = int_floor_div("bucket", _buckets_per_window(cfg))
    limit = cfg.split_packets // (cfg.chunk_windows + 2)
    return not profile.groupBy("stream_id", window).agg(F.sum("n").alias("n")).filter(F.col("n") > limit).isEmpty()


def _first_arrival_from(profile: DataFrame, rows: DataFrame, ahead: int, name: str) -> DataFrame:
    """``rows`` (of the profile) with the smallest arrival number of buckets ``ahead`` or more later."""
    newest_first = profile.select("stream_id", (-F.col("bucket")).alias("pos"), F.col("min_seq").alias("value"))
    asked = rows.withColumn("pos", -F.col("bucket") - ahead)
    return running(newest_first, asked, ["stream_id"], "min").drop("pos").withColumnRenamed("found", name)


def _suspect_buckets(profile: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Buckets where an arrival much later in time precedes one of their packets."""
    q = _buckets_per_window(cfg)
    may = _first_arrival_from(profile, profile.select("stream_id", "bucket", "max_seq"), q, "may")
    return may.filter(F.col("max_seq") > F.col("may")).select("stream_id", "bucket")


def drop_late(packets: DataFrame, cfg: WindowConfig, profile: DataFrame | None = None) -> DataFrame:
    """Drop packets older than the running maximum time by more than the window."""
    if profile is None:
        profile = materialize(time_profile(packets, cfg), "profile")
    q, width = _buckets_per_window(cfg), _bucket_us(cfg)
    suspects = materialize(_suspect_buckets(profile, cfg), "suspects")
    if suspects.isEmpty():
        return packets
    suspects = materialize(_first_arrival_from(profile, suspects, q + 1, "late_after"), "suspects")
    # The only times not settled by the profile lie exactly one window ahead.
    ahead = suspects.select("stream_id", (F.col("bucket") + q).alias("bucket"))
    rivals = (
        packets.select("stream_id", "seq", "ts_us", int_floor_div("ts_us", width).alias("bucket"))
        .join(ahead, ["stream_id", "bucket"], "left_semi")
        .select("stream_id", "bucket", "seq", F.col("ts_us").alias("rival_us"))
    )
    is_suspect = packets.select(
        "stream_id", "seq", "ts_us", int_floor_div("ts_us", width).alias("bucket")
    ).join(suspects, ["stream_id", "bucket"])
    in_question = is_suspect.select(
        "stream_id",
        (F.col("bucket") + q).alias("bucket"),
        "seq",
        F.lit(None).cast("bigint").alias("rival_us"),
        "ts_us",
        "late_after",
    )
    arrivals = Window.partitionBy("stream_id", "bucket").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    late = (
        in_question.unionByName(rivals, allowMissingColumns=True)
        .withColumn("newest", F.max("rival_us").over(arrivals))
        .filter(F.col("ts_us").isNotNull())
        .filter(
            F.coalesce(F.col("seq") > F.col("late_after"), F.lit(False))
            | F.coalesce(F.col("newest") > F.col("ts_us") + cfg.window_us, F.lit(False))
        )
        .select("stream_id", "seq")
    )
    return packets.join(materialize(late, "late"), ["stream_id", "seq"], "left_anti").select(
        *packets.columns
    )


def _gap_candidates(packets: DataFrame, profile: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Arrivals that may start a new grid: (stream_id, seq, ts_us, before_us).

    ``before_us`` is the newest time among earlier arrivals. A bucket's first arrival
    is the only packet of the bucket that can qualify. Buckets a window or more back
    hold earlier arrivals only (later ones would have been late).
    """
    q = _buckets_per_window(cfg)
    by_time = Window.partitionBy("stream_id", "block").orderBy("bucket")
    reach = 2 * cfg.window_us - cfg.slide_us
    rows = with_halo(profile, "bucket", q + 1).withColumns(
        {
            "near": F.collect_list(F.struct("bucket", "min_seq", "max_seq", "first_us", "max_us")).over(by_time.rangeBetween(-q, -1)),
            "ahead_seq": F.min("min_seq").over(by_time.rangeBetween(1, q + 1)),
        }
    ).filter("own").drop("own", "block")
    # An arrival that follows one from a later bucket does not advance the time.
    rows = rows.filter(F.coalesce(F.col("ahead_seq") > F.col("min_seq"), F.lit(True)))
    earlier = F.filter("near", lambda b: b["min_seq"] < F.col("min_seq"))
    known = F.transform(
        earlier,
        lambda b: F.when(b["max_seq"] < F.col("min_seq"), b["max_us"]).otherwise(b["first_us"]),
    )
    # Few buckets come long enough after their neighbours; only those ask for what was before.
    newest_near = F.array_max(known)
    rows = rows.filter(F.coalesce(F.col("first_us") - newest_near > reach, F.lit(True)))
    times = profile.select("stream_id", F.col("bucket").alias("pos"), F.col("max_us").alias("value"))
    rows = running(times, rows.withColumn("pos", F.col("bucket") - (q + 1)), ["stream_id"], "max").drop("pos")
    rows = rows.withColumn("before_us", F.greatest("found", newest_near)).drop("found")
    rows = rows.filter(F.col("first_us") - F.col("before_us") > reach)
    if _bucket_us(cfg) <= cfg.window_us - cfg.slide_us:
        return rows.select("stream_id", F.col("min_seq").alias("seq"), F.col("first_us").alias("ts_us"), "before_us")
    # With a slide close to the window, a near bucket may straddle the arrival:
    # look up its newest packet before the arrival.
    rows = materialize(
        rows.withColumn("mixed", F.filter(earlier, lambda b: b["max_seq"] > F.col("min_seq"))), "gaps"
    )
    straddling = rows.select(
        "stream_id", F.col("min_seq").alias("gap_seq"), F.explode("mixed.bucket").alias("bucket")
    )
    newest = (
        packets.select("stream_id", "seq", "ts_us", int_floor_div("ts_us", _bucket_us(cfg)).alias("bucket"))
        .join(straddling, ["stream_id", "bucket"])
        .filter(F.col("seq") < F.col("gap_seq"))
        .groupBy("stream_id", F.col("gap_seq").alias("min_seq"))
        .agg(F.max("ts_us").alias("mixed_us"))
    )
    return (
        rows.join(newest, ["stream_id", "min_seq"], "left")
        .withColumn("before_us", F.greatest("before_us", "mixed_us"))
        .filter(F.col("first_us") - F.col("before_us") > reach)
        .select("stream_id", F.col("min_seq").alias("seq"), F.col("first_us").alias("ts_us"), "before_us")
    )


def grid_segments(packets: DataFrame, cfg: WindowConfig, profile: DataFrame | None = None) -> DataFrame:
    """Grid segments per stream: ``(stream_id, segment, anchor_us, last_us)``.

    ``packets`` are on-time packets. ``last_us`` is the newest time in the segment.
    """
    if profile is None:
        profile = materialize(time_profile(packets, cfg), "profile")
    span = profile.groupBy("stream_id").agg(
        F.min_by("first_us", "min_seq").alias("anchor_us"), F.max("max_us").alias("last_us")
    )
    gaps = materialize(_gap_candidates(packets, profile, cfg).select("stream_id", "ts_us", "before_us"), "gap-candidates")
    if gaps.isEmpty():
        return span.select("stream_id", F.lit(0).cast("bigint").alias("segment"), "anchor_us", "last_us")
    span = materialize(span, "spans")
    closed, last = restarts(gaps, span.select("stream_id", "anchor_us"), cfg)
    counts = closed.groupBy("stream_id", "block").agg(F.count("*").alias("total"))
    numbered = closed.join(before_blocks(counts, ["stream_id"], "sum"), ["stream_id", "block"]).select(
        "stream_id", (F.col("before") + F.col("place")).cast("bigint").alias("segment"), "anchor_us", "last_us"
    )
    made = counts.groupBy("stream_id").agg(F.sum("total").alias("made"))
    final = (
        span.join(last.withColumnRenamed("anchor_us", "entry_us"), "stream_id", "left").join(made, "stream_id", "left")
        .select(
            "stream_id", F.coalesce("made", F.lit(0)).cast("bigint").alias("segment"),
            F.coalesce("entry_us", "anchor_us").alias("anchor_us"), "last_us",
        )
    )
    return numbered.unionByName(final)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """One row per whole number ``_lo.._hi``, called ``name``; no array is longer than ``RANGE``."""
    blocks = rows.withColumn(
        "_block", F.explode(F.sequence(int_floor_div("_lo", RANGE), int_floor_div("_hi", RANGE)))
    )
    within = F.sequence(
        F.greatest("_lo", F.col("_block") * RANGE), F.least("_hi", F.col("_block") * RANGE + (RANGE - 1))
    )
    return blocks.withColumn(name, F.explode(within)).drop("_lo", "_hi", "_block")


def segment_index(segments: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Segments per (stream, time cell) with the times they hold, so that packets find
    theirs with an equi-join. A cell is one window wide, and segments start more than a
    window after the one before ends, so a cell meets two of them at most."""
    # A slide longer than the window leaves out times right after the anchor.
    skipped = max(0, cfg.slide_us - cfg.window_us)
    bounded = segments.select(
        "stream_id", "anchor_us", "last_us",
        F.when(F.col("segment") > 0, F.col("anchor_us") + skipped)
        .otherwise(F.col("anchor_us") - cfg.window_us)
        .alias("from_us"),
    )
    cells = {"_lo": int_floor_div("from_us", cfg.window_us), "_hi": int_floor_div("last_us", cfg.window_us)}
    return _numbered(bounded.withColumns(cells).filter(F.col("_lo") <= F.col("_hi")), "cell")


def on_grid(packets: DataFrame, cfg: WindowConfig, anchor_us: int | None = None) -> DataFrame:
    """On-time packets with ``anchor_us`` and ``last_us`` of their grid segment.

    With a fixed ``anchor_us`` (as a stream needs) no gap restarts the grid. Packets that
    already have a grid are returned as they are. Where packets are dense, a column
    ``crowded`` says that flows have to be looked at for their number of packets.
    """
    if {"anchor_us", "last_us"} <= set(packets.columns):
        return packets
    profile = materialize(time_profile(packets, cfg), "profile")
    kept = drop_late(packets, cfg, profile)
    if kept is not packets:
        profile = materialize(time_profile(kept, cfg), "profile")
    columns = {c: F.col(c) for c in packets.columns}
    if _is_crowded(profile, cfg):
        columns["crowded"] = F.lit(True)
    if anchor_us is not None:
        segments = profile.groupBy("stream_id").agg(F.max("max_us").alias("last_us")).select(
            "stream_id", F.lit(anchor_us).cast("bigint").alias("anchor_us"), "last_us"
        )
        gridded = kept.join(materialize(segments, "grid"), "stream_id")
        return gridded.select(*(c.alias(n) for n, c in columns.items()), "anchor_us", "last_us")
    index = materialize(segment_index(grid_segments(kept, cfg, profile), cfg), "grid")
    return (
        kept.withColumn("cell", int_floor_div("ts_us", cfg.window_us))
        .join(index, ["stream_id", "cell"])
        .filter(F.col("ts_us").between(F.col("from_us"), F.col("last_us")))
        .select(*(c.alias(n) for n, c in columns.items()), "anchor_us", "last_us")
    )


def window_ends(segments: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Every emitted window end, also of windows without packets."""
    slides = {"_lo": F.lit(1).cast("bigint"), "_hi": int_floor_div("last_us - anchor_us", cfg.slide_us)}
    return _numbered(segments.withColumns(slides).filter(F.col("_hi") >= 1), "_k").select(
        "stream_id", (F.col("anchor_us") + F.col("_k") * cfg.slide_us).alias("window_end_us")
    )
