"""Running values and window grids computed in blocks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.operators import anchors, scan
from netloom.operators.grid import _suspect_buckets, drop_late, grid_segments, time_profile
from tests import brute
from tests.helpers import frame, packet


@pytest.mark.parametrize("op", ["min", "max", "sum"])
@pytest.mark.parametrize("bits", [12, 1])
def test_running_values(spark, op, bits, monkeypatch):
    monkeypatch.setattr(scan, "BITS", bits)
    rng = random.Random(1)
    values = [(k, rng.randint(-40, 40) * rng.choice([1, 1000]), rng.randint(-9, 9)) for k in "ab" for _ in range(60)]
    asked = [(k, rng.randint(-50, 50) * rng.choice([1, 1000]), i) for k in "abc" for i in range(40)]
    found = scan.running(
        spark.createDataFrame(values, "k string, pos bigint, value bigint"),
        spark.createDataFrame(asked, "k string, pos bigint, id int"), ["k"], op,
    )
    fold = {"min": min, "max": max, "sum": sum}[op]
    got = {(r.k, r.id): r.found for r in found.collect()}
    for k, pos, i in asked:
        own = [v for key, p, v in values if key == k and p <= pos]
        want = fold(own) if own else (0 if op == "sum" else None)
        assert got[k, i] == want, (k, pos)


def folded(times, before, anchor, window, slide):
    out = []
    for ts, newest in zip(times, before):
        if ts > anchor + (newest - anchor) // slide * slide + 2 * window:
            out.append((anchor, newest))
            anchor = ts - window
    return out, anchor


def random_gaps(rng, n, window, slide):
    """Gaps of which only some are longer than two windows."""
    now, times, before = rng.randint(0, 1000), [], []
    for _ in range(n):
        newest = now + rng.randint(0, 2 * window)
        now = newest + rng.randint(2 * window - slide + 1, 2 * window if rng.random() < 0.97 else 5 * window)
        times.append(now)
        before.append(newest)
    return times, before


@pytest.mark.parametrize("window,slide", [(10, 7), (50, 1), (40, 40), (30, 51), (1000, 999)])
def test_transfer_functions(window, slide):
    rng = random.Random(window)
    for _ in range(60):
        times, before = random_gaps(rng, rng.randint(0, 60), window, slide)
        cut = rng.randint(0, len(times))
        whole = anchors.gaps_transfer(times, before, window, slide)
        parts = [anchors.gaps_transfer(times[a:b], before[a:b], window, slide) for a, b in ((0, cut), (cut, len(times)))]
        joined = anchors.composed(*parts, slide)
        assert whole.lo == sorted(set(whole.lo)) and len(whole.lo) <= slide
        for _ in range(30):
            anchor = rng.randint(-2000, (before or [0])[0])
            want = folded(times, before, anchor, window, slide)[1]
            assert whole.after(anchor, slide) == want and joined.after(anchor, slide) == want


@pytest.mark.parametrize("span,fan", [(1024, 1024), (2, 3)])
def test_segments_of_many_gaps(spark, span, fan, monkeypatch):
    monkeypatch.setattr(anchors, "SPAN", span)
    monkeypatch.setattr(anchors, "FAN", fan)
    monkeypatch.setattr(scan, "BITS", 3)
    cfg = WindowConfig(2, 1.5)
    rng, rows, want = random.Random(5), [], []
    for s in range(4):
        t, seq, mine = 100.0, 0, []
        for _ in range(300 if s else 2):
            for _ in range(rng.randint(1, 3)):
                mine.append(packet(seq, t, stream=f"s{s}"))
                seq += 1
                t += rng.choice([0, 0.25, 0.5])
            t += rng.choice([2.75, 3, 3.25, 3.5, 3.75, 4, 4, 9])
        rows += mine
        segments, anchor, newest, end = [], mine[0]["ts_us"], mine[0]["ts_us"], mine[0]["ts_us"]
        for p in mine:
            ts = p["ts_us"]
            if ts > end + 2 * cfg.window_us:
                segments.append((anchor, newest))
                anchor = end = ts - cfg.window_us
            while ts >= end + cfg.slide_us:
                end += cfg.slide_us
            newest = max(newest, ts)
        segments.append((anchor, newest))
        want += [(f"s{s}", i, a, e) for i, (a, e) in enumerate(segments)]
    got = sorted(map(tuple, grid_segments(frame(spark, rows), cfg).select("stream_id", "segment", "anchor_us", "last_us").collect()))
    assert len(want) > 200 and got == want


@pytest.mark.parametrize("bits", [12, 2])
def test_late_packets_over_block_borders(spark, bits, monkeypatch):
    monkeypatch.setattr(scan, "BITS", bits)
    cfg, rng = WindowConfig(2, 1), random.Random(7)
    rows, t = [], 50.0
    for seq in range(600):
        t += rng.choice([0, 0.25, 0.5, 3])
        rows.append(packet(seq, t - (rng.choice([0.5, 2, 2.25, 6, 40]) if rng.random() < 0.3 else 0)))
    packets = frame(spark, rows)
    assert _suspect_buckets(time_profile(packets, cfg), cfg).count() > 10
    want = {p["seq"] for p in brute.accepted(rows, cfg.window_us)}
    assert {r.seq for r in drop_late(packets, cfg).select("seq").collect()} == want


def test_no_window_over_a_whole_stream(spark):
    """A long stream of many gaps is spread: its gaps lie in many blocks, none of them large."""
    cfg = WindowConfig(10, 1)
    packets = spark.range(40_000).select(
        F.lit("s").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") * 19_500_000).alias("ts_us")
    )
    segments = grid_segments(packets, cfg)
    found = segments.agg(F.count("*").alias("n"), F.max("segment").alias("last"), F.countDistinct("segment").alias("d")).first()
    times = list(range(19_500_000, 40_000 * 19_500_000, 19_500_000))
    closed, _ = folded(times, [t - 19_500_000 for t in times], 0, cfg.window_us, cfg.slide_us)
    assert (found.n, found.last, found.d) == (len(closed) + 1, len(closed), len(closed) + 1)
