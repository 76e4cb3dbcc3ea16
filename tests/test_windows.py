import random

import pytest
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.operators.flows import (
    build_flows, flows_from_window_packets, snapshot, window_packets, window_totals, with_empty_windows,
)
from netloom.operators.grid import drop_late, grid_segments, segment_index, window_ends
from netloom.operators.prepare import packet_range, replay, scope_filter, split_valid
from tests import brute
from tests.helpers import frame, packet

COMPARED = [
    "first_seq", "first_seen_us", "last_seen_us", "packet_count", "byte_count", "fwd_packet_count",
    "fwd_byte_count", "iat_count", "iat_mean", "iat_std", "dns_query_count", "tls_client_hello", "tls_has_sni",
]


def random_streams(n, seed, gap_scale):
    """Short streams with jitter, ties, late packets and pauses."""
    rng, rows = random.Random(seed), []
    hosts = ["10.0.0.1:1000", "10.0.0.2:53", "10.0.0.3:443", "10.0.0.1:1001"]
    for s in range(n):
        t = 1_000.0
        for seq in range(rng.randint(1, 40)):
            step = rng.choice([0, 0.25, 0.5, 1, 1, 2]) if rng.random() < 0.85 else rng.uniform(0, gap_scale)
            t += step
            shown = t - (rng.choice([0.25, 1, 3, 6, 9]) if rng.random() < 0.2 else 0)
            a, b = rng.sample(hosts, 2)
            rows.append(
                packet(
                    seq, shown, rng.randint(40, 1500), a, b, rng.choice(["TCP", "UDP", "UDP", "ICMP"]), f"s{s}",
                    dns_query_name=rng.choice([None, "", "a.example."]),
                    tls_is_client_hello=rng.random() < 0.3, tls_sni=rng.choice([None, "x"]),
                )
            )
    return rows


def by_stream(rows):
    out = {}
    for r in rows:
        out.setdefault(r["stream_id"], []).append(r)
    return out


def as_dict(df):
    def show(c, v):
        return round(v, 7) if c in ("iat_mean", "iat_std") and v is not None else v

    return {
        (r["stream_id"], r["window_end_us"], r["flow_id"]): {c: show(c, r[c]) for c in COMPARED} for r in df.collect()
    }


@pytest.mark.parametrize("window,slide,seed", [(4, 1, 1), (5, 2, 2), (3, 3, 3), (2, 0.75, 4), (4, 6, 5), (2, 3.5, 6)])
def test_windows_match_brute_force(spark, window, slide, seed):
    cfg = WindowConfig(window, slide, chunk_windows=1)
    rows = random_streams(150, seed, 5 * window)
    packets = frame(spark, rows).persist()
    ends, event, arrival = {}, {}, {}
    for name, ps in by_stream(rows).items():
        made = brute.windows(ps, cfg.window_us, cfg.slide_us)
        ends[name] = [e for e, _, _ in made]
        for e, known, whole in made:
            event.update({(name, e, f): v for f, v in brute.flows(whole).items()})
            arrival.update({(name, e, f): v for f, v in brute.flows(known).items()})
    kept = drop_late(packets, cfg)
    want = {(n, p["seq"]) for n, ps in by_stream(rows).items() for p in brute.accepted(ps, cfg.window_us)}
    assert {(r[0], r[1]) for r in kept.select("stream_id", "seq").collect()} == want
    got = {}
    for r in window_ends(grid_segments(kept, cfg), cfg).orderBy("window_end_us").collect():
        got.setdefault(r["stream_id"], []).append(r["window_end_us"])
    assert got == {k: v for k, v in ends.items() if v}
    assert as_dict(build_flows(packets, cfg)) == event
    exact = flows_from_window_packets(window_packets(packets, cfg, "arrival_exact"), cfg)
    assert as_dict(exact) == arrival
    packets.unpersist()


@pytest.mark.parametrize("window,slide,split", [(4, 1, 1), (4, 1, 3), (3, 3, 5), (2, 0.75, 2)])
def test_split_flows_match_brute_force(spark, window, slide, split):
    """Flows of more packets than ``split`` in a chunk are built in blocks of arrivals."""
    cfg = WindowConfig(window, slide, chunk_windows=3, split_packets=split)
    rows = random_streams(60, 10 + split, 2 * window)
    want = {
        (name, e, f): v for name, ps in by_stream(rows).items()
        for e, _, whole in brute.windows(ps, cfg.window_us, cfg.slide_us) for f, v in brute.flows(whole).items()
    }
    assert as_dict(build_flows(frame(spark, rows), cfg)) == want


def test_a_hot_flow_is_spread(spark):
    """All packets of one flow within one window: runs are made in many tasks, with one packet shuffle elsewhere."""
    cfg = WindowConfig(10, 10, split_packets=500)
    rows = [packet(i, 100 + i * 0.001, src="10.0.0.1:1000" if i % 3 else "10.0.0.9:9") for i in range(9000)]
    packets = frame(spark, [*rows, packet(9000, 110.0)])
    whole = as_dict(build_flows(packets, WindowConfig(10, 10)))
    assert as_dict(build_flows(packets, cfg)) == whole and len(whole) == 2
    plan = build_flows(packets, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("seq_block") > 0
    assert "seq_block" not in build_flows(packets, WindowConfig(10, 10))._jdf.queryExecution().optimizedPlan().toString()


def test_partition_count_does_not_matter(spark):
    cfg, rows = WindowConfig(4, 1), random_streams(40, 9, 10)
    spread = as_dict(build_flows(frame(spark, rows).repartition(7), cfg))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        single = as_dict(build_flows(frame(spark, rows).coalesce(1), cfg))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spread == single


def test_first_window_and_snapshot(spark):
    cfg = WindowConfig(5, 1)
    packets = frame(spark, [
        packet(0, 10.0, 100, "192.168.1.1:1000", "10.0.0.1:80"),
        packet(1, 10.5, 200, "10.0.0.1:80", "192.168.1.1:1000"),
        packet(2, 11.2, 150, "192.168.1.2:2000", "10.0.0.1:80"),
    ])
    rows = window_totals(build_flows(packets, cfg)).collect()
    assert [(r.window_start_us, r.window_end_us, r.total_packets, r.total_bytes, r.flow_count) for r in rows] == [
        (6_000_000, 11_000_000, 2, 300, 1)
    ]
    now = window_totals(snapshot(packets, cfg, 11_200_000)).first()
    assert (now.total_packets, now.total_bytes, now.flow_count) == (3, 450, 2)


def test_pause_restarts_grid_and_keeps_empty_windows(spark):
    cfg = WindowConfig(5, 1)
    packets = frame(spark, [packet(0, 10.0), packet(1, 110.0, src="10.0.0.9:3")])
    ends = window_ends(grid_segments(packets, cfg), cfg)
    rows = with_empty_windows(window_totals(build_flows(packets, cfg)), ends, cfg).orderBy("window_end_us").collect()
    assert [r.window_end_us // 1_000_000 for r in rows] == [106, 107, 108, 109, 110]
    assert [r.total_packets for r in rows] == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("window,pause", [(10, 25), (0.25, 1)])
def test_a_packet_meets_few_segments(spark, window, pause):
    cfg = WindowConfig(window, window / 10)
    packets = frame(spark, [packet(i, 10.0 + i // 3 * pause + i % 3 * window / 50) for i in range(1500)])
    segments = grid_segments(packets, cfg)
    assert segments.count() == 500
    cells = segment_index(segments, cfg).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 3


def test_many_window_ends(spark):
    cfg = WindowConfig(1, 0.001)
    segments = spark.createDataFrame([("s", 0, 5_000_000, 17_345_678)], "stream_id string, segment bigint, anchor_us bigint, last_us bigint")
    got = [r[0] for r in window_ends(segments, cfg).orderBy("window_end_us").select("window_end_us").collect()]
    assert got == list(range(5_001_000, 17_345_679, 1_000))


def test_tie_on_a_window_end(spark):
    cfg = WindowConfig(5, 1)
    packets = frame(spark, [packet(0, 10.0), packet(1, 11.0), packet(2, 11.0)])
    assert build_flows(packets, cfg).first().packet_count == 3
    assert flows_from_window_packets(window_packets(packets, cfg, "arrival_exact"), cfg).first().packet_count == 2


def test_window_settings_are_checked():
    for bad in [(0, 1), (1, 0), (-1, 1), (1, 2), (0.000005, 0.000006)]:
        with pytest.raises(ValueError):
            WindowConfig(*bad)


def test_scope_filter(spark):
    pairs = [
        ("10.0.0.1", "10.0.0.2", True), ("169.254.1.1", "10.0.0.2", False), ("10.0.0.1", "224.0.0.5", False),
        ("10.0.0.1", "225.0.0.5", True), ("10.0.0.1", "239.1.1.1", False), ("10.0.0.1", "255.255.255.255", False),
        ("FE80::1", "2001:db8::1", False), ("2001:DB8::2", "ff02::1", False), ("2001:DB8::2", "2001:db8::1", True),
        ("ffx", "10.0.0.1", True),
    ]
    rows = [packet(i, 1.0, src=f"{a}:1", dst=f"{b}:2") for i, (a, b, _) in enumerate(pairs)]
    kept = {r.seq: r.src_ip for r in scope_filter(frame(spark, rows)).collect()}
    assert set(kept) == {i for i, (_, _, ok) in enumerate(pairs) if ok}
    assert kept[8] == "2001:db8::2"
    assert 3 not in {r.seq for r in scope_filter(frame(spark, rows), all_multicast=True).collect()}


def test_validation_and_ranges(spark):
    raw = spark.createDataFrame(
        [("1.0", "10", "80", "81"), (None, "10", "80", "81"), ("1.0", "-1", "80", "81"), ("1.0", "10", "70000", None),
         ("1.0", "10", "x", "1"), ("1.0", "10", None, None)],
        "timestamp string, length string, src_port string, dst_port string",
    )
    good, bad = split_valid(raw)
    assert good.count() == 2
    assert sorted(r.reject_reason for r in bad.collect()) == [
        "length negative", "src_port out of range", "src_port out of range", "timestamp missing",
    ]
    packets = frame(spark, [packet(i, float(i)) for i in range(10)])
    assert [r.seq for r in packet_range(packets, 3, 2).collect()] == [3, 4]
    looped = replay(packets, 3).orderBy("seq").collect()
    assert [r.seq for r in looped] == list(range(30))
    assert looped[10].ts_us == looped[9].ts_us + 1_000_000
