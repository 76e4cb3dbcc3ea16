import random

import pytest
from pyspark.sql import functions as F

from netloom.config import BeaconConfig, DdosConfig, DetectionConfig, DnsConfig, FusionConfig, WindowConfig
from netloom.operators import detectors as dt
from netloom.operators.alerts import (
    alert_counts, dedup_alerts, flag_alerted_hosts, live_alerts, newest_alerts, schema_check, severity_summary,
    threat_level_of, threat_levels, to_alerts, with_model_flag,
)
from netloom.operators.detectors.base import verdict, verdict_rows
from netloom.operators.features import features16, to_model_input
from netloom.operators.flows import build_flows
from netloom.operators.fusion import fuse, gather, pick_winner
from netloom.operators.history import pair_history, running_history, trailing_windows
from netloom.plans.detection import detect
from netloom.schema import RESULT_TYPE
from tests.helpers import frame, packet

SEC = 1_000_000


def test_flood_scan_and_transfer_are_found(spark):
    rows, seq = [], 0
    for i in range(7200):  # 60 sources, one host, five seconds
        rows.append(packet(seq, 100 + i / 1440, 60, f"10.1.0.{i % 60}:{2000 + i % 60}", "10.0.0.80:80", stream="flood"))
        seq += 1
    for i in range(700):  # one source walks the ports of one host
        rows.append(packet(i, 100 + i * 0.01, 60, "10.1.0.9:4000", f"10.0.0.7:{i % 60 + 1}", stream="scan"))
    for i in range(1650):  # 1.4 kB out, a short reply every tenth packet
        out = i % 11 != 10
        rows.append(
            packet(i, 100 + i * 0.01, 1400 if out else 60, "192.168.1.5:5000" if out else "203.0.113.5:443",
                   "203.0.113.5:443" if out else "192.168.1.5:5000", stream="exfil")
        )
    window = WindowConfig(5, 0.5)
    found = detect(frame(spark, rows), window)
    alerts = found.alerts().groupBy("stream_id", "threat_class").count().collect()
    kinds = {(r.stream_id, r.threat_class) for r in alerts}
    assert ("flood", "DDoS") in kinds and ("scan", "RECONNAISSANCE") in kinds
    flood = found.gathered.filter("stream_id = 'flood'").select(F.explode("results").alias("r")).select("r.*")
    last = flood.filter("detector = 'DDoSDetector'").orderBy(F.col("evidence.flows_to_dst").cast("int").desc()).first()
    assert last.confidence == 1.0 and last.severity == "HIGH"
    assert last.evidence["reason"].startswith("High flow concentration (60 flows, 60 src IPs to 10.0.0.80)")
    slow = detect(frame(spark, [r for r in rows if r["stream_id"] == "exfil"]), WindowConfig(10, 2)).alerts()
    assert {r.threat_class for r in slow.collect()} == {"DATA_EXFILTRATION"}


def test_beacon_is_found_and_resolver_traffic_is_not(spark):
    rows = [packet(i, 100 + i * 0.5, 80, "10.0.0.1:4000", "198.51.100.7:8080", stream="beacon") for i in range(220)]
    rows += [packet(i, 100 + i * 0.5, 80, "10.0.0.1:4000", "8.8.8.8:8080", stream="dns") for i in range(220)]
    flows = build_flows(frame(spark, rows), WindowConfig(5, 1))
    made = dt.detect_beacon(flows).orderBy("window_end_us").collect()
    assert {r.stream_id for r in made} == {"beacon"}
    first = made[0].result
    # The span reaches 60 s at the 61st window; by then it has been seen 61 times.
    assert made[0].window_end_us == (100 + 61) * SEC
    assert first.evidence["windows_seen"] == "61"
    assert first.confidence == pytest.approx(0.5 + 0.35 + 0.15 * 7 / 50)
    assert first.evidence["reason"] == (
        "Highly regular timing (CV=0.000) and Sustained over 61 windows (60.0s) and Non-infrastructure port (8080)"
    )


def test_hello_without_name_is_found(spark):
    def hello(i, t, sni, stream):
        return packet(i, t, 200, "10.0.0.1:4000", "198.51.100.7:443", stream=stream, tls_is_client_hello=True, tls_sni=sni)

    rows = []
    for stream, sni in (("bare", None), ("named", "a.example")):
        rows += [packet(0, 100, 60, "10.0.0.1:4000", "198.51.100.7:443", stream=stream), hello(1, 100.2, sni, stream)]
        rows += [packet(i, 100 + i, 60, "10.0.0.1:4000", "198.51.100.7:443", stream=stream) for i in range(2, 6)]
    made = dt.detect_tls(build_flows(frame(spark, rows), WindowConfig(5, 1))).collect()
    assert {r.stream_id for r in made} == {"bare"}
    assert {r.result.confidence for r in made} == {0.85}
    assert min(r.window_end_us for r in made) == 102 * SEC


def test_running_history_matches_brute_force(spark):
    rng, rows = random.Random(5), []
    for k in range(30):
        t = 0
        for _ in range(60):
            t += rng.choice([1, 1, 1, 2, 3, 9]) * SEC
            rows.append((f"k{k}", t, rng.randint(0, 99)))
    df = spark.createDataFrame(rows, "key string, window_end_us bigint, v bigint")
    idle = 5 * SEC
    for before in (False, True):
        got = {
            (r.key, r.window_end_us): (r.total, r.top, r.session_start)
            for r in running_history(
                df, ["key"], {"total": ("sum", "v"), "top": ("max", "v")}, idle, block_us=10 * SEC, before=before
            ).collect()
        }
        want, state = {}, {}
        for key, t, v in rows:
            last, total, top, start = state.get(key, (None, 0, None, t))
            if last is not None and t - last > idle:
                total, top, start = 0, None, t
            after = (total + v, v if top is None else max(top, v))
            want[key, t] = (total, top, start) if before else (*after, start)
            state[key] = (t, *after, start)
        if before:
            got = {k: (a or 0, b, s) for k, (a, b, s) in got.items()}
        assert got == want


def test_pair_history_and_trailing_windows_match_brute_force(spark):
    rng, rows = random.Random(6), []
    for w in range(80):
        for f in range(rng.randint(0, 4)):
            rows.append(("s", w * SEC * rng.choice([1, 1, 1]), f"f{f}", f"h{f % 2}", "d", w * 10 + f, rng.randint(0, 9)))
    df = spark.createDataFrame(
        rows, "stream_id string, window_end_us bigint, flow_id string, src_ip string, dst_ip string, first_seq bigint, v bigint"
    )
    got = {
        (r.window_end_us, r.flow_id): (r.n, r.top)
        for r in pair_history(df.withColumn("one", F.lit(1)), {"n": ("sum", "one"), "top": ("max", "v")}, 2 * SEC).collect()
    }
    state, want, last = {}, {}, {}
    for _, t, f, h, _, _, v in sorted(rows, key=lambda r: (r[1], r[5])):
        if h in last and t - last[h] > 2 * SEC:
            state[h] = (0, -1)
        n, top = state.get(h, (0, -1))
        state[h], last[h] = (n + 1, max(top, v)), t
        want[t, f] = state[h]
    assert got == want
    seen = {(r.window_end_us, r.flow_id): (r.windows_seen, r.observed_us) for r in trailing_windows(df, 5 * SEC).collect()}
    for _, t, f, *_ in rows:
        mine = [u for _, u, g, *_ in rows if g == f and t - 5 * SEC <= u <= t]
        assert seen[t, f] == (len(mine), t - min(mine))


def test_distinct_names_count_once_per_session(spark):
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows, seq = [], 0
    for i in range(30):
        name = base[i % 20 :] + base[: i % 20] + ".example."
        for src, dst, shown in (("10.0.0.1:5000", "10.0.0.53:53", ""), ("10.0.0.1:5000", "10.0.0.53:53", name)):
            rows.append(packet(seq, 100 + i * 0.5, 90, src, dst, "UDP", dns_query_name=shown))
            seq += 1
    rows.append(packet(seq, 130.0, 60, "10.0.0.1:5000", "10.0.0.53:53", "UDP"))
    found = detect(frame(spark, rows), WindowConfig(5, 1), DetectionConfig(dns=DnsConfig(min_queries=15)))
    results = (
        found.gathered.select("window_end_us", F.explode("results").alias("r"))
        .filter("r.detector = 'DNSTunnelDetector'").orderBy("window_end_us").select("window_end_us", "r.*").collect()
    )
    assert results[0].status == "INSUFFICIENT_DATA"
    assert results[-1].status == "DETECTED" and results[-1].score == 1.0
    assert results[-1].evidence["unique_queries_across_windows"] == "20"


def test_feature_contract(spark):
    rows = [packet(0, 10.0, 100), packet(1, 11.0, 100), packet(2, 10.5, 100, "10.0.0.2:80", "10.0.0.1:1000"), packet(3, 13.0)]
    flows = build_flows(frame(spark, rows), WindowConfig(2, 1)).filter("window_end_us = 11000000")
    got = features16(flows).first()
    assert (got.fwd_bytes_per_sec, got.rev_bytes_per_sec, got.byte_ratio, got.is_unidirectional) == (200, 100, 2, 0)
    with pytest.raises(ValueError):
        to_model_input(features16(flows).drop("is_tcp"))
    broken = features16(flows).withColumn("is_udp", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="is null"):
        to_model_input(broken).collect()


def result(threat, confidence=None, score=None, severity="HIGH", status="DETECTED", detector="x", error=None):
    return (detector, status, threat, severity, confidence, score, {"reason": "r"}, error)


def winner(spark, *results):
    df = spark.createDataFrame([(list(results),)], f"r array<{RESULT_TYPE.simpleString()}>")
    w = df.select(pick_winner(F.col("r")).alias("w")).first().w
    return w.result.threat_type, w.reason


def test_winner_rules(spark):
    assert winner(spark, result("DDoS", 1.0)) == ("DDoS", "only detector to fire")
    assert winner(spark, result("C2_BEACONING", 0.99), result("DATA_EXFILTRATION", 1.0)) == (
        "DATA_EXFILTRATION", "threat class priority DATA_EXFILTRATION > C2_BEACONING (confidence tied)")
    assert winner(spark, result("DDoS", 1.0), result("C2_BEACONING", 0.99)) == ("DDoS", "highest severity")
    # Within the tie width pairwise, not overall: the fold's order decides.
    assert winner(spark, result("DDoS", 0.80), result("C2_BEACONING", 0.815), result("ENCRYPTED_MALWARE", 0.83)) == (
        "ENCRYPTED_MALWARE", "higher confidence 0.83 vs 0.80")
    assert winner(spark, result("C2_BEACONING", 0.8), result("RECONNAISSANCE", None, 1.0))[0] == "RECONNAISSANCE"
    assert winner(spark, result("C2_BEACONING", 0.0, 0.9), result("DATA_EXFILTRATION", 0.5))[0] == "C2_BEACONING"
    assert winner(spark, result("DDoS", 1.0), result("C2_BEACONING", 0.1, severity="CRITICAL")) == (
        "C2_BEACONING", "higher severity CRITICAL vs HIGH")


def test_fusion_states_and_alert_reports(spark):
    ids = spark.createDataFrame([("s", t * SEC, f"10.0.0.{t}:1-10.0.0.99:2-TCP") for t in range(1, 6)],
                                "stream_id string, window_end_us bigint, flow_id string")

    def rows(cond, *args, **kw):
        return verdict_rows(ids.filter(cond), verdict(*args, **kw))

    fired = rows("window_end_us <= 2000000", "DDoSDetector", "DETECTED", "DDoS", "HIGH", confidence=F.lit(1.0))
    scan = rows("window_end_us = 2000000", "ReconnaissanceDetector", "DETECTED", "RECONNAISSANCE", "HIGH", score=F.lit(1.0))
    failed = rows("window_end_us IN (2000000, 3000000)", "C2BeaconingDetector", "error", error=F.lit("broken"))
    weak = rows("window_end_us = 4000000", "DNSTunnelDetector", "UNVALIDATED", "DNS_DGA_TUNNEL", "LOW", score=F.lit(0.4))
    fused = fuse(ids, gather([fired, failed, weak, scan])).orderBy("window_end_us").persist()
    got = [(r.status, r.threat_type, r.fusion_reason, r.error_message) for r in fused.collect()]
    assert got == [
        ("DETECTED", "DDoS", "only detector to fire", None),
        ("error", None, "1 detector(s) raised exceptions", "broken"),
        ("error", None, "1 detector(s) raised exceptions", "broken"),
        ("UNVALIDATED", "DNS_DGA_TUNNEL", "Unvalidated signal from: DNSTunnelDetector", None),
        ("BENIGN", "BENIGN", "No detector fired", None),
    ]
    assert [len(r.all_detector_results) for r in fused.collect()] == [6] * 5
    alerts = to_alerts(fused, "REAL_PCAP")
    assert alerts.count() == 1 and schema_check(alerts).first().asDict() == {
        "total_alerts": 1, "missing_keys": 0, "confidence_out_of_range": 0}
    assert with_model_flag(live_alerts(fused)).orderBy("timestamp").first().ml_assisted
    assert live_alerts(fused).count() == 2
    assert dedup_alerts(fused).first()["count"] == 1
    assert alert_counts(alerts).first()["count"] == 1 and newest_alerts(alerts, 1).count() == 1
    assert severity_summary(alerts).first().high_alerts == 1
    assert threat_levels(alerts, 4 * SEC).first().level == pytest.approx(0.8 * (1 - 3 / 15))
    assert threat_level_of(alerts, ["DDOS", "RECON"], 4 * SEC).first().meter == "DDOS"
    hosts = spark.createDataFrame([("s", "10.0.0.1"), ("s", "10.0.0.5")], "stream_id string, ip string")
    assert {r.ip: r.alerted for r in flag_alerted_hosts(hosts, alerts).collect()} == {"10.0.0.1": True, "10.0.0.5": False}


def test_custom_detector_and_priorities(spark):
    rows = [packet(i, 100.0 + i) for i in range(4)]

    def loud(flows):
        return verdict_rows(flows, verdict("Loud", "DETECTED", "NOISE", "CRITICAL", confidence=F.lit(0.5)))

    cfg = DetectionConfig(fusion=FusionConfig(threat_priority={"NOISE": 1}))
    fused = detect(frame(spark, rows), WindowConfig(2, 1), cfg, custom={"Loud": loud}).fused()
    assert {(r.threat_type, len(r.all_detector_results)) for r in fused.collect()} == {("NOISE", 7)}


def test_one_signal_threshold_keeps_rate_only_flows(spark):
    rows = [packet(i, 100 + i * 0.01, dst="10.0.0.2:20000") for i in range(300)]
    flows = build_flows(frame(spark, rows), WindowConfig(2, 1))
    assert dt.detect_ddos(flows, DdosConfig(high_rate_pps=50, min_signals=1)).count() == flows.count()
    assert dt.detect_ddos(flows, DdosConfig(high_rate_pps=50)).count() == 0
    assert BeaconConfig().min_windows == 10


def test_pair_history_in_blocks(spark):
    """A hot pair's flows of one window are folded in blocks, whatever the block length."""
    rng = random.Random(9)
    rows = [("s", w * SEC, f"f{i}", "h", "d", w * 1000 + i, rng.randint(0, 99)) for w in range(1, 4) for i in range(60)]
    df = spark.createDataFrame(
        rows, "stream_id string, window_end_us bigint, flow_id string, src_ip string, dst_ip string, first_seq bigint, v bigint"
    ).withColumn("one", F.lit(1))
    measures = {"n": ("sum", "one"), "top": ("max", "v")}
    for size in (1, 7, 1 << 18):
        got = pair_history(df, measures, 2 * SEC, block_seqs=size).orderBy("first_seq").collect()
        top, want = 0, []
        for n, row in enumerate(rows, 1):
            top = max(top, row[-1])
            want.append((n, top))
        assert [(r.n, r.top) for r in got] == want


def test_a_detector_error_takes_the_place_of_its_verdict(spark):
    packets = [packet(i, 100 + i / 40, 60, f"10.1.0.{i % 30}:{2000 + i % 30}", "10.0.0.80:80") for i in range(200)]
    cfg = DetectionConfig(ddos=DdosConfig(sources_to_dst=20, high_rate_pps=1))
    clean = detect(frame(spark, packets), WindowConfig(2, 1), cfg).fused().collect()
    status = {(r.window_end_us, r.flow_id): r.status for r in clean}
    assert "DETECTED" in status.values() and "error" not in status.values()
    length = F.when(F.col("src_ip") != "10.1.0.7", F.col("length"))
    broken = detect(frame(spark, packets).withColumn("length", length), WindowConfig(2, 1), cfg).fused().collect()
    errors = [r for r in broken if r.status == "error"]
    assert len(broken) == len(clean) and {r.flow_id.split(":")[0] for r in errors} == {"10.1.0.7"}
    assert all(r.fusion_reason == "4 detector(s) raised exceptions" for r in errors)
    assert all(r.error_message == "; ".join(["byte_count is missing"] * 4) for r in errors)
    assert all(r.status == status[r.window_end_us, r.flow_id] for r in broken if r.status != "error")
