import json
import struct

import pytest
from pyspark.sql import functions as F

from netloom.operators.datasets import dataset_inventory, validation_summary
from netloom.schema import FEATURES_13
from netloom.sources import cic, ctu, dnsexf
from netloom.sources.capture import read_captures
from netloom.sources.features_io import read_features, run_header, write_features, write_report
from netloom.sources.manifest import (
    BlockedFileError, allowed_paths, blocked_paths, check_training_files, check_training_path, file_manifest,
    read_manifest,
)
from netloom.sources.packets import read_packets, submitted_packets, write_packets
from netloom.sources.tabular import read_text_table
from tests.helpers import frame, packet

CIC = """﻿ Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,Label
5222,6,21/11/2031 05:06:07,250000,4,2,800,200,4000.5,Benign
6001,6,7/12/2031 23:01:02,0,5,6,90,0,Infinity,Bot
Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow Byts/s,Label
9100,17,07/12/2031 23:05:00,5d,2,x,71,64,nan,DoS attacks-Hulk
"""
CTU = """StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,TotPkts,TotBytes,SrcBytes,Label
2031/11/21 05:06:07.125,60.5,udp,198.51.100.7,5353,  <->,192.0.2.20,7001,CON,9,900,350,flow=Background-UDP
2031/11/21 06:00:00.26,2.25,tcp,192.0.2.33,0x1f,   ->,203.0.113.9,2525,S_,4,320,320,flow=From-Botnet-V9-TCP-Attempt
2031/11/21 06:10:00.5,4.0,TCP,192.0.2.41,3001,->,203.0.113.8,8088,CON,8,640,256,flow=From-Botnet-V9-CC-3
2031/11/21 06:10:09.75,soon,tcp,192.0.2.41,3002,->,203.0.113.8,8088,CON,n,n,n,flow=Background-TCP
not a time,1,tcp,192.0.2.41,3003,->,203.0.113.8,8088,CON,5,500,200,flow=Normal
"""


def test_cic_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CIC, encoding="utf-8")
    rows = {r.row_idx: r for r in cic.read_cic(spark, str(tmp_path / "a.csv")).collect()}
    assert set(rows) == {0, 1, 3}
    assert [rows[i].label_name for i in (0, 1, 3)] == ["BENIGN", "UNKNOWN", "DDOS"]
    assert rows[0].flow_id == "cic_row_0" and rows[0].flow_duration == 0.25
    assert rows[0].fwd_bytes_per_sec == pytest.approx(800 / 0.25) and rows[0].is_tcp == 1.0
    assert rows[1].fwd_bytes_per_sec is None and rows[1].byte_ratio == 10000.0 and rows[1].is_unidirectional == 1.0
    assert rows[3].flow_duration is None and rows[3].fwd_packet_count is None and rows[3].is_udp == 1.0
    assert rows[0].src_ip_flow_count is None
    assert rows[0].dataset_specific_features == {"Dst Port": "5222", "Flow Byts/s": "4000.5"}
    train = cic.load_training(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()
    assert [r.label for r in train] == [0, 1] and train[1]["Flow Byts/s"] == 0.0
    first = cic.load_training(spark, str(tmp_path / "a.csv"), max_rows=1).collect()
    assert [r.row_idx for r in first] == [train[0].row_idx]
    model = cic.load_model_training(spark, str(tmp_path / "a.csv")).orderBy("row_idx").first()
    assert model.byte_ratio == pytest.approx(800 / (800 + 200)) and set(FEATURES_13) <= set(model.asDict())
    summary = validation_summary(cic.read_cic(spark, str(tmp_path / "a.csv"))).first()
    assert (summary.total_records, summary.missing_core_features, summary.out_of_order_records) == (3, 3, 0)
    inv = dataset_inventory(read_text_table(spark, str(tmp_path / "a.csv")), "CIC", "Label", "Timestamp").collect()
    assert sum(r.rows for r in inv) == 4 and inv[0].timestamp_column_present


def test_ctu_rows(spark, tmp_path):
    (tmp_path / "a.binetflow").write_text(CTU)
    rows = ctu.read_ctu(spark, str(tmp_path), glob="*.binetflow").orderBy("row_idx").collect()
    assert [r.label_name for r in rows] == ["BENIGN", "UNKNOWN", "C2_BEACONING", "BENIGN"]
    assert rows[0].rev_byte_count == 550 and rows[1].src_port is None and rows[1].byte_ratio == 10000.0
    assert rows[1].ts.microsecond == 260000 and rows[2].protocol == "tcp"
    assert rows[3].flow_duration is None and rows[3].fwd_byte_count is None
    assert rows[2].flow_id == "ctu_row_2_192.0.2.41_203.0.113.8"
    assert [r.label for r in ctu.load_training(spark, str(tmp_path), glob="*.binetflow").orderBy("row_idx").collect()] == [0, 1, 1, 0, 0]


def test_rows_keep_their_numbers_over_splits(spark, tmp_path):
    lines = ["StartTime,Label"] + [f"2031/11/21 05:06:07.{i:06d},Normal" for i in range(3000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = ctu.read_ctu(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 1
        wrong = rows.filter(F.col("row_idx") != F.unix_micros("ts") % 1_000_000).count()
        assert rows.count() == 3000 and wrong == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_directory_labels(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.csv").write_text("A_frequency,rr_count\n1,2\n,nan\n")
    rows = dnsexf.load_directory(spark, str(tmp_path), 1).collect()
    assert sorted((r.A_frequency, r.rr_count, r.ttl_mean, r.label) for r in rows) == [(0, 0, 0, 1), (1, 2, 0, 1)]


def test_manifest_guard(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"a")
    (tmp_path / "b.bin").write_bytes(b"b")
    files = file_manifest(spark, str(tmp_path), "*.bin")
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.collect()}
    (tmp_path / "m.json").write_text(json.dumps({"elsewhere/copy.bin": hashes["a.bin"]}))
    manifest = read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.path[-5:] for r in blocked_paths(files, manifest, "kept/apart").collect()] == ["a.bin"]
    assert [r.path[-5:] for r in allowed_paths(files, manifest, "kept/apart").collect()] == ["b.bin"]
    with pytest.raises(BlockedFileError):
        check_training_files(files, manifest, "kept/apart")
    with pytest.raises(BlockedFileError):
        check_training_path(spark, "x\\kept\\apart\\a.pcap", "kept/apart")
    check_training_path(spark, "x/y.csv", "kept/apart", manifest)


def ethernet(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + payload


def ipv4(proto, body, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    return bytes([0x45, 0]) + struct.pack(">HHHBBH", 20 + len(body), 0, 0, 64, proto, 0) + bytes(src) + bytes(dst) + body


def test_capture_decoding(spark, tmp_path):
    name = b"\x03abc\x07example\x00" + struct.pack(">HH", 16, 1)
    dns = struct.pack(">HHHHHH", 1, 0x8183, 1, 0, 0, 0) + name
    udp = struct.pack(">HHHH", 5000, 53, 8 + len(dns), 0) + dns
    sni = b"\0\0" + struct.pack(">HHBH", 14, 12, 0, 9) + b"a.example"
    ext = sni + struct.pack(">HH", 23, 0)
    hello = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 4) + b"\x13\x01\x13\x02" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    record = b"\x16\x03\x01" + struct.pack(">H", len(hello) + 4) + b"\x01" + struct.pack(">I", len(hello))[1:] + hello
    tcp = struct.pack(">HHIIBBHHH", 4000, 443, 0, 0, 0x50, 0x18, 0, 0, 0) + record
    frames = [ethernet(ipv4(17, udp)), ethernet(b"\0" * 28, 0x0806), ethernet(ipv4(6, tcp)), ethernet(ipv4(17, udp, dst=(224, 0, 0, 1)))]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack("<IIII", 1700000000 + i, 250000, len(f), len(f)) + f
    (tmp_path / "x.pcap").write_bytes(data)
    rows = read_captures(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 2]
    d, t = rows
    assert (d.protocol, d.src_port, d.dst_port, d.dns_query_name, d.dns_query_type, d.dns_response_code) == (
        "UDP", 5000, 53, "abc.example.", 16, 3)
    assert (t.tls_is_client_hello, t.tls_sni, t.tls_version, t.tls_cipher_suites_count, t.tls_extensions_count) == (
        True, "a.example", 771, 2, 2)
    assert t.length == len(frames[2]) and d.ts.microsecond == 250000
    (tmp_path / "bad.pcap").write_bytes(b"not a capture")
    with pytest.raises(Exception, match="not a classic capture"):
        read_captures(spark, str(tmp_path)).collect()


def test_packet_tables_and_submissions(spark, tmp_path):
    packets = frame(spark, [packet(i, 1.0 + i) for i in range(5)])
    write_packets(packets.drop("ts_us"), str(tmp_path / "p"))
    assert read_packets(spark, str(tmp_path / "p")).count() == 5
    texts = [
        {"stream_id": "s", "seq": 1, "timestamp": 1.5, "length": 10, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1, "dst_port": 2, "protocol": "TCP"},
        {"stream_id": "s", "seq": 2, "timestamp": 1.5, "length": -1},
    ]
    good, bad = submitted_packets(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string"))
    assert good.first().ts.microsecond == 500000 and bad.first().reject_reason == "length negative"


def test_feature_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([tuple([1.5] * 13 + [1])], ", ".join(f"{c} double" for c in FEATURES_13) + ", label int")
    write_features(rows, str(tmp_path / "f"), "csv")
    assert read_features(spark, str(tmp_path / "f"), "csv").first().asDict() == rows.first().asDict()
    alerts = spark.createDataFrame(
        [("s", "f", 1, "DDoS", 1.0, "HIGH", {"a": "b"})],
        "stream_id string, flow_id string, timestamp bigint, threat_class string, confidence double, severity string, evidence map<string,string>")
    header = run_header("x", frame(spark, [packet(0, 1.0)]), alerts, alerts)
    write_report(alerts, header, str(tmp_path / "r"))
    got = spark.read.json(str(tmp_path / "r" / "run")).first()
    assert (got.total_packets, got.total_results, got.total_alerts, got.schema_valid) == (1, 1, 1, True)
