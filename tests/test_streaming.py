from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from netloom.config import DetectionConfig, WindowConfig
from netloom.operators.alerts import live_alerts
from netloom.plans.detection import detect
from netloom.plans.queries import DRIVER_DETECTION, WINDOW
from netloom.schema import PACKET_SCHEMA
from netloom.sources.driver_tables import driver_packets
from netloom.sources.packets import stream_packets
from netloom.streaming.live import NAME_GROUPS, Memory, NameGroups, end_of_input, entropy_bits, start_detection, table_sink
from tests.helpers import frame, packet

SHOWN = ["flow_id", "timestamp", "threat_class", "confidence", "fusion_reason"]


def shown(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*SHOWN).collect())


def test_stream_equals_batch(spark, tmp_path):
    view = driver_packets(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_micros("ts_us"))
    cols = [(F.col(f.name) if f.name in view.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA.fields]
    view.select(*cols).write.parquet(str(tmp_path / "all"))
    packets = spark.read.schema(PACKET_SCHEMA).parquet(str(tmp_path / "all"))
    for i in range(3):
        packets.filter(F.col("seq").between(i * 350, i * 350 + 349)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    us = F.unix_micros("ts")
    anchor, newest = packets.agg(F.min_by(us, "seq"), F.max(us)).first()
    end_of_input(spark, newest, WINDOW, anchor).coalesce(1).write.parquet(str(tmp_path / "in" / "end"))
    query = start_detection(
        stream_packets(spark, str(tmp_path / "in" / "*"), max_files=1), WINDOW, DRIVER_DETECTION,
        str(tmp_path / "state"), table_sink(str(tmp_path / "out")), anchor_us=anchor,
    )
    assert query.awaitTermination(400) and query.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = live_alerts(detect(packets, WINDOW, DRIVER_DETECTION).fused_verdicts())
    assert streamed.agg(F.max("timestamp")).first()[0] > anchor + 200_000_000
    assert shown(streamed) == shown(batch)


def test_stream_reports_flows_that_detectors_cannot_judge(spark, tmp_path):
    """Missing and negative lengths: errors equal batch, alerts of the other flows go on."""
    lengths = {"10.0.0.1": None, "10.0.0.2": -50, "10.0.0.3": 70}
    rows = []
    for i in range(90):
        host = list(lengths)[i % 3]
        src, dst = f"{host}:4000", "203.0.113.9:443"
        if i % 5 == 4:
            src, dst = dst, src
        # One of many packets without a length leaves the flow's sum known.
        rows.append(packet(i, 100 + i * 0.2, lengths[host] if i != 47 else None, src, dst, tls_is_client_hello=i % 7 == 0))
    packets = frame(spark, rows).select(*[f.name for f in PACKET_SCHEMA.fields])
    packets.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    window = WindowConfig(5, 1)
    end_of_input(spark, rows[-1]["ts_us"], window, rows[0]["ts_us"]).coalesce(1).write.parquet(str(tmp_path / "in" / "end"))
    query = start_detection(
        stream_packets(spark, str(tmp_path / "in" / "*")), window, DRIVER_DETECTION, str(tmp_path / "state"),
        table_sink(str(tmp_path / "out")), anchor_us=rows[0]["ts_us"], on_errors=table_sink(str(tmp_path / "errors")),
    )
    assert query.awaitTermination(400) and query.exception() is None
    names = ["window_end_us", "flow_id", "error_message"]
    fused = detect(packets, window, DRIVER_DETECTION).fused()
    want = sorted(map(tuple, fused.filter("status = 'error'").select(*names).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "errors")).select(*names).collect())) == want
    assert {w[2].split(" ")[2].rstrip(";") for w in want} == {"missing", "negative"}
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(live_alerts(fused))


def test_entropy_matches_column():
    assert entropy_bits("aabb") == 1.0 and entropy_bits("") == 0.0


def test_flows_of_a_busy_pair_expire(spark, tmp_path):
    """One pair that never rests and uses a new port all the time keeps few of its flows."""
    window, n = WindowConfig(1, 1), 2000
    cfg = replace(
        DRIVER_DETECTION, beacon=replace(DRIVER_DETECTION.beacon, history_s=5.0),
        tls=replace(DRIVER_DETECTION.tls, idle_s=5.0),
    )
    rows = [packet(i, 100 + i * 0.05, src=f"10.0.0.1:{20_000 + i}", dst="203.0.113.5:8080") for i in range(n)]
    for part in range(4):
        some = frame(spark, rows[part * n // 4 : (part + 1) * n // 4]).select(*[f.name for f in PACKET_SCHEMA.fields])
        some.coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    query = start_detection(
        stream_packets(spark, str(tmp_path / "in" / "*"), max_files=1), window, cfg,
        str(tmp_path / "state"), table_sink(str(tmp_path / "out")),
    )
    assert query.awaitTermination(600) and query.exception() is None
    memory = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if "ransformWithState" in o["operatorName"]]
    # A flow has a state row and a timer in two orders; five seconds hold a hundred of them.
    assert memory and max(memory) > 100 and memory[-1] < n


def test_memory_looks_a_name_up_once_for_all_windows_of_a_call():
    """A packet's name comes in every window over it; each lookup is a call to the state server."""
    from types import SimpleNamespace

    class Names(dict):
        looked = 0

        def containsKey(self, key):
            self.looked += 1
            return key in self

        def updateValue(self, key, value):
            self[key] = value

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    timers = []
    memory = Memory(DetectionConfig(), ["flow_id"])
    memory.pair, memory.names = Value(), Names()
    memory.handle = SimpleNamespace(listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    rows = pd.DataFrame([
        {"flow_id": "f", "window_end_us": k * 1_000_000, "first_seq": k, "protocol": "UDP", "src_port": 4000, "dst_port": 53,
         "fwd_byte_count": 10 * k, "rev_byte_count": None, "names": ["a.b", "c.d", "a.b"]}
        for k in (3, 1, 2)
    ])
    made = next(memory.handleInputRows(("s", "pair", "x>y"), iter([rows]), None))
    assert memory.names.looked == 2
    assert made["windows_active"].tolist() == [1, 2, 3] and made["pair_fwd_max"].tolist() == [10, 20, 30]
    assert made["name_count"].tolist() == [2, 2, 2] and made["windows_seen"].isna().all()
    next(memory.handleInputRows(("s", "pair", "x>y"), iter([rows.assign(window_end_us=4_000_000)]), None))
    assert memory.names.looked == 4 and len(timers) == 1 and memory.pair.held[5] == 2


class _Map(dict):
    """A map state that counts the calls to the state server."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, key):
        del self[key]


def test_memory_takes_many_flows_in_one_call():
    """A call per flow takes milliseconds in the worker, so flows share keys, each with an entry of its own."""
    from types import SimpleNamespace

    timers = []
    memory = Memory(DetectionConfig(), ["flow_id", "window_end_us"])
    memory.flows = _Map()
    memory.handle = SimpleNamespace(listTimers=lambda: iter(timers), registerTimer=timers.append)

    def rows(*found):
        return pd.DataFrame([
            {"flow_id": f, "window_end_us": end * 1_000_000, "first_seq": end, "tls_client_hello": f == "a", "tls_has_sni": False,
             "fwd_byte_count": size, "rev_byte_count": None}
            for f, end, size in found
        ])

    made = next(memory.handleInputRows(("s", "flow", "7"), iter([rows(("a", 3, 5), ("b", 3, 9)), rows(("a", 2, 7), ("a", 4, 6))]), None))
    assert memory.flows.calls == 4 and len(timers) == 1
    assert made["flow_id"].tolist() == ["a", "a", "b", "a"] or made["flow_id"].tolist() == ["a", "b", "a", "a"]
    of_a = made[made["flow_id"] == "a"]
    assert of_a["windows_seen"].tolist() == [1, 2, 3] and of_a["observed_us"].tolist() == [0, 1_000_000, 2_000_000]
    assert of_a["flow_fwd_max"].tolist() == [7, 7, 7] and of_a["hello_seen"].tolist() == [1, 1, 1]
    assert made[made["flow_id"] == "b"][["windows_seen", "flow_fwd_max", "hello_seen"]].values.tolist() == [[1, 9, 0]]
    again = next(memory.handleInputRows(("s", "flow", "7"), iter([rows(("b", 500, 1))]), None))
    # Idle for longer than TLS and beacons are remembered: counted anew.
    assert again[["windows_seen", "tls_windows", "flow_fwd_max"]].values.tolist() == [[1, 1, 1]]
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 400_000)
    assert list(memory.handleExpiredTimer(("s", "flow", "7"), late, None)) == []
    assert list(memory.flows) == [("b",)] and len(timers) == 2 and timers[1] > 400_000


def test_names_are_read_and_written_in_groups():
    """Ten thousand names of a pair take a call for each group, not two for each name."""
    kept = _Map()
    names = NameGroups(kept)
    first = [(f"n{i}.example.com",) for i in range(10_000)]
    for name in first:
        assert not names.containsKey(name)
        names.updateValue(name, (1,))
    names.save()
    assert kept.calls <= 2 * NAME_GROUPS and sum(len(v[0]) for v in kept.values()) == 10_000
    assert all(names.containsKey(name) for name in first) and not names.containsKey(("other",))
    names.clear()
    assert not names.containsKey(first[0])
    names.updateValue(first[0], (1,))
    names.save()
    assert list(kept.values()) == [([first[0][0]],)]
