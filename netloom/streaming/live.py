"""Packets to alerts as a Structured Streaming query.

packets -> watermark -> flows of closed windows -> memory of flows and host pairs ->
verdicts and fusion per micro-batch -> sink. Windows close when the watermark passes them, and all
flows of a window reach the sink in the same micro-batch, so source and destination
context is complete there.

The grid anchor is a setting: a stream cannot know its first packet beforehand. With the
same anchor and packets in order, results equal those of ``plans.detection.detect``,
up to the last windows once ``end_of_input`` has been appended to the source.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import log2
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.config import MICROS, DetectionConfig, WindowConfig
from netloom.functions.columns import flow_id
from netloom.operators import detectors as d
from netloom.operators.alerts import live_alerts
from netloom.operators.detectors.base import error_rows
from netloom.operators.detectors.beacon import judge_beacon
from netloom.operators.detectors.dns import judge_dns
from netloom.operators.detectors.exfil import goes_outside, judge_exfil
from netloom.operators.detectors.tls import judge_tls
from netloom.operators.flows import FLOW_COLUMNS
from netloom.operators.fusion import fuse, gather
from netloom.operators.prepare import FLOW_KEY, in_flow, scope_filter, with_flow_key
from netloom.plans.detection import NEEDS
from netloom.schema import DETECTORS, PACKET_SCHEMA
from netloom.session import fresh_path


def stream_flows(
    packets: DataFrame, cfg: WindowConfig, anchor_us: int = 0, delay_s: float | None = None
) -> DataFrame:
    """Flows of closed windows, with the columns of the batch ``build_flows``.

    Windows include both ends: they are one microsecond longer than the window length.
    ``delay_s`` is how late packets may be (the window length by default).
    """
    window_us, slide_us = cfg.window_us, cfg.slide_us
    offset = (anchor_us - window_us) % slide_us
    delay = window_us if delay_s is None else round(delay_s * MICROS)
    timed = scope_filter(packets).withWatermark("ts", f"{delay} microseconds")
    # Every packet moves time, also those of no flow. A condition without the event time
    # would be pushed below the watermark.
    rows = with_flow_key(timed.filter(F.when(in_flow(), F.col("ts")).isNotNull()))
    span = F.window("ts", f"{window_us + 1} microseconds", f"{slide_us} microseconds", f"{offset} microseconds")
    packet = F.struct(
        "seq", F.unix_micros("ts").alias("us"), F.col("length").cast("bigint").alias("length"), "a_to_b",
        F.coalesce("tls_is_client_hello", F.lit(False)).alias("hello"),
        F.coalesce(F.col("tls_sni") != "", F.lit(False)).alias("sni"),
        F.nullif("dns_query_name", F.lit("")).alias("name"),
    )
    # A group is one flow within one window; its packets are needed in arrival order.
    grouped = rows.groupBy("stream_id", *FLOW_KEY, span.alias("w")).agg(
        F.array_sort(F.collect_list(packet)).alias("p")
    )
    start = F.struct(
        F.lit(None).cast("bigint").alias("prev"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("s"), F.lit(0.0).alias("q"),
    )

    def step(acc, x):
        gap = F.when((acc["prev"] > 0) & (x["us"] >= acc["prev"]), x["us"] - acc["prev"])
        return F.struct(
            x["us"].alias("prev"),
            (acc["n"] + gap.isNotNull().cast("bigint")).alias("n"),
            (acc["s"] + F.coalesce(gap, F.lit(0))).alias("s"),
            (acc["q"] + F.coalesce(gap.cast("double") * gap, F.lit(0.0))).alias("q"),
        )

    p, head = F.col("p"), F.col("p")[0]
    fwd = F.filter(p, lambda x: x["a_to_b"] == head["a_to_b"])
    rev = F.filter(p, lambda x: x["a_to_b"] != head["a_to_b"])
    rest = F.slice(p, 2, F.size(p))

    def total(values):
        """Sum of the known values; null where none is known."""
        known = F.filter(values, lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, v: acc + v))

    bytes_all = total(F.transform(p, lambda x: x["length"]))
    # A packet of the other direction adds nothing, as in batch.
    bytes_ab = total(F.transform(p, lambda x: F.when(x["a_to_b"], x["length"]).otherwise(F.lit(0).cast("bigint"))))
    n, s, q = F.col("iat.n"), F.col("iat.s").cast("double"), F.col("iat.q")
    first_is_a = F.col("p")[0]["a_to_b"]
    ends = {
        "src_ip": F.when(first_is_a, F.col("ip_a")).otherwise(F.col("ip_b")),
        "dst_ip": F.when(first_is_a, F.col("ip_b")).otherwise(F.col("ip_a")),
        "src_port": F.when(first_is_a, F.col("port_a")).otherwise(F.col("port_b")),
        "dst_port": F.when(first_is_a, F.col("port_b")).otherwise(F.col("port_a")),
    }
    out = grouped.select(
        "stream_id", "protocol", F.window_time("w").alias("ts"),
        *[c.alias(name) for name, c in ends.items()],
        head["seq"].alias("first_seq"),
        F.array_min(F.transform(p, lambda x: x["us"])).alias("first_seen_us"),
        F.array_max(F.transform(p, lambda x: x["us"])).alias("last_seen_us"),
        F.size(p).cast("bigint").alias("packet_count"), bytes_all.alias("byte_count"), bytes_ab.alias("bytes_ab"), first_is_a.alias("first_is_a"),
        F.size(fwd).cast("bigint").alias("fwd_packet_count"), F.size(rev).cast("bigint").alias("rev_packet_count"),
        F.aggregate(p, start, step).alias("iat"),
        F.exists(rest, lambda x: x["hello"]).alias("tls_client_hello"),
        F.exists(rest, lambda x: x["hello"] & x["sni"]).alias("tls_has_sni"),
        F.filter(F.transform(rest, lambda x: x["name"]), lambda x: x.isNotNull()).alias("names"),
    ).withColumns(
        {
            "window_end_us": F.unix_micros("ts"),
            "window_start_us": F.unix_micros("ts") - window_us,
            "fwd_byte_count": F.when(F.col("first_is_a"), F.col("bytes_ab")).otherwise(F.col("byte_count") - F.col("bytes_ab")),
            "rev_byte_count": F.when(F.col("first_is_a"), F.col("byte_count") - F.col("bytes_ab")).otherwise(F.col("bytes_ab")),
            "iat_count": n,
            "iat_mean": F.when(n > 0, s / n / 1e6).otherwise(F.lit(0.0)),
            "iat_std": F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))) / 1e6),
            "dns_query_count": F.size("names").cast("bigint"),
            "flow_id": flow_id(*[F.col(c) for c in (*ends, "protocol")]),
        }
    )
    return out.filter(F.col("window_end_us") > anchor_us).select(*FLOW_COLUMNS, "names", "ts")


def end_of_input(
    spark: SparkSession, newest_us: int, cfg: WindowConfig, anchor_us: int = 0, delay_s: float | None = None
) -> DataFrame:
    """One packet row, of no flow, that closes the last windows of an input that has ended.

    ``newest_us`` is the newest packet's time. Append the row to the source after all
    packets: it moves the watermark just past the last window end up to ``newest_us``, so
    the stream gives the windows that batch gives, and no window that had not ended.
    Needs a slide of a millisecond or more, as watermarks are whole milliseconds.
    """
    if cfg.slide_us < 1000:
        raise ValueError("a stream needs a slide of a millisecond or more")
    delay = cfg.window_us if delay_s is None else round(delay_s * MICROS)
    last_end = anchor_us + (newest_us - anchor_us) // cfg.slide_us * cfg.slide_us
    mark_us = (last_end // 1000 + 1 + delay // 1000) * 1000
    known = {"ts": F.timestamp_micros(F.lit(mark_us)), "src_ip": F.lit("0.0.0.0"), "dst_ip": F.lit("0.0.0.0")}
    return spark.range(1).select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA.fields]
    )


# Per-key state of any size needs the state store that keeps it on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# History columns added by ``Memory``: those of flows, then those of host pairs.
_FLOW_HISTORY = [
    ("windows_seen", T.LongType()), ("observed_us", T.LongType()),
    ("tls_windows", T.LongType()), ("hello_seen", T.IntegerType()), ("sni_seen", T.IntegerType()),
    ("flow_fwd_max", T.LongType()), ("flow_rev_max", T.LongType()),
]
_PAIR_HISTORY = [
    ("pair_fwd_max", T.LongType()), ("pair_rev_max", T.LongType()), ("windows_active", T.LongType()),
    ("name_count", T.LongType()), ("entropy_sum", T.DoubleType()), ("length_sum", T.LongType()),
    ("high_names", T.LongType()),
]
HISTORY_COLUMNS = [name for name, _ in (*_FLOW_HISTORY, *_PAIR_HISTORY)]
FLOW, PAIR = "flow", "pair"
# Flows are dealt into so many keys of the stateful operator, and each flow is an entry of its key's map.
# A call for a key makes data frames and Arrow batches of its own, however few rows it brings.
FLOW_BUCKETS = 1024
NAME_GROUPS = 1024
_FLOW_INPUT = ["flow_id", "window_end_us", "tls_client_hello", "tls_has_sni", "fwd_byte_count", "rev_byte_count"]


def entropy_bits(text: str) -> float:
    """Shannon entropy over characters, for names inside the stateful operator."""
    size = len(text)
    return -sum((k := text.count(c) / size) * log2(k) for c in set(text)) if size else 0.0


def _known(value) -> int:
    """A byte count, 0 where it is missing; such a flow gets an error of its own."""
    return 0 if pd.isna(value) else int(value)


class NameGroups:
    """The names a pair has asked for, kept in groups by hash.

    Each state call is a message to the JVM, so a call for a pair reads and writes a group once at most.
    """

    def __init__(self, groups):
        self.groups = groups
        self._forget()

    def _forget(self) -> None:
        self.held: dict[int, set[str]] = {}
        self.changed: set[int] = set()
        self.emptied = False

    def _group(self, name: str) -> tuple[int, set[str]]:
        at = crc32(name.encode()) % NAME_GROUPS
        if at not in self.held:
            kept = None if self.emptied else self.groups.getValue((at,))
            self.held[at] = set(kept[0]) if kept is not None else set()
        return at, self.held[at]

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self._group(key[0])[1]

    def updateValue(self, key: tuple, value: tuple) -> None:
        at, names = self._group(key[0])
        names.add(key[0])
        self.changed.add(at)

    def clear(self) -> None:
        self.groups.clear()
        self._forget()
        self.emptied = True

    def save(self) -> None:
        """Ends a call: the next one may be for another pair."""
        for at in self.changed:
            self.groups.updateValue((at,), (sorted(self.held[at]),))
        self._forget()


class Memory(StatefulProcessor):
    """Keeps what the detectors remember across windows, of one bucket of flows or of one host pair.

    Each pair is a key of its own. A timer drops its state once it has been idle for longer than
    any detector remembers it. Each flow is an entry of its bucket's map, and a timer of the bucket
    drops the entries that have been idle for so long, so the flows of a busy pair go one by one
    while the pair lives on. An idle limit counts in window ends, as in batch.
    """

    def __init__(self, cfg: DetectionConfig, columns: list[str]):
        self.cfg = cfg
        self.columns = columns
        self.name_groups: NameGroups | None = None
        self.keep_us = {
            FLOW: round(max(cfg.tls.idle_s, cfg.beacon.history_s) * MICROS),
            PAIR: round(max(cfg.exfil.idle_s, cfg.dns.idle_s) * MICROS),
        }

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getMapState(
            "flows", "flow_id string",
            "last bigint, windows bigint, hello int, sni int, fwd bigint, rev bigint, ends array<bigint>",
        )
        self.pair = handle.getValueState(
            "pair", "last bigint, fwd bigint, rev bigint, evals bigint, dns_last bigint, names bigint, "
            "entropy double, length bigint, high bigint"
        )
        self.names = self.name_groups = NameGroups(handle.getMapState("names", "part int", "names array<string>"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        pdf = pd.concat(chunks) if len(chunks) > 1 else chunks[0]
        if len(pdf) > 1:
            pdf = pdf.sort_values(["window_end_us", "first_seq"])
        if key[1] == FLOW:
            made, fields = self._flow_rows(pdf), _FLOW_HISTORY
        else:
            made, fields = self._pair_rows(pdf), _PAIR_HISTORY
        values = dict(zip([n for n, _ in fields], zip(*made)))
        out = {c: pdf[c].array for c in self.columns}
        for n, t in (*_FLOW_HISTORY, *_PAIR_HISTORY):
            out[n] = pd.array(values.get(n, [None] * len(pdf)), "Float64" if t == T.DoubleType() else "Int64")
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key[1] == FLOW:
            self._drop_idle_flows(timerValues.getCurrentWatermarkInMs())
        else:
            self.pair.clear()
            self.names.clear()
            self.name_groups.save()
        return iter([])

    def _drop_idle_flows(self, watermark_ms: int) -> None:
        """Entries idle for too long go; while others stay, the bucket is looked through once per idle limit."""
        keep_us = self.keep_us[FLOW]
        idle, left = [], False
        for name, state in self.flows.iterator():
            if (state[0] + keep_us) // 1000 < watermark_ms:
                idle.append(name)
            else:
                left = True
        for name in idle:
            self.flows.removeKey(name)
        if left:
            self.handle.registerTimer(watermark_ms + keep_us // 1000 + 1)

    def _flow_rows(self, pdf: pd.DataFrame) -> list[tuple]:
        """Each flow's entry is read once and written once a call."""
        met: dict[str, list] = {}
        made = []
        for r in pdf[_FLOW_INPUT].itertuples(index=False):
            state = met.get(r.flow_id)
            if state is None:
                known = self.flows.getValue((r.flow_id,))
                state = [*known[:6], list(known[6])] if known is not None else [None, 0, 0, 0, 0, 0, []]
                met[r.flow_id] = state
            made.append(self._flow_row(state, r))
        for name, state in met.items():
            self.flows.updateValue((name,), tuple(state))
        # The timer stays until it expires; entries met later are looked at by the one that follows.
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((int(pdf["window_end_us"].max()) + self.keep_us[FLOW]) // 1000 + 1)
        return made

    def _pair_rows(self, pdf: pd.DataFrame) -> list[tuple]:
        known = self.pair.get() if self.pair.exists() else None
        state = list(known) if known is not None else [None, 0, 0, 0, None, 0, 0.0, 0, 0]
        met: set[str] = set()
        made = [self._pair_row(state, r, met) for r in pdf.itertuples(index=False)]
        self.pair.update(tuple(state))
        if self.name_groups is not None:
            self.name_groups.save()
        # A pair has a timer from the first time it is met.
        for timer in list(self.handle.listTimers()) if known is not None else []:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((state[0] + self.keep_us[PAIR]) // 1000 + 1)
        return made

    def _flow_row(self, state: list, r) -> tuple:
        cfg, now = self.cfg, int(r.window_end_us)
        last, windows, hello, sni, fwd, rev, ends = state
        if last is not None and now - last > cfg.tls.idle_s * MICROS:
            windows = hello = sni = fwd = rev = 0
        windows, hello, sni = windows + 1, max(hello, int(r.tls_client_hello)), max(sni, int(r.tls_has_sni))
        fwd, rev = max(fwd, _known(r.fwd_byte_count)), max(rev, _known(r.rev_byte_count))
        # Windows come in the order of their ends.
        ends = ends[bisect_left(ends, now - cfg.beacon.history_s * MICROS):] + [now]
        state[:] = now, windows, hello, sni, fwd, rev, ends
        return len(ends), now - ends[0], windows, hello, sni, fwd, rev

    def _pair_row(self, pair: list, r, met: set[str]) -> tuple:
        """``met`` holds the names known from earlier rows of this call, so each is looked up once:
        a name comes again in every window that overlaps its packet's."""
        cfg, now = self.cfg, int(r.window_end_us)
        if pair[0] is not None and now - pair[0] > cfg.exfil.idle_s * MICROS:
            pair[1:4] = 0, 0, 0
        pair[0], pair[3] = now, pair[3] + 1
        pair[1], pair[2] = max(pair[1], _known(r.fwd_byte_count)), max(pair[2], _known(r.rev_byte_count))
        if r.protocol == "UDP" and 53 in (r.src_port, r.dst_port):
            if pair[4] is not None and now - pair[4] > cfg.dns.idle_s * MICROS:
                self.names.clear()
                met.clear()
                pair[5:9] = 0, 0.0, 0, 0
            pair[4] = now
            for name in r.names:
                if name in met:
                    continue
                met.add(name)
                if not self.names.containsKey((name,)):
                    self.names.updateValue((name,), (1,))
                    bits = entropy_bits(name)
                    pair[5:9] = pair[5] + 1, pair[6] + bits, pair[7] + len(name), pair[8] + (bits > cfg.dns.min_entropy)
        return pair[1], pair[2], pair[3], pair[5], pair[6], pair[7], pair[8]

    def close(self) -> None:
        pass


def _is_dns() -> Column:
    return (F.col("protocol") == "UDP") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))


def with_history(flows: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Flow rows plus ``kind`` and ``HISTORY_COLUMNS``. Needs the RocksDB state store.

    Each flow row comes once as kind ``flow``, and once more as kind ``pair`` where a detector
    looks at its host pair; each has the history of its kind, the other is null.
    """
    pair = F.concat_ws(">", "src_ip", "dst_ip")
    bucket = F.pmod(F.xxhash64("flow_id"), F.lit(FLOW_BUCKETS)).cast("string")
    of_flow = F.struct(F.lit(FLOW).alias("kind"), bucket.alias("name"))
    of_pair = F.struct(F.lit(PAIR).alias("kind"), pair.alias("name"))
    both = F.when(_is_dns() | goes_outside(cfg.exfil), F.array(of_flow, of_pair)).otherwise(F.array(of_flow))
    rows = flows.withColumn("memory", F.explode(both)).select("*", "memory.kind", "memory.name").drop("memory")
    rows = rows.withColumn("names", F.when(F.col("kind") == PAIR, F.col("names")))
    fields = [f for f in rows.schema.fields if f.name not in ("names", "ts", "name")]
    out = T.StructType([*fields, *[T.StructField(n, t) for n, t in (*_FLOW_HISTORY, *_PAIR_HISTORY)]])
    return rows.groupBy("stream_id", "kind", "name").transformWithStateInPandas(
        Memory(cfg, [f.name for f in fields]), out, "Append", "EventTime"
    )


def judge(rows: DataFrame, cfg: DetectionConfig, scorer: Callable | None = None) -> DataFrame:
    """Fused results of one micro-batch of closed windows, errors of detectors among them."""
    rows, pairs = rows.filter(F.col("kind") == FLOW), rows.filter(F.col("kind") == PAIR)
    tls = rows.filter((F.col("protocol") == "TCP") & (F.col("dst_port") == cfg.tls.port))
    dns, out = pairs.filter(_is_dns()), pairs.filter(goes_outside(cfg.exfil))
    verdicts = [
        d.detect_ddos(rows.select(*FLOW_COLUMNS), cfg.ddos, scorer),
        judge_beacon(rows, cfg.beacon),
        judge_dns(dns.withColumnRenamed("name_count", "names"), cfg.dns),
        judge_tls(
            tls.drop("windows_seen").withColumnsRenamed(
                {"tls_windows": "windows_seen", "flow_fwd_max": "fwd_max", "flow_rev_max": "rev_max"}
            ),
            cfg.tls,
        ),
        d.detect_recon(rows.select(*FLOW_COLUMNS), cfg.recon),
        judge_exfil(out.withColumnsRenamed({"pair_fwd_max": "fwd_max", "pair_rev_max": "rev_max"}), cfg.exfil),
    ]
    return fuse(None, gather(verdicts, error_rows(rows.select(*FLOW_COLUMNS), NEEDS), DETECTORS), cfg.fusion, DETECTORS)


def start_detection(
    packets: DataFrame,
    window: WindowConfig,
    cfg: DetectionConfig,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    anchor_us: int = 0,
    delay_s: float | None = None,
    scorer: Callable | None = None,
    trigger: dict | None = None,
    on_errors: Callable[[DataFrame, int], None] | None = None,
):
    """Start the query; ``sink(alerts, batch_id)`` gets each micro-batch's live alerts.

    ``on_errors(results, batch_id)`` gets the results of flows that a detector could not judge.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = with_history(stream_flows(packets, window, anchor_us, delay_s), cfg)

    copy, results = fresh_path(spark, "stream-batch"), fresh_path(spark, "stream-results")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Written once: a cached batch is computed by all stages and broadcasts that read it at
        # the same time, and two tasks of one partition then commit the same state. The copy is
        # read in the caller's session, as the stream's own does without adaptive execution.
        batch.write.mode("overwrite").parquet(copy)
        fused = judge(spark.read.schema(batch.schema).parquet(copy), cfg, scorer)
        if on_errors is not None:
            # Written as well, so that the second sink does not judge the batch again.
            fused.write.mode("overwrite").parquet(results)
            fused = spark.read.schema(fused.schema).parquet(results)
        sink(live_alerts(fused), batch_id)
        if on_errors is not None:
            on_errors(fused.filter(F.col("status") == "error"), batch_id)

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Alerts as Parquet, one folder per micro-batch, so a repeated batch replaces itself."""

    def write(alerts: DataFrame, batch_id: int) -> None:
        alerts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
