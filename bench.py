"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Results are computed in full
and discarded (``noop`` sink). ``replayed_alerts`` repeats the packets, later each time,
with default thresholds and 5 s windows, to show throughput away from fixed costs.
"""

from __future__ import annotations

import json
import os
import time

from netloom.config import WindowConfig
from netloom.operators.prepare import replay
from netloom.plans import queries as registered
from netloom.plans.detection import detect
from netloom.session import build_session, materialize
from netloom.sources.driver_tables import driver_packets

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOOPS = int(os.environ.get("BENCH_LOOPS", "10"))
HEADLINE = [
    "packet_filter", "protocol_distribution", "traffic_bins", "late_drop", "window_totals", "flow_build", "flow_iat",
    "features16", "src_fanout", "dst_concentration", "detect_ddos", "detect_c2", "detect_dns", "detect_tls",
    "detect_recon", "detect_exfil", "fused", "alerts", "alert_dedup", "host_rollup", "split_chronological",
    "split_stratified", "scale_standard", "scale_robust", "entropy",
]


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo, packets = registered.queries(), driver_packets(spark, SF_DIR)
    n = packets.count()
    timed(lambda: todo["window_totals"](spark, SF_DIR))  # start-up costs of the JVM
    times = {name: timed(lambda name=name: todo[name](spark, SF_DIR)) for name in HEADLINE}
    many = materialize(replay(packets, LOOPS), "replayed")
    times["replayed_alerts"] = timed(
        lambda: detect(many, WindowConfig(5, 1)).alerts()
    )
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "packets": n,
                "alerts_packets_per_sec": round(n / times["alerts"], 1),
                "replayed_packets": n * LOOPS,
                "replayed_packets_per_sec": round(n * LOOPS / times["replayed_alerts"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
