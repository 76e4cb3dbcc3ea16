"""The whole path from packets to alerts, as one set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from netloom.config import DetectionConfig, WindowConfig
from netloom.operators import detectors as d
from netloom.operators.alerts import to_alerts
from netloom.operators.detectors.base import error_rows
from netloom.operators.flows import build_flows, dns_queries
from netloom.operators.fusion import fuse, gather
from netloom.operators.grid import on_grid
from netloom.operators.prepare import scope_filter, with_time_us
from netloom.schema import DETECTORS
from netloom.session import materialize

_BYTES = ["byte_count", "fwd_byte_count", "rev_byte_count"]
#: What each detector computes with; packets without a length, or a negative one, leave it open.
NEEDS = {
    "DDoSDetector": _BYTES, "C2BeaconingDetector": _BYTES, "EncryptedMalwareDetector": _BYTES, "ExfiltrationDetector": _BYTES,
}


@dataclass(frozen=True)
class Detection:
    flows: DataFrame
    gathered: DataFrame
    cfg: DetectionConfig
    names: list

    def fused(self) -> DataFrame:
        """One result per flow window, benign ones included."""
        return fuse(self.flows, self.gathered, self.cfg.fusion, self.names)

    def fused_verdicts(self) -> DataFrame:
        """Results of flow windows with a verdict only; flows are not shuffled for it."""
        return fuse(None, self.gathered, self.cfg.fusion, self.names)

    def alerts(self) -> DataFrame:
        return to_alerts(self.fused_verdicts())


def verdicts(
    packets: DataFrame,
    flows: DataFrame,
    window: WindowConfig,
    cfg: DetectionConfig,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> list[DataFrame]:
    """Verdict rows of the six detectors, in the order they are combined."""
    named = flows.filter("protocol = 'UDP' AND dns_query_count > 0")
    queries = materialize(dns_queries(packets, named, window), "dns-names")
    return [
        d.detect_ddos(flows, cfg.ddos, scorer),
        d.detect_beacon(flows, cfg.beacon),
        d.detect_dns(flows, queries, cfg.dns),
        d.detect_tls(flows, cfg.tls),
        d.detect_recon(flows, cfg.recon),
        d.detect_exfil(flows, cfg.exfil),
    ]


def detect(
    packets: DataFrame,
    window: WindowConfig = WindowConfig(),
    cfg: DetectionConfig = DetectionConfig(),
    anchor_us: int | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    custom: dict[str, d.Detector] | None = None,
    scope: bool = True,
) -> Detection:
    """Run all detectors over packets.

    Flows are written once to the shared folder: six detectors read them, each with its
    own columns and filter. So are the verdicts, which are few, for the reports on them.
    ``custom`` adds detectors by name, after the built-in ones. A flow whose numbers a
    detector needs and cannot read gets an error of that detector; the run goes on.
    """
    packets = scope_filter(packets) if scope else packets
    packets = on_grid(with_time_us(packets), window, anchor_us)
    flows = materialize(build_flows(packets, window), "flows")
    found = verdicts(packets, flows, window, cfg, scorer)
    custom = custom or {}
    found += [make(flows) for make in custom.values()]
    names = [*DETECTORS, *custom]
    return Detection(flows, materialize(gather(found, error_rows(flows, NEEDS), names), "verdicts"), cfg, names)
