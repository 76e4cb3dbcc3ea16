"""Parameters of the windowing and of each detector, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import gcd

MICROS = 1_000_000


@dataclass(frozen=True)
class WindowConfig:
    """Closed sliding windows ``[end - window, end]``, one every ``slide``.

    With a slide longer than the window, packets between two windows are in none. From
    two windows on the rules restart the grid before any window ends, and close to that
    every packet may restart it; slides above 1.75 windows are rejected. (The limit is one
    window where the window is not a multiple of four microseconds.)
    ``chunk_windows`` bounds how much of one flow a single task sees: flow state
    is built per (flow, chunk) and a chunk covers that many window lengths. A flow with more
    than ``split_packets`` packets in a chunk is built in blocks of so many arrivals.
    """

    window_s: float = 10.0
    slide_s: float = 1.0
    chunk_windows: int = 6
    split_packets: int = 1_000_000

    def __post_init__(self) -> None:
        if self.window_s <= 0 or self.slide_s <= 0:
            raise ValueError("window_s and slide_s must be positive")
        if 4 * self.slide_us > (4 if self.window_us % 4 else 7) * self.window_us:
            raise ValueError("slide_s must not exceed 1.75 windows")
        if self.split_packets < 1:
            raise ValueError("split_packets must be at least 1")

    @property
    def window_us(self) -> int:
        return round(self.window_s * MICROS)

    @property
    def slide_us(self) -> int:
        return round(self.slide_s * MICROS)

    @property
    def pane_us(self) -> int:
        """Widest step that divides both the window and the slide."""
        return gcd(self.window_us, self.slide_us)

    @property
    def chunk_slides(self) -> int:
        """Window ends per chunk."""
        return max(1, self.chunk_windows * self.window_us // self.slide_us)


@dataclass(frozen=True)
class DdosConfig:
    high_rate_pps: float = 1000.0
    flows_to_dst: int = 50
    sources_to_dst: int = 20
    burst_packets: int = 2000
    burst_min_flows: int = 5
    max_service_port: int = 10000
    min_signals: int = 3


# Ports and resolvers that are never treated as command channels.
INFRA_PORTS = (53, 67, 68, 123, 137, 138, 161, 162, 389, 636, 5353)
INFRA_IPS = ("8.8.8.8", "8.8.4.4", "1.1.1.1")


@dataclass(frozen=True)
class BeaconConfig:
    min_packets: int = 4
    max_cv: float = 0.1
    history_s: float = 300.0
    min_windows: int = 10
    min_span_s: float = 60.0
    max_mean_packet: float = 300.0
    min_confidence: float = 0.75
    infra_ports: tuple = INFRA_PORTS
    infra_ips: tuple = INFRA_IPS


@dataclass(frozen=True)
class DnsConfig:
    min_entropy: float = 4.0
    min_queries: int = 15
    min_mean_length: float = 20.0
    min_high_share: float = 0.5
    min_signals: int = 2
    idle_s: float = 120.0


@dataclass(frozen=True)
class TlsConfig:
    port: int = 443
    min_windows: int = 2
    confidence: float = 0.85
    idle_s: float = 300.0


@dataclass(frozen=True)
class ReconConfig:
    port_fanout: int = 50
    ip_fanout: int = 20
    max_ips_for_port_scan: int = 10
    max_ports_for_ip_scan: int = 5


@dataclass(frozen=True)
class ExfilConfig:
    min_bytes: int = 1_000_000
    min_ratio: float = 10.0
    min_windows: int = 2
    idle_s: float = 300.0
    internal_prefixes: tuple = ("10.", "192.168.", "172.")


# Ranks used to pick one verdict among several.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
THREAT_PRIORITY = {
    "DDoS": 100,
    "DATA_EXFILTRATION": 90,
    "RECONNAISSANCE": 80,
    "C2_BEACONING": 70,
    "DNS_DGA_TUNNEL": 60,
    "ENCRYPTED_MALWARE": 50,
}


@dataclass(frozen=True)
class FusionConfig:
    severity_rank: dict = field(default_factory=lambda: dict(SEVERITY_RANK))
    threat_priority: dict = field(default_factory=lambda: dict(THREAT_PRIORITY))
    tie: float = 0.02


@dataclass(frozen=True)
class DetectionConfig:
    ddos: DdosConfig = DdosConfig()
    beacon: BeaconConfig = BeaconConfig()
    dns: DnsConfig = DnsConfig()
    tls: TlsConfig = TlsConfig()
    recon: ReconConfig = ReconConfig()
    exfil: ExfilConfig = ExfilConfig()
    fusion: FusionConfig = field(default_factory=FusionConfig)
