"""Threat detectors: each maps flow rows to verdict rows."""

from netloom.operators.detectors.base import Detector, status_rows
from netloom.operators.detectors.beacon import detect_beacon
from netloom.operators.detectors.ddos import detect_ddos
from netloom.operators.detectors.dns import detect_dns
from netloom.operators.detectors.exfil import detect_exfil
from netloom.operators.detectors.recon import detect_recon
from netloom.operators.detectors.tls import detect_tls

__all__ = [
    "Detector", "status_rows", "detect_beacon", "detect_ddos", "detect_dns",
    "detect_exfil", "detect_recon", "detect_tls",
]
