"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("dns_query_name", T.StringType()),
        T.StructField("dns_query_type", T.IntegerType()),
        T.StructField("dns_response_code", T.IntegerType()),
        T.StructField("tls_version", T.IntegerType()),
        T.StructField("tls_is_client_hello", T.BooleanType()),
        T.StructField("tls_sni", T.StringType()),
        T.StructField("tls_cipher_suites_count", T.IntegerType()),
        T.StructField("tls_extensions_count", T.IntegerType()),
    ]
)

# The model's inputs, in the order the model expects them.
FEATURES_13 = [
    "flow_duration",
    "fwd_packet_count",
    "rev_packet_count",
    "fwd_byte_count",
    "rev_byte_count",
    "fwd_bytes_per_sec",
    "rev_bytes_per_sec",
    "fwd_pkts_per_sec",
    "rev_pkts_per_sec",
    "byte_ratio",
    "is_unidirectional",
    "is_tcp",
    "is_udp",
]
CONTEXT_FEATURES = ["src_ip_flow_count", "src_ip_unique_dst_ips", "src_ip_unique_dst_ports"]
FEATURES_16 = FEATURES_13[:11] + CONTEXT_FEATURES + FEATURES_13[11:]

# Label numbers of the labelled datasets.
LABELS = {
    "UNKNOWN": -1,
    "BENIGN": 0,
    "DDOS": 1,
    "C2_BEACONING": 2,
    "DGA_DNS_TUNNEL": 3,
    "ENCRYPTED_MALWARE": 4,
    "RECON": 5,
    "EXFILTRATION": 6,
}

LABELLED_FLOW_SCHEMA = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("flow_id", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("scenario_id", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("mitre_stage", T.StringType()),
        T.StructField("original_label", T.StringType()),
    ]
    + [T.StructField(n, T.DoubleType()) for n in FEATURES_16]
    + [T.StructField("dataset_specific_features", T.MapType(T.StringType(), T.StringType()))]
)

# One detector's outcome for one flow in one window.
RESULT_TYPE = T.StructType(
    [
        T.StructField("detector", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error_message", T.StringType()),
    ]
)

# Detector names, in the order their verdicts are combined.
DETECTORS = [
    "DDoSDetector",
    "C2BeaconingDetector",
    "DNSTunnelDetector",
    "EncryptedMalwareDetector",
    "ReconnaissanceDetector",
    "ExfiltrationDetector",
]
