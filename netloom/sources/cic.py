"""CSE-CIC-IDS2018 flow CSV files (no addresses)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.columns import byte_ratio, parse_double, parse_int, per_second, safe_double, unidirectional
from netloom.schema import FEATURES_13
from netloom.sources.tabular import (
    as_labelled_flows, first_match, label_number, label_text, other_columns, read_numbered, text_or_null,
    training_table,
)

# The 28 columns the classifiers are trained on.
TRAINING_COLUMNS = [
    "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Mean", "Bwd Pkt Len Mean", "Flow Byts/s", "Flow Pkts/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Mean", "Fwd IAT Std", "Bwd IAT Mean", "Bwd IAT Std",
    "FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
    "Pkt Len Mean", "Pkt Len Std", "Down/Up Ratio", "Pkt Size Avg", "Active Mean", "Idle Mean",
]
MAPPED = {
    "Timestamp", "Label", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts",
    "TotLen Bwd Pkts", "Protocol",
}


def label_name(label: Column) -> Column:
    """BENIGN, DDOS for any denial of service, UNKNOWN for everything else."""
    text = F.lower(F.trim(label))
    return first_match(
        [(text == "benign", "BENIGN"), (text == "bot", "UNKNOWN"), (text.contains("dos"), "DDOS")], "UNKNOWN"
    )


def dos_label(label: Column) -> Column:
    """1 for denial of service, 0 for benign, null (row unused) otherwise."""
    text = F.lower(F.trim(label))
    return F.when(text.contains("dos"), 1).when(text == "benign", 0)


def bot_label(label: Column) -> Column:
    """1 for bot traffic, 0 for benign, null otherwise."""
    text = F.lower(F.trim(label))
    return F.when(text == "bot", 1).when(text == "benign", 0)


def read_cic(spark: SparkSession, path: str, dataset_name: str = "CIC-IDS2018") -> DataFrame:
    """Labelled flows. Rows whose timestamp does not parse are skipped but still counted."""
    return map_cic(read_numbered(spark, path), dataset_name)


def map_cic(raw: DataFrame, dataset_name: str = "CIC-IDS2018") -> DataFrame:
    ts = F.try_to_timestamp(text_or_null(raw, "Timestamp"), F.lit("d/M/yyyy H:m:s"))
    parsed = raw.withColumns(
        {
            "_ts": ts,
            "_label": label_text(raw),
            "_dur": parse_double(text_or_null(raw, "Flow Duration")) / 1e6,
            "_fp": parse_double(text_or_null(raw, "Tot Fwd Pkts")),
            "_rp": parse_double(text_or_null(raw, "Tot Bwd Pkts")),
            "_fb": parse_double(text_or_null(raw, "TotLen Fwd Pkts")),
            "_rb": parse_double(text_or_null(raw, "TotLen Bwd Pkts")),
            "_rest": other_columns(raw, MAPPED),
            "_proto": parse_int(text_or_null(raw, "Protocol")) if "Protocol" in raw.columns else F.lit(-1),
        }
    ).filter(F.col("_ts").isNotNull())
    # The four counters stand or fall together.
    all_there = F.col("_fp").isNotNull() & F.col("_rp").isNotNull() & F.col("_fb").isNotNull() & F.col("_rb").isNotNull()
    fp, rp, fb, rb = (F.when(all_there, F.col(c)) for c in ("_fp", "_rp", "_fb", "_rb"))
    dur, name = F.col("_dur"), label_name(F.col("_label"))
    return as_labelled_flows(
        parsed,
        {
            "row_idx": F.col("row_idx"),
            "ts": F.col("_ts"),
            "flow_id": F.concat(F.lit("cic_row_"), F.col("row_idx").cast("string")),
            "dataset_name": F.lit(dataset_name),
            "label": label_number(name),
            "label_name": name,
            "original_label": F.col("_label"),
            "flow_duration": dur,
            "fwd_packet_count": fp,
            "rev_packet_count": rp,
            "fwd_byte_count": fb,
            "rev_byte_count": rb,
            "fwd_bytes_per_sec": per_second(fb, dur),
            "rev_bytes_per_sec": per_second(rb, dur),
            "fwd_pkts_per_sec": per_second(fp, dur),
            "rev_pkts_per_sec": per_second(rp, dur),
            "byte_ratio": byte_ratio(fb, rb),
            "is_unidirectional": unidirectional(fb, rb),
            "is_tcp": (F.col("_proto") == 6).cast("double"),
            "is_udp": (F.col("_proto") == 17).cast("double"),
            "dataset_specific_features": F.col("_rest"),
        },
    )


def load_training(
    spark: SparkSession, path: str, label: Callable[[Column], Column] = dos_label,
    columns: list[str] = TRAINING_COLUMNS, max_rows: int | None = None,
) -> DataFrame:
    """The chosen columns as numbers, with a 0/1 label and the row number."""
    raw = read_numbered(spark, path)
    return training_table(raw, columns, label(label_text(raw)), max_rows)


def to_model_features(raw: DataFrame) -> DataFrame:
    """The 13 model inputs from this dataset's own aggregates.

    Differs from the live features on purpose: the byte ratio is the forward share
    (0.5 without bytes), direction shares split the total byte rate, and a flow is
    one-way when it has no reverse packets.
    """

    def number(name: str) -> Column:
        return safe_double(text_or_null(raw, name))

    base = raw.select(
        *(["row_idx"] if "row_idx" in raw.columns else []),
        F.greatest(number("Flow Duration"), F.lit(0.0)).alias("us"),
        number("Tot Fwd Pkts").alias("fp"), number("Tot Bwd Pkts").alias("rp"),
        number("TotLen Fwd Pkts").alias("fb"), number("TotLen Bwd Pkts").alias("rb"),
        number("Flow Byts/s").alias("bps"), number("Fwd Pkts/s").alias("fpps"), number("Bwd Pkts/s").alias("rpps"),
        F.floor(number("Protocol")).alias("proto"), label_text(raw).alias("original_label"),
    ).withColumns({"dur": F.col("us") / 1e6, "bytes": F.col("fb") + F.col("rb")})
    zero, dur, total = F.lit(0.0), F.col("dur"), F.col("bytes")

    def share(part: str) -> Column:
        return F.when(total > 0, F.col("bps") * F.col(part) / total).otherwise(zero)

    def packet_rate(given: str, count: str) -> Column:
        return F.when(F.col(given) > 0, F.col(given)).when(dur > 0, F.col(count) / dur).otherwise(zero)

    made = {
        "flow_duration": dur,
        "fwd_packet_count": F.col("fp"), "rev_packet_count": F.col("rp"),
        "fwd_byte_count": F.col("fb"), "rev_byte_count": F.col("rb"),
        "fwd_bytes_per_sec": share("fb"), "rev_bytes_per_sec": share("rb"),
        "fwd_pkts_per_sec": packet_rate("fpps", "fp"), "rev_pkts_per_sec": packet_rate("rpps", "rp"),
        "byte_ratio": F.when(total > 0, F.col("fb") / total).otherwise(F.lit(0.5)),
        "is_unidirectional": (F.col("rp") == 0).cast("double"),
        "is_tcp": (F.col("proto") == 6).cast("double"), "is_udp": (F.col("proto") == 17).cast("double"),
    }
    ids = ["row_idx"] if "row_idx" in raw.columns else []
    return base.select(*ids, "original_label", *[made[n].alias(n) for n in FEATURES_13])


def load_model_training(spark: SparkSession, path: str, label: Callable[[Column], Column] = dos_label) -> DataFrame:
    made = to_model_features(read_numbered(spark, path)).withColumn("label", label(F.col("original_label")))
    return made.filter(F.col("label").isNotNull())
