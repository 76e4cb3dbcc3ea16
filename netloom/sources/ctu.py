"""CTU-13 ``.binetflow`` files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.columns import byte_ratio, parse_double, parse_int, per_second, unidirectional
from netloom.sources.tabular import (
    as_labelled_flows, first_match, label_number, label_text, other_columns, read_numbered, text_or_null,
    training_table,
)

# Columns used for training, and columns with a place in the flow schema.
TRAINING_COLUMNS = ["Dur", "TotPkts", "TotBytes", "SrcBytes"]
MAPPED = {"StartTime", "Dur", "TotBytes", "SrcBytes", "Proto", "SrcAddr", "DstAddr", "Sport", "Dport", "Label"}


def label_name(label: Column) -> Column:
    """Background and normal are BENIGN; botnet flows by what their label says."""
    text = F.lower(label)

    def any_of(*words: str) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | text.contains(w)
        return cond

    return first_match(
        [
            (any_of("background", "normal"), "BENIGN"),
            (~text.contains("botnet"), "UNKNOWN"),
            (any_of("cc", "c&c", "beacon"), "C2_BEACONING"),
            (any_of("dos"), "DDOS"),
            (any_of("scan"), "RECON"),
        ],
        "UNKNOWN",
    )


def botnet_label(label: Column) -> Column:
    """1 for botnet, 0 for background or normal, null otherwise."""
    text = F.lower(label)
    return F.when(text.contains("botnet"), 1).when(text.contains("background") | text.contains("normal"), 0)


def read_ctu(spark: SparkSession, path: str, dataset_name: str = "CTU-13", glob: str | None = None) -> DataFrame:
    """Labelled flows. Rows whose start time does not parse are skipped but still counted."""
    return map_ctu(read_numbered(spark, path, glob), dataset_name)


def map_ctu(raw: DataFrame, dataset_name: str = "CTU-13") -> DataFrame:
    text = text_or_null(raw, "StartTime")
    whole = text.rlike(r"\.\d{1,6}$")
    # Pad the fraction: the format asks for one to six digits.
    padded = F.rpad(F.regexp_extract(text, r"\.(\d{1,6})$", 1), 6, "0")
    head = F.regexp_extract(text, r"^(.*)\.\d{1,6}$", 1)
    stamp = F.try_to_timestamp(F.concat(head, F.lit("."), padded), F.lit("y/M/d H:m:s.SSSSSS"))
    parsed = raw.withColumns(
        {
            "_ts": F.when(whole, stamp),
            "_label": label_text(raw),
            "_dur": parse_double(text_or_null(raw, "Dur")),
            "_total": parse_double(text_or_null(raw, "TotBytes")),
            "_src": parse_double(text_or_null(raw, "SrcBytes")),
            "_proto": F.nullif(F.lower(F.trim(text_or_null(raw, "Proto"))), F.lit("")),
            "_rest": other_columns(raw, MAPPED),
        }
    ).filter(F.col("_ts").isNotNull())
    fb = F.when(F.col("_total").isNotNull(), F.col("_src"))
    rb = F.col("_total") - F.col("_src")
    dur, proto, name = F.col("_dur"), F.col("_proto"), label_name(F.col("_label"))
    src, dst = (F.coalesce(text_or_null(raw, c), F.lit("")) for c in ("SrcAddr", "DstAddr"))
    return as_labelled_flows(
        parsed,
        {
            "row_idx": F.col("row_idx"),
            "ts": F.col("_ts"),
            "flow_id": F.concat(F.lit("ctu_row_"), F.col("row_idx").cast("string"), F.lit("_"), src, F.lit("_"), dst),
            "dataset_name": F.lit(dataset_name),
            "src_ip": src,
            "dst_ip": dst,
            "src_port": parse_int(text_or_null(raw, "Sport")),
            "dst_port": parse_int(text_or_null(raw, "Dport")),
            "protocol": proto,
            "label": label_number(name),
            "label_name": name,
            "original_label": F.col("_label"),
            "flow_duration": dur,
            "fwd_byte_count": fb,
            "rev_byte_count": rb,
            "fwd_bytes_per_sec": per_second(fb, dur),
            "rev_bytes_per_sec": per_second(rb, dur),
            "byte_ratio": byte_ratio(fb, rb),
            "is_unidirectional": unidirectional(fb, rb),
            "is_tcp": (proto == "tcp").cast("double"),
            "is_udp": (proto == "udp").cast("double"),
            "dataset_specific_features": F.col("_rest"),
        },
    )


def load_training(
    spark: SparkSession, path: str, label: Callable[[Column], Column] = botnet_label,
    columns: list[str] = TRAINING_COLUMNS, glob: str | None = None,
) -> DataFrame:
    raw = read_numbered(spark, path, glob)
    return training_table(raw, columns, label(label_text(raw)))
