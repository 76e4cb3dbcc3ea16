"""CIC-Bell-DNS-EXF-2021: CSV files whose label is the folder they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.sources.tabular import read_text_table, training_table

# The 17 columns used for training.
TRAINING_COLUMNS = [
    "A_frequency", "NS_frequency", "CNAME_frequency", "PTR_frequency", "MX_frequency", "TXT_frequency",
    "AAAA_frequency", "OPT_frequency", "rr_count", "rr_name_entropy", "rr_name_length",
    "distinct_ns", "distinct_ip", "distinct_domains", "unique_ttl", "ttl_mean", "ttl_variance",
]


def load_directory(spark: SparkSession, path: str, label: int, columns: list[str] = TRAINING_COLUMNS) -> DataFrame:
    """All CSV files below ``path``, every row with the same label."""
    raw = read_text_table(spark, path, "*.csv", recursive=True)
    return training_table(raw, columns, F.lit(label))
