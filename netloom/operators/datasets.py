"""Checks and summaries of labelled flow datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordering import with_position
from netloom.schema import FEATURES_16, LABELS

# Every feature except the duration counts as core.
CORE_FIELDS = [c for c in FEATURES_16 if c != "flow_duration"]
_BLOCK = 1_000_000


def label_counts(rows: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Rows per label, optionally per file or split."""
    return rows.groupBy(*(by or []), F.trim(F.col(label).cast("string")).alias(label)).agg(
        F.count(F.lit(1)).alias("rows")
    )


def label_dimension(spark) -> DataFrame:
    """The fixed label list, as a table."""
    pairs = F.array(
        *[F.struct(F.lit(v).alias("label"), F.lit(k).alias("label_name")) for k, v in LABELS.items()]
    )
    return spark.range(1).select(F.explode(pairs).alias("l")).select("l.*")


def label_summary(rows: DataFrame) -> DataFrame:
    """Rows per label of the fixed list; absent labels get 0."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return label_dimension(rows.sparkSession).join(counts, "label", "left").fillna(0, ["rows"])


def first_rows_per_label(rows: DataFrame, label: str = "original_label", order: str = "row_idx") -> DataFrame:
    """The first row of every label, by an order without ties.

    Only the first place of each label is aggregated, which hash tables can hold; rows are
    then looked up by it.
    """
    first = rows.groupBy(F.col(label).alias("_label")).agg(F.min(order).alias("_first"))
    return rows.join(first, F.col(label).eqNullSafe(F.col("_label")) & (F.col(order) == F.col("_first")), "left_semi")


def out_of_order(rows: DataFrame, time_us: str = "ts_us", order: str = "row_idx", by: list[str] | None = None) -> DataFrame:
    """Count of rows earlier than the row before them.

    The previous row is found inside blocks of consecutive row numbers; block borders are
    settled on one summary row per block.
    """
    by = by or []
    block = (F.col(order) - F.pmod(F.col(order), F.lit(_BLOCK))) / _BLOCK
    rows = rows.select(*by, time_us, order, block.cast("bigint").alias("_block"))
    prev = F.lag(time_us).over(Window.partitionBy(*by, "_block").orderBy(order))
    inside = rows.withColumn("_prev", prev)
    blocks = inside.groupBy(*by, "_block").agg(
        F.count_if(F.col(time_us) < F.col("_prev")).alias("_inside"),
        F.min_by(time_us, order).alias("_head"),
        F.max_by(time_us, order).alias("_tail"),
    )
    before = F.lag("_tail").over(Window.partitionBy(*by).orderBy("_block"))
    return (
        blocks.withColumn("_border", F.coalesce((F.col("_head") < before).cast("bigint"), F.lit(0)))
        .groupBy(*by)
        .agg((F.sum("_inside") + F.sum("_border")).alias("out_of_order_records"))
    )


def validation_summary(rows: DataFrame) -> DataFrame:
    """Totals of a labelled dataset: missing core features, bad times, order, time range."""
    rows = rows.withColumn("ts_us", F.unix_micros("ts")) if "ts_us" not in rows.columns else rows
    missing = F.lit(False)
    for c in CORE_FIELDS:
        missing = missing | F.col(c).isNull()
    valid = F.when(F.col("ts_us") >= 0, F.col("ts_us"))
    totals = rows.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(missing).alias("missing_core_features"),
        F.count_if(F.col("ts_us") < 0).alias("invalid_timestamps"),
        F.min(valid).alias("start_us"),
        F.max(valid).alias("end_us"),
    )
    return totals.join(out_of_order(rows, by=["dataset_name"]), "dataset_name")


def class_distribution(rows: DataFrame, label: str = "label", by: str = "split") -> DataFrame:
    """Rows and percentage per label within each split or chunk."""
    counts = rows.groupBy(by, label).agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy(by))
    return counts.withColumn("percent", share)


def temporal_chunks(rows: DataFrame, order: list[str], chunks: int = 10) -> DataFrame:
    """Add ``chunk``: equal consecutive pieces in order; the remainder is left out."""
    placed = with_position(rows, order)
    size = placed.count() // chunks
    if size == 0:
        return placed.withColumn("chunk", F.lit(0).cast("bigint")).filter(F.lit(False)).drop("position")
    return (
        placed.withColumn("chunk", F.expr(f"position div {size}L"))
        .filter(F.col("chunk") < chunks)
        .drop("position")
    )


def feature_variance(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Sample variance per feature, and whether the feature is constant or missing."""
    wide = rows.agg(*[F.var_samp(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").withColumn(
        "constant", F.coalesce(F.col("variance") == 0, F.lit(True))
    )


def dataset_inventory(raw: DataFrame, name: str, label: str | None, timestamp: str | None) -> DataFrame:
    """Rows per label value with the dataset's columns and time column presence."""
    label_col = F.col(f"`{label}`") if label in raw.columns else F.lit(None).cast("string")
    counts = raw.groupBy(label_col.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        F.lit(name).alias("dataset"), "label", "rows",
        F.lit(timestamp is not None and timestamp in raw.columns).alias("timestamp_column_present"),
        F.array(*[F.lit(c) for c in raw.columns]).alias("columns"),
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate training parts by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


