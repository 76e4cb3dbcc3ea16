"""Shared parts of the labelled-flow CSV readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.columns import safe_double
from netloom.schema import LABELLED_FLOW_SCHEMA, LABELS
from netloom.session import materialize

_POSITION = ("_file", "_block", "_row")


def read_text_table(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """CSV with a header: every column a string, header names trimmed."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(c.strip("﻿ \t")) for c in raw.columns])


def read_numbered(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``read_text_table`` plus ``row_idx``: each file's rows numbered from 0, in file order.

    Rows keep their order inside a file split. Splits are counted first (one row per
    split), so numbering needs no sort and no shuffle of the rows.
    """
    reader = spark.read.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(path)
    names = {c: c.strip("﻿ \t") for c in raw.columns}
    rows = raw.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")),
        "splits",
    )
    return (
        rows.join(starts, ["_file", "_block"])
        .withColumn("row_idx", F.col("_base") + F.col("_row") - F.col("_first"))
        .drop(*_POSITION, "_first", "_base")
    )


def text_or_null(df: DataFrame, name: str) -> Column:
    """A column by its literal name (dots and slashes included); null if absent."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def label_text(df: DataFrame, name: str = "Label") -> Column:
    if name not in df.columns:
        return F.lit("UNKNOWN")
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))


def label_number(label_name: Column) -> Column:
    pairs = [F.lit(x) for item in LABELS.items() for x in item]
    return F.element_at(F.create_map(*pairs), label_name)


def other_columns(df: DataFrame, used: set[str]) -> Column:
    """All columns that were not mapped, as a string map."""
    rest = [c for c in df.columns if c not in used and c != "row_idx"]
    if not rest:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`") for c in rest])
    )


def as_labelled_flows(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Project to the labelled-flow schema; fields without a value are null."""
    return rows.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LABELLED_FLOW_SCHEMA.fields
        ]
    )


def training_table(
    raw: DataFrame, columns: list[str], label: Column, max_rows: int | None = None
) -> DataFrame:
    """Chosen columns as safe doubles (absent ones 0.0) with a 0/1 label; null labels drop.

    ``max_rows`` bounds the rows of a fit: the first labelled rows in file order stay.
    """
    if max_rows is not None and "row_idx" not in raw.columns:
        raise ValueError("max_rows needs numbered rows")
    made = raw.withColumn("label", label).filter(F.col("label").isNotNull())
    out = made.select(
        *[
            (safe_double(F.col(f"`{c}`")) if c in raw.columns else F.lit(0.0)).alias(c)
            for c in columns
        ],
        F.col("label").cast("int").alias("label"),
        *(["row_idx"] if "row_idx" in raw.columns else []),
    )
    return out.orderBy("row_idx").limit(max_rows) if max_rows is not None else out


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(default))
