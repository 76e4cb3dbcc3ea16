"""Positions in a global order without a single-task window.

Rows are range-partitioned and sorted once, and written with their place inside the
partition. Per-partition totals (one row per partition) give each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import materialize

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Add ``name``: the row's 0-based place in the order, which must have no ties."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "ordered")
    part = F.shiftright("_id", _SHIFT)
    place = F.col("_id").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets"
    )
    return (
        placed.withColumns({"_part": part, "_place": place})
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_id", "_part", "_place", "_offset")
    )


def with_running_total(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before this one in the order."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "ordered").withColumn("_part", F.shiftright("_id", _SHIFT))
    sizes = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets"
    )
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_id", "_part", "_inside", "_offset")
    )


def exact_quantiles(df: DataFrame, cols: list[str], quantiles: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(name, q, value)``.

    Equal values are counted before any shuffle; ranks come from running totals.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    )
    counts = (
        df.select(pairs.alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_running_total(counts, ["name", "value"], "n", "before")
    bounds = ranked.groupBy("name").agg(
        F.min("before").alias("base"), F.sum("n").alias("total")
    )
    ranked = ranked.join(materialize(bounds, "bounds"), "name").withColumn("lo", F.col("before") - F.col("base"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    hits = (
        ranked.withColumn("q", wanted)
        .withColumn("at", F.col("q") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    )
    return hits.groupBy("name", "q").agg(
        (F.min("value") + (F.max("value") - F.min("value")) * (F.first("at") - F.floor(F.first("at")))).alias(
            "value"
        )
    )


def order_statistics(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with, per share p, the value at place ``int(n * p)`` of the sorted values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_running_total(counts, [value], "n", "before")
    total = ranked.agg(F.sum("n").alias("n")).first()["n"] or 0
    ends = F.col("before") + F.col("n")
    return ranked.agg(
        F.lit(total).cast("bigint").alias("n"),
        *[
            F.max(F.when((F.col("before") <= int(total * p)) & (ends > int(total * p)), F.col(value))).alias(name)
            for name, p in shares.items()
        ],
    )
