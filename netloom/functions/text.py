"""Text measures for rows whose texts may be long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.columns import characters


def entropy_by_row(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of ``text`` per ``key``.

    Character counts are combined before the shuffle, so a text of any length sends one
    row per distinct character.
    """
    chars = rows.select(key, F.explode_outer(characters(F.col(text))).alias("ch"))
    counts = chars.groupBy(key, "ch").agg(F.count("ch").alias("n"))
    # H = log2(N) - sum(n * log2 n) / N
    n = F.col("n").cast("double")
    sums = counts.groupBy(key).agg(
        F.sum(n).alias("total"), F.sum(F.when(n > 0, n * F.log2(n))).alias("weighted")
    )
    bits = F.log2("total") - F.col("weighted") / F.col("total")
    return sums.select(key, F.when(F.col("total") > 0, bits).otherwise(F.lit(0.0)).alias("entropy"))
