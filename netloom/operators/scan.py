"""Running values over long keys, block by block.

A window over a whole stream would put the stream into one task. Positions are cut into
blocks of ``BLOCK`` and blocks into super-blocks of ``BLOCK``; values run within a block,
block totals within a super-block, and only super-block totals (one row for sixteen million
positions) run over the stream. All three steps are shuffles on keys that hold a bounded
number of positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12
BLOCK = 1 << BITS


def _joined(a: Column, b: Column, op: str) -> Column:
    if op == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if op == "min" else F.greatest(a, b)  # null only where both are


def before_blocks(totals: DataFrame, keys: list[str], op: str) -> DataFrame:
    """(keys, block, ``before``): the ``op`` of ``total`` over all earlier blocks of each key."""
    fold: Callable = getattr(F, op)
    totals = totals.withColumn("_super", F.shiftright("block", BITS))
    earlier = lambda *part: Window.partitionBy(*keys, *part)
    rows_before = (Window.unboundedPreceding, -1)
    supers = totals.groupBy(*keys, "_super").agg(fold("total").alias("_total"))
    # One row for BLOCK * BLOCK positions.
    supers = supers.withColumn("_far", fold("_total").over(earlier().orderBy("_super").rowsBetween(*rows_before)))
    near = totals.withColumn("_near", fold("total").over(earlier("_super").orderBy("block").rowsBetween(*rows_before)))
    return near.join(supers.drop("_total"), [*keys, "_super"]).select(
        *keys, "block", _joined(F.col("_far"), F.col("_near"), op).alias("before")
    )


def running(values: DataFrame, queries: DataFrame, keys: list[str], op: str) -> DataFrame:
    """``queries`` with ``found``: the ``op`` of ``value`` over all ``values`` of its keys at ``pos`` or before.

    ``values``: keys, pos, value. ``queries``: keys, pos and other columns.
    """
    others = [c for c in queries.columns if c not in (*keys, "pos")]
    payload = F.struct(*others).alias("_query") if others else F.lit(True).alias("_query")
    asked = queries.select(*keys, "pos", F.lit(None).cast(values.schema["value"].dataType).alias("value"), payload)
    rows = values.select(*keys, "pos", "value").unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("block", F.shiftright("pos", BITS))
    fold: Callable = getattr(F, op)
    # At one position values come before queries.
    order = Window.partitionBy(*keys, "block").orderBy("pos", F.col("_query").isNotNull())
    inside = rows.withColumn("_inside", fold("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*keys, "block").agg(fold("value").alias("total"))
    return (
        inside.filter(F.col("_query").isNotNull()).join(before_blocks(totals, keys, op), [*keys, "block"])
        .select(
            *keys, "pos", *(F.col("_query").getField(c).alias(c) for c in others),
            _joined(F.col("before"), F.col("_inside"), op).alias("found"),
        )
    )


def with_halo(rows: DataFrame, pos: str, reach: int) -> DataFrame:
    """``rows`` with ``block``, each copied to every block that holds a position within ``reach``.

    In a window over (keys, block) the rows of ``own`` blocks then see all neighbours within
    ``reach``; keep those only afterwards.
    """
    first, last = F.shiftright(F.col(pos) - reach, BITS), F.shiftright(F.col(pos) + reach, BITS)
    return rows.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "own", F.col("block") == F.shiftright(pos, BITS)
    )
