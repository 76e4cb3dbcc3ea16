"""Train/validation/test splits.

Cuts are exact counts. Positions come from ``ordering.with_position``, so neither the
whole table nor one class is ever sorted in one task. A random order is not sorted at all:
rows are counted by the first digits of their hash, and only those that share the digits
of a cut are put in order (:func:`_cut_shuffled`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordering import with_position
from netloom.session import materialize

#: Rows are counted by so many leading hex digits of their hash.
_DIGITS = 4


def _share(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(share))


def _cut(position: Column, n: Column, train: float, val: float) -> Column:
    first = _share(n, train)
    second = first + _share(n, val)
    return F.when(position < first, "train").when(position < second, "val").otherwise("test")


def shuffle_key(key: str, seed: int) -> Column:
    """Reproducible random order that SQL engines agree on."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split_ordered(rows: DataFrame, order: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """First ``train`` share of the order, then ``val``, then the rest; for a time order
    this is the chronological split, for a row number the row-order split."""
    placed = with_position(rows, order, "_pos")
    n = F.lit(placed.count())
    return placed.withColumn("split", _cut(F.col("_pos"), n, train, val)).drop("_pos")


def _within_class(rows: DataFrame, label: str, order: list) -> DataFrame:
    placed = with_position(rows, [label, *order], "_pos")
    sizes = placed.groupBy(label).agg(F.min("_pos").alias("_base"), F.count(F.lit(1)).alias("_n"))
    return placed.join(materialize(sizes, "class-sizes"), label).withColumn(
        "_pos", F.col("_pos") - F.col("_base")
    )


def split_per_class(
    rows: DataFrame, label: str, order: list[str], train: float = 0.6, val: float = 0.2
) -> DataFrame:
    """Cut every class by row order."""
    placed = _within_class(rows, label, order)
    return placed.withColumn("split", _cut(F.col("_pos"), F.col("_n"), train, val)).drop(
        "_pos", "_base", "_n"
    )


def _cut_shuffled(rows: DataFrame, group: str, key: str, seed: int, cuts: list[Callable[[Column], Column]]) -> DataFrame:
    """Add ``_past``: how many of the group's cuts lie at or before the row's place in the random order.

    Each of ``cuts`` gives a place from the group's size. Rows are read several times: pass a
    written table. Rows of a null group are left out.
    """
    hashed = rows.filter(F.col(group).isNotNull()).withColumn("_r", shuffle_key(key, seed))
    hashed = hashed.withColumn("_bucket", F.coalesce(F.substring("_r", 1, _DIGITS), F.lit("")))
    counts = hashed.groupBy(F.col(group).alias("_g"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_g")
    before = F.sum("_n").over(own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = counts.withColumns({"_before": before, "_size": F.sum("_n").over(own)})
    # The bucket that holds a cut; none does where the cut lies past the last row.
    held = {}
    for k, cut in enumerate(cuts):
        at = cut(F.col("_size"))
        here = F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.struct("_bucket", "_before"))
        held[f"_cut{k}"], held[f"_at{k}"] = F.max(here), F.first(at)
    places = materialize(counts.groupBy("_g").agg(*[c.alias(n) for n, c in held.items()]), "cuts")
    hashed = hashed.join(F.broadcast(places), F.col(group) == F.col("_g")).drop("_g")
    split = F.lit(False)
    for k in range(len(cuts)):
        split = split | F.coalesce(F.col("_bucket") == F.col(f"_cut{k}._bucket"), F.lit(False))

    def past(on_cut: Callable[[int], Column]) -> Column:
        found = F.lit(0)
        for k in range(len(cuts)):
            bucket = F.col(f"_cut{k}._bucket")
            found = found + F.when(F.col("_bucket") > bucket, 1).when(F.col("_bucket") == bucket, on_cut(k)).otherwise(0)
        return found

    extra = ["_r", "_bucket", *held]
    whole = hashed.filter(~split).withColumn("_past", past(lambda k: F.lit(0)))
    ranked = with_position(hashed.filter(split), [group, "_r", key], "_pos")
    first = materialize(
        ranked.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.min("_pos").alias("_base")), "cut-buckets"
    )
    ranked = ranked.join(F.broadcast(first), (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_past", past(
        lambda k: (F.col("_pos") - F.col("_base") + F.col(f"_cut{k}._before") >= F.col(f"_at{k}")).cast("int")
    ))
    return whole.drop(*extra).unionByName(ranked.drop(*extra, "_pos", "_base", "_g", "_b"))


def split_stratified(
    rows: DataFrame, label: str, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Cut every class in a reproducible random order, so classes keep their shares."""
    rows = materialize(rows, "to-split")
    cuts = [lambda n: _share(n, train), lambda n: _share(n, train) + _share(n, val)]
    placed = _cut_shuffled(rows, label, key, seed, cuts)
    names = F.when(F.col("_past") == 0, "train").when(F.col("_past") == 1, "val").otherwise("test")
    return placed.withColumn("split", names).drop("_past")


def split_holdout(
    rows: DataFrame,
    holdout: str,
    original_label: str = "original_label",
    label: str = "label",
    key: str = "flow_id",
    benign_test: float = 0.2,
    val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Hold out one scenario for testing, plus a share of benign rows; split the rest."""
    held = F.lower(original_label).contains(holdout.lower())
    group = F.when(held, 2).when(F.col(label) == 0, 0).otherwise(1)
    tagged = materialize(rows.withColumn("_group", group), "to-split")

    def last(share: float) -> Callable[[Column], Column]:
        return lambda n: n - F.ceil(n * F.lit(share))

    placed = _cut_shuffled(tagged, "_group", key, seed, [last(benign_test)])
    in_test = (F.col("_group") == 2) | ((F.col("_group") == 0) & (F.col("_past") == 1))
    test = placed.filter(in_test).withColumn("split", F.lit("test"))
    rest = placed.filter(~in_test).drop("_past").withColumn("_all", F.lit(0))
    rest = _cut_shuffled(rest, "_all", key, seed + 1, [last(val)])
    rest = rest.withColumn("split", F.when(F.col("_past") == 0, "train").otherwise("val"))
    return rest.drop("_all", "_group", "_past").unionByName(test.drop("_group", "_past"))


def split_by_file(
    rows: DataFrame, file: str, roles: dict[str, str], order: list[str], cut: list[str] = (), train: float = 0.8
) -> DataFrame:
    """Whole files (or scenarios) to splits by ``roles``; each file of ``cut`` by row order,
    its first ``train`` share to 'train', the rest to 'val'. Rows of other files are left out."""
    pairs = [F.lit(x) for pair in roles.items() for x in pair]
    named = F.try_element_at(F.create_map(*pairs), F.col(file)) if pairs else F.lit(None).cast("string")
    whole = rows.withColumn("split", named).filter(F.col("split").isNotNull())
    if not cut:
        return whole
    placed = _within_class(rows.filter(F.col(file).isin(*cut)), file, order)
    first = F.col("_pos") < _share(F.col("_n"), train)
    parts = placed.withColumn("split", F.when(first, "train").otherwise("val")).drop("_pos", "_base", "_n")
    return whole.unionByName(parts)


def require_both_classes(rows: DataFrame, label: str = "label", by: str = "split", needed=("train", "val")) -> None:
    """Raise unless every needed split has rows and at least one positive."""
    counts = {
        r[by]: (r["n"], r["positives"])
        for r in rows.filter(F.col(by).isin(*needed))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("positives"))
        .collect()
    }
    for name in needed:
        n, positives = counts.get(name, (0, 0))
        if n == 0 or positives == 0:
            raise ValueError(f"split '{name}' has {n} rows and {positives} positives")
