"""Combine the detectors' verdicts into one result per flow window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import FusionConfig
from netloom.functions.columns import first_truthy
from netloom.operators.detectors.base import verdict
from netloom.operators.features import FLOW_ID_COLUMNS
from netloom.schema import DETECTORS, RESULT_TYPE


def gather(verdicts: list[DataFrame], errors: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Verdict rows of all detectors, in detector order, as one array per flow window.

    Only flow windows with a verdict are shuffled; each has one entry per detector at most.
    A detector's row in ``errors`` (see ``error_rows``) takes the place of its verdict.
    """
    ranked = [v.withColumn("rank", F.lit(i)) for i, v in enumerate(verdicts)]
    # Errors rank one set of places before the verdicts.
    n = len(verdicts)
    if errors is not None:
        place = F.array_position(F.array(*[F.lit(x) for x in names or DETECTORS]), F.col("detector"))
        ranked.append(errors.withColumn("rank", (place - 1 - n).cast("int")).drop("detector"))
    rows = reduce(DataFrame.unionByName, ranked)
    entries = F.array_agg(F.struct("rank", "result"))

    def slot(i: int) -> Column:
        found = _where("entries", "rank", i)
        if errors is None:
            return found
        error = _where("entries", "rank", i - n)
        return F.when(F.size(error) > 0, error).otherwise(found)

    # Results hold maps and so have no order; put each detector's entry in its place.
    slots = [slot(i) for i in range(n)]
    return (
        rows.groupBy(*FLOW_ID_COLUMNS)
        .agg(entries.alias("entries"))
        .select(*FLOW_ID_COLUMNS, F.transform(F.concat(*slots), lambda e: e["result"]).alias("results"))
    )


def _where(array: str, field: str, value) -> Column:
    """Elements of a struct array whose ``field`` equals ``value``."""
    return F.filter(array, lambda e: e[field] == F.lit(value))


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0))


def pick_winner(results: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    """Fold results from left to right into ``struct(result, reason)``.

    A later result wins by severity, then by threat class if the scores are within the
    tie width, then by score. The tie width makes this depend on the order, so it is a
    fold and cannot be a sort.
    """

    def score(r: Column) -> Column:
        return first_truthy(r["confidence"], r["score"])

    def state(result: Column, reason: Column) -> Column:
        return F.struct(result.alias("result"), reason.alias("reason"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["result"]
        rank_old, rank_new = (_lookup(cfg.severity_rank, F.coalesce(r["severity"], F.lit(""))) for r in (old, new))
        class_old, class_new = (
            _lookup(cfg.threat_priority, F.coalesce(r["threat_type"], F.lit(""))) for r in (old, new)
        )
        tied = F.abs(score(new) - score(old)) <= cfg.tie
        more_severe = state(
            new,
            F.concat(F.lit("higher severity "), new["severity"], F.lit(" vs "),
                     F.coalesce(old["severity"], F.lit("None"))),
        )
        by_class = state(
            new,
            F.concat(F.lit("threat class priority "), new["threat_type"], F.lit(" > "),
                     old["threat_type"], F.lit(" (confidence tied)")),
        )
        by_score = state(
            new, F.format_string("higher confidence %.2f vs %.2f", score(new), score(old))
        )
        return (
            F.when(rank_new > rank_old, more_severe)
            .when(rank_new < rank_old, acc)
            .when(tied & (class_new > class_old), by_class)
            .when(~tied & (score(new) > score(old)), by_score)
            .otherwise(acc)
        )

    opening = F.when(F.size(results) == 1, "only detector to fire").otherwise("highest severity")
    return F.aggregate(F.slice(results, 2, F.size(results)), state(results[0], opening), step)


def fuse(
    flows: DataFrame | None,
    gathered: DataFrame,
    cfg: FusionConfig = FusionConfig(),
    detectors: list[str] | None = None,
) -> DataFrame:
    """One result row per flow window.

    With ``flows`` every flow window gets a row (BENIGN where all detectors are silent).
    Without, only flow windows with a verdict do, and ``flows`` need not be shuffled.
    An error outranks everything, a detection outranks an unvalidated signal.
    """
    names = detectors or DETECTORS
    rows = gathered
    if flows is not None:
        rows = flows.select(*FLOW_ID_COLUMNS).join(gathered, FLOW_ID_COLUMNS, "left")
    empty = F.array().cast(f"array<{RESULT_TYPE.simpleString()}>")
    rows = rows.withColumn("results", F.coalesce("results", empty))

    rows = rows.withColumns(
        {
            "_errors": _where("results", "status", "error"),
            "_fired": _where("results", "status", "DETECTED"),
            "_signals": _where("results", "status", "UNVALIDATED"),
        }
    )
    rows = rows.withColumn(
        "_pool", F.when(F.size("_fired") > 0, F.col("_fired")).otherwise(F.col("_signals"))
    )
    rows = rows.withColumn("_win", F.when(F.size("_pool") > 0, pick_winner(F.col("_pool"), cfg)))
    failed, fired = F.size("_errors") > 0, F.size("_fired") > 0
    won = ~failed & F.col("_win").isNotNull()
    quiet = ~failed & F.col("_win").isNull()

    def field(name: str, when_quiet=None) -> Column:
        value = F.when(won, F.col(f"_win.result.{name}"))
        return value if when_quiet is None else value.when(quiet, when_quiet)

    benign_evidence = F.create_map(F.lit("reason"), F.lit("No threat signatures detected"))
    outcomes = F.array(
        *[
            F.coalesce(
                F.try_element_at(_where("results", "detector", n), F.lit(1)),
                verdict(n, "NOT_DETECTED"),
            )
            for n in names
        ]
    )
    return rows.select(
        *FLOW_ID_COLUMNS,
        F.when(failed, "error").when(won, F.col("_win.result.status")).otherwise("BENIGN").alias("status"),
        field("threat_type", F.lit("BENIGN")).alias("threat_type"),
        field("severity").alias("severity"),
        field("confidence", F.lit(1.0)).alias("confidence"),
        field("score").alias("score"),
        field("detector", F.lit("FusionEngine")).alias("detector_name"),
        field("evidence", benign_evidence).alias("evidence"),
        F.when(failed, F.array_join(F.transform("_errors", lambda r: r["error_message"]), "; ")).alias(
            "error_message"
        ),
        F.when(failed, F.concat(F.size("_errors").cast("string"), F.lit(" detector(s) raised exceptions")))
        .when(fired, F.col("_win.reason"))
        .when(
            won,
            F.concat(
                F.lit("Unvalidated signal from: "),
                F.array_join(F.transform("_signals", lambda r: r["detector"]), ", "),
            ),
        )
        .otherwise("No detector fired")
        .alias("fusion_reason"),
        outcomes.alias("all_detector_results"),
    )
