"""What a key (flow or host pair) has done in earlier windows.

``running_history`` folds measures over a key's windows in time order and starts
afresh after an idle gap. It never puts a key's whole life into one task: rows are
folded within (key, time block), one summary row per block is folded across blocks,
and the result is carried back into the first rows of each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import int_floor_div

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}
BLOCK_US = 3_600_000_000
BLOCK_SEQS = 1 << 18


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def running_history(
    rows: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, str]],
    idle_us: int | None,
    time: str = "window_end_us",
    block_us: int = BLOCK_US,
    before: bool = False,
) -> DataFrame:
    """Fold ``measures`` = {output: (sum|max|min, input column)} up to and including each row.

    ``rows`` has one row per (keys, time). A gap of more than ``idle_us`` starts a new
    session; ``session_start`` is the time of the session's first row. With ``before``
    the measures leave out the row itself (null on a session's first row).
    """
    measures = {"session_start": ("min", time), **measures}
    block = [*keys, "_block"]
    in_block = Window.partitionBy(*block).orderBy(time)
    rows = rows.withColumn("_block", int_floor_div(time, block_us))
    gap = F.col(time) - F.lag(time).over(in_block)
    cut = F.coalesce(gap > idle_us, F.lit(False)) if idle_us is not None else F.lit(False)
    rows = rows.withColumn("_cut", cut.cast("int"))
    rows = rows.withColumn(
        "_part", F.sum("_cut").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    so_far = (
        Window.partitionBy(*block, "_part").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumns(
        {f"_{out}": _COMBINE[kind](src).over(so_far) for out, (kind, src) in measures.items()}
    )
    if before:
        earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns(
            {
                f"_x_{out}": _COMBINE[kind](src).over(earlier)
                for out, (kind, src) in measures.items()
            }
        )

    # One row per block: its time span and the state at its end.
    last = F.struct(F.col(time), F.col("_part"), *[F.col(f"_{out}") for out in measures])
    blocks = rows.groupBy(*block).agg(F.min(time).alias("_from"), F.max(last).alias("_end"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    since = F.col("_from") - F.lag(f"_end.{time}").over(by_block)
    resumes = since.isNotNull()
    if idle_us is not None:
        resumes = resumes & (since <= idle_us)
    blocks = blocks.withColumn("_resumes", resumes)
    # A block whose end state began inside it passes on only its own state.
    fresh = (~F.col("_resumes") | (F.col("_end._part") > 0)).cast("int")
    blocks = blocks.withColumn("_fresh", fresh)
    blocks = blocks.withColumn(
        "_chain", F.sum("_fresh").over(by_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    chain = (
        Window.partitionBy(*keys, "_chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = blocks.withColumns(
        {f"_sum_{out}": _COMBINE[kind](f"_end._{out}").over(chain) for out, (kind, _) in measures.items()}
    )
    carried = blocks.select(
        *block,
        *[
            F.when(F.col("_resumes"), F.lag(f"_sum_{out}").over(by_block)).alias(f"_in_{out}")
            for out in measures
        ],
    )
    joined = rows.join(carried, block)
    state = {}
    for out, (kind, _) in measures.items():
        own = F.col(f"_x_{out}" if before and out != "session_start" else f"_{out}")
        whole = _merge(kind, own, F.col(f"_in_{out}"))
        state[out] = F.when(F.col("_part") == 0, whole).otherwise(own)
    out_cols = [c for c in rows.columns if not c.startswith("_")]
    return joined.select(*out_cols, *[c.alias(n) for n, c in state.items()])


def trailing_windows(flows: DataFrame, history_us: int) -> DataFrame:
    """Per flow row: active windows and time span within the trailing ``history_us``.

    Rows are grouped by flow and block of ``history_us``; each row also goes to the next
    block, where it serves only as history. A group spans two blocks at most.
    """
    block = int_floor_div("window_end_us", history_us)
    copies = flows.withColumn("_home", block).withColumn(
        "_block", F.explode(F.array(F.col("_home"), F.col("_home") + 1))
    )
    trailing = (
        Window.partitionBy("stream_id", "flow_id", "_block")
        .orderBy("window_end_us")
        .rangeBetween(-history_us, 0)
    )
    return (
        copies.withColumns(
            {
                "windows_seen": F.count(F.lit(1)).over(trailing),
                "observed_us": F.col("window_end_us") - F.min("window_end_us").over(trailing),
            }
        )
        .filter(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


def pair_history(
    flows: DataFrame,
    measures: dict[str, tuple[str, str]],
    idle_us: int | None,
    keys: list[str] | None = None,
    block_seqs: int = BLOCK_SEQS,
) -> DataFrame:
    """Running measures per host pair, seen from each of the pair's flows.

    Flows of one window are taken in order of their first packet, after all flows of
    earlier windows. Windows are summed up first, so the fold over time has one row per
    pair and window however many flows the pair has. Flows of one window are folded in
    blocks of ``block_seqs`` arrival numbers, so no task sorts more than one block of a pair.
    """
    keys = ["stream_id", "src_ip", "dst_ip"] if keys is None else keys
    window, block = [*keys, "window_end_us"], [*keys, "window_end_us", "_block"]
    flows_in = flows.withColumn("_block", int_floor_div("first_seq", block_seqs))

    def fold(prefix: str, source: str | None = None) -> list[Column]:
        return [_COMBINE[kind](source + out if source else src).alias(prefix + out) for out, (kind, src) in measures.items()]

    blocks = flows_in.groupBy(*block).agg(*fold("b_"))
    totals = blocks.groupBy(*window).agg(*fold("w_", "b_"))
    earlier = running_history(
        totals,
        keys,
        {f"before_{out}": (kind, f"w_{out}") for out, (kind, _) in measures.items()},
        idle_us,
        before=True,
    ).drop(*[f"w_{out}" for out in measures])
    preceding = Window.partitionBy(*window).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.withColumns(
        {f"_ahead_{out}": _COMBINE[kind](f"b_{out}").over(preceding) for out, (kind, _) in measures.items()}
    )
    start = ahead.join(earlier, window).select(
        *block, "session_start",
        *[
            _merge(kind, F.col(f"_ahead_{out}"), F.col(f"before_{out}")).alias(f"_start_{out}")
            for out, (kind, _) in measures.items()
        ],
    )
    in_block = Window.partitionBy(*block).orderBy("first_seq").rowsBetween(Window.unboundedPreceding, 0)
    here = flows_in.withColumns(
        {f"_{out}": _COMBINE[kind](src).over(in_block) for out, (kind, src) in measures.items()}
    )
    return here.join(start, block).select(
        *flows.columns,
        "session_start",
        *[
            _merge(kind, F.col(f"_{out}"), F.col(f"_start_{out}")).alias(out)
            for out, (kind, _) in measures.items()
        ],
    )
