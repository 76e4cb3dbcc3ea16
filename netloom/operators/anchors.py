"""Which gaps restart a window grid, by composing transfer functions of time blocks.

The grid's anchor after a gap depends on the anchor before it, so gaps look sequential. But
whether a gap restarts the grid depends on the anchor's *phase* (anchor modulo slide) alone,
and after a restart the anchor is known. What a block of gaps does is therefore a function of
the entry phase: constant on few intervals of phases, each with the exit anchor or "unchanged".
Blocks build their functions at the same time, functions of neighbouring blocks are composed
level by level, entry anchors are handed down again, and each block then finishes alone.

A block spans ``SPAN`` windows and thus holds at most ``4 * SPAN`` gaps (they lie a quarter
window apart); a node spans ``FAN`` blocks. One row for each node (a million windows) is
folded per stream. A function has at most ``slide`` pieces (phases are microseconds), and a
gap of more than two windows makes all that follows constant.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import WindowConfig
from netloom.functions.columns import int_floor_div
from netloom.session import materialize

SPAN = 1024
FAN = 1024


class Transfer:
    """Exit anchor for each entry phase: ``lo`` are starts of intervals, ``out`` None is "unchanged"."""

    def __init__(self, lo: list[int] | None = None, out: list[int | None] | None = None):
        self.lo, self.out = lo or [0], out or [None]

    def at(self, phase: int) -> int | None:
        return self.out[bisect_right(self.lo, phase) - 1]

    def after(self, anchor: int, slide: int) -> int:
        """The exit anchor of an entry anchor."""
        out = self.at(anchor % slide)
        return anchor if out is None else out

    def set(self, start: int, stop: int, value: int | None, slide: int) -> None:
        """Give phases ``start <= p < stop`` the exit ``value``."""
        if start >= stop:
            return
        lo, out = self.lo, self.out
        tail = self.at(stop) if stop < slide else None
        a, b = bisect_left(lo, start), bisect_left(lo, stop)
        new_lo, new_out = [start], [value]
        if stop < slide and (b == len(lo) or lo[b] != stop):
            new_lo.append(stop)
            new_out.append(tail)
        lo[a:b], out[a:b] = new_lo, new_out
        for k in (a + len(new_lo), a):  # join neighbours of equal exits
            if 0 < k < len(lo) and out[k] == out[k - 1]:
                del lo[k], out[k]


def gaps_transfer(times: list[int], before: list[int], window: int, slide: int) -> Transfer:
    """What gaps in order of time do: the last first, each overrides the phases that it restarts."""
    function = Transfer()
    for ts, newest in zip(reversed(times), reversed(before)):
        anchor = ts - window
        exit_anchor = function.after(anchor, slide)
        # It restarts if (newest - phase) mod slide exceeds this.
        spare = 2 * window - (ts - newest)
        if spare < 0:
            function = Transfer([0], [exit_anchor])
        elif spare < slide - 1:
            start, size = (newest + 1) % slide, slide - 1 - spare
            function.set(start, min(start + size, slide), exit_anchor, slide)
            function.set(0, start + size - slide, exit_anchor, slide)
    return function


def composed(first: Transfer, then: Transfer, slide: int) -> Transfer:
    """``first``, then ``then``."""
    lo, out = [], []

    def put(start: int, value: int | None) -> None:
        if not out or out[-1] != value:
            lo.append(start)
            out.append(value)

    for k, (start, value) in enumerate(zip(first.lo, first.out)):
        if value is not None:
            put(start, then.after(value, slide))
            continue
        stop = first.lo[k + 1] if k + 1 < len(first.lo) else slide
        put(start, then.at(start))
        for j in range(bisect_right(then.lo, start), bisect_left(then.lo, stop)):
            put(then.lo[j], then.out[j])
    return Transfer(lo, out)


def _function_row(pdf: pd.DataFrame, keys: list[str], function: Transfer) -> pd.DataFrame:
    # A list column cannot hold nulls beside numbers through pandas safely: flags stand apart.
    return pd.DataFrame(
        {**{k: [pdf[k].iloc[0]] for k in keys}, "lo": [function.lo], "out": [[0 if o is None else o for o in function.out]],
         "same": [[o is None for o in function.out]]}
    )


def _functions(pdf: pd.DataFrame) -> list[Transfer]:
    return [
        Transfer([int(x) for x in lo], [None if s else int(o) for o, s in zip(out, same)])
        for lo, out, same in zip(pdf["lo"], pdf["out"], pdf["same"])
    ]


_FUNCTION = "lo array<bigint>, out array<bigint>, same array<boolean>"


def restarts(gaps: DataFrame, first: DataFrame, cfg: WindowConfig) -> tuple[DataFrame, DataFrame]:
    """Segments closed by a gap, and each stream's last anchor.

    ``gaps``: stream_id, ts_us, before_us (written; read twice). ``first``: stream_id, anchor_us.
    Returns (stream_id, block, place, anchor_us, last_us) and (stream_id, anchor_us), streams
    without gaps left out.
    """
    window, slide = cfg.window_us, cfg.slide_us
    block = int_floor_div("ts_us", SPAN * window)
    gaps = gaps.select("stream_id", "ts_us", "before_us", block.alias("block"), int_floor_div("ts_us", SPAN * FAN * window).alias("node"))
    keys = ["stream_id", "node", "block"]

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us")
        return _function_row(pdf, keys, gaps_transfer(pdf["ts_us"].tolist(), pdf["before_us"].tolist(), window, slide))

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        whole, *rest = _functions(pdf)
        for then in rest:
            whole = composed(whole, then, slide)
        return _function_row(pdf, ["stream_id", "node"], whole)

    def hand_down(by: str, last: bool):
        """The entry anchor of each row's block or node; with ``last`` the stream's exit as well."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by)
            anchor, entries = int(pdf["entry_us"].iloc[0]), []
            for function in _functions(pdf):
                entries.append(anchor)
                anchor = function.after(anchor, slide)
            out = {"stream_id": pdf["stream_id"].tolist(), by: pdf[by].tolist(), "entry_us": entries}
            if last:
                out = {"stream_id": [*out["stream_id"], pdf["stream_id"].iloc[0]], by: [*out[by], None], "entry_us": [*entries, anchor]}
            return pd.DataFrame(out).astype({by: "Int64"})

        return run

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us")
        anchor, out = int(pdf["entry_us"].iloc[0]), []
        for ts, newest in zip(pdf["ts_us"].tolist(), pdf["before_us"].tolist()):
            if ts > newest - (newest - anchor) % slide + 2 * window:
                out.append((pdf["stream_id"].iloc[0], pdf["block"].iloc[0], len(out), anchor, newest))
                anchor = ts - window
        return pd.DataFrame(out, columns=["stream_id", "block", "place", "anchor_us", "last_us"])

    leaves = materialize(gaps.groupBy(*keys).applyInPandas(leaf, f"stream_id string, node bigint, block bigint, {_FUNCTION}"), "block-transfers")
    nodes = leaves.groupBy("stream_id", "node").applyInPandas(inner, f"stream_id string, node bigint, {_FUNCTION}")
    # One row for each node of SPAN * FAN windows.
    top = materialize(
        nodes.join(first.withColumnRenamed("anchor_us", "entry_us"), "stream_id").groupBy("stream_id")
        .applyInPandas(hand_down("node", True), "stream_id string, node bigint, entry_us bigint"),
        "node-entries",
    )
    entries = (
        leaves.join(top, ["stream_id", "node"]).groupBy("stream_id", "node")
        .applyInPandas(hand_down("block", False), "stream_id string, block bigint, entry_us bigint")
    )
    closed = gaps.join(entries, ["stream_id", "block"]).groupBy("stream_id", "block").applyInPandas(
        finish, "stream_id string, block bigint, place bigint, anchor_us bigint, last_us bigint"
    )
    return materialize(closed, "closed-segments"), top.filter("node IS NULL").select("stream_id", F.col("entry_us").alias("anchor_us"))
