"""Removal of long repeated byte strings by prefix-free parsing.

*Parse.* A rolling hash runs over every text; the position of its least value in a stretch
triggers a phrase. A window of ``length`` bytes belongs to the trigger of its first
``length - GRAM`` positions, which depends on the window's bytes alone, so equal windows
have equal triggers at equal places. A phrase is the text under all consecutive windows of
one trigger; phrases overlap by ``length - 1`` bytes, so each window lies in exactly one
phrase, and the parse of a text is its list of phrases.

*Dictionary.* Equal phrases are one entry; the parse gives how often it occurs. A trigger
that occurs once settles its phrase (nothing in it repeats), an entry that occurs twice
settles its phrases too (everything in them repeats): both by map-side combined counts.
Only entries that share their trigger with another entry are left.

*Order.* The suffixes of those entries are sorted to depth ``length`` by prefix doubling (a
suffix array, so equality there is by bytes), bucket by bucket of triggers; the
order of dictionary suffixes with the counts of the parse is the corpus order, and its runs
of equal windows are the repeats. As phrases overlap by a window, no suffix needs the parse
to go on. Triggers with more than ``max_bucket`` entries are not sorted in one task: their
windows are counted by a 128-bit key in a shuffle instead, with the same result. How often a
trigger and an entry occur is counted by 64-bit keys as well.

Defined cases: a null or empty text, or one shorter than ``length``, loses nothing; rows
with the same id and text are repeats of each other (all their windows go); null ids are
kept; an empty table gives an empty result; ties do not arise. A very long text is parsed whole by
one task, which takes about a hundred times its size of memory. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, slices, span_hashes, text_buffer, with_fields

GRAM = 32


def _starts_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[i] - 1 for every i, end to end."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - counts, counts)


def parse(data: np.ndarray, offsets: np.ndarray, length: int):
    """Phrases of texts end to end: text, first window, number of windows, trigger and phrase keys."""
    n, wide = len(data), length - GRAM
    valid = np.maximum(np.diff(offsets) - length + 1, 0)
    empty = np.zeros(0, np.int64)
    if not valid.sum():
        return empty, empty, empty, empty, empty
    at = np.arange(n - GRAM + 1)
    gram = span_hashes(data, at, at + GRAM, 21)
    bits = max(int(n).bit_length(), 16)
    least = ((gram >> np.uint64(bits)) << np.uint64(bits)) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    windows = np.repeat(offsets[:-1], valid) + _starts_of(valid)
    owner = np.repeat(np.arange(len(valid)), valid)
    trigger = (least[windows] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    begin = windows[first]
    phrase = span_hashes(data, begin, begin + count - 1 + length, 22)
    text = owner[first]
    return text, begin - offsets[text], count, gram[trigger[first]].view(np.int64), phrase.view(np.int64)


def _parse_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                text, lo, n, trigger, phrase = parse(*text_buffer(part.column("body")), length)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("fp").take(at), pa.array(lo), pa.array(n), pa.array(trigger), pa.array(phrase)],
                    names=["id", "fp", "lo", "n", "trigger", "phrase"],
                )

    return run


def _cut_phrases(length: int):
    """The bytes of the wanted phrases of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                data, offsets = text_buffer(part.column("body"))
                wanted = part.column("wanted")
                size = np.array([len(w) for w in wanted], np.int64)
                flat = wanted.flatten()
                lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
                text = np.repeat(np.arange(len(size)), size)
                begin = offsets[text] + lo
                raw = data.tobytes()
                cut = [raw[a:b] for a, b in zip(begin.tolist(), (begin + n - 1 + length).tolist())]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("fp").take(at), flat.field("lo"), flat.field("n"),
                     flat.field("trigger"), flat.field("once"), flat.field("size"), pa.array(cut, pa.binary())],
                    names=["id", "fp", "lo", "n", "trigger", "once", "size", "code"],
                )

    return run


def _bytes_of(code: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    code = code.cast(pa.large_binary())
    offsets = np.frombuffer(code.buffers()[1], np.int64, len(code) + 1 + code.offset)[code.offset :]
    data = np.frombuffer(code.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def equal_windows(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Rank of each window's bytes among all, by prefix doubling over the whole of ``data``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    _, rank = np.unique(word, return_inverse=True)
    depth = 8
    while depth * 2 <= length:
        ahead = np.concatenate([rank[depth:], np.zeros(depth, rank.dtype)])
        _, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64), return_inverse=True)
        depth *= 2
    last = rank[windows + (length - depth)].astype(np.uint64)
    _, rank = np.unique((rank[windows].astype(np.uint64) << np.uint64(32)) | last, return_inverse=True)
    return rank


def _sort_bucket(length: int, chunk_bytes: int = 3 << 20):
    """Repeated windows of phrases that come sorted by trigger, as runs."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        code = rows.column("code").combine_chunks()
        data, offsets = _bytes_of(code)
        n = rows.column("n").to_numpy()
        windows = np.repeat(offsets[:-1], n) + _starts_of(n)
        owner = np.repeat(np.arange(len(n)), n)
        rank = equal_windows(data, windows, length)
        again = (np.bincount(rank)[rank] > 1) & rows.column("once").to_numpy()[owner]
        at = np.flatnonzero(again)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
        first = np.flatnonzero(fresh)
        run = np.diff(np.append(first, len(at)))
        who = owner[at[first]]
        begin = rows.column("lo").to_numpy()[who] + windows[at[first]] - offsets[who]
        take = pa.array(who)
        return pa.RecordBatch.from_arrays(
            [rows.column("id").combine_chunks().take(take), rows.column("fp").combine_chunks().take(take),
             pa.array(begin), pa.array(begin + run - 1 + length)],
            names=["id", "fp", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "code", chunk_bytes // 4):
                trigger = part.column("trigger").to_numpy()
                if size > chunk_bytes:
                    # Cut where a trigger ends.
                    last = held[-1].column("trigger")[-1].as_py()
                    cut = int(np.searchsorted(trigger != last, True)) if trigger[0] == last else 0
                    if cut < len(trigger):
                        if cut:
                            held.append(part.slice(0, cut))
                        yield solve(pa.Table.from_batches(held))
                        held, size = [], 0
                        part = part.slice(cut)
                held.append(part)
                size += part.column("code").nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _key_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "code", 1 << 18):
                data, offsets = _bytes_of(part.column("code"))
                n = part.column("n").to_numpy()
                windows = np.repeat(offsets[:-1], n) + _starts_of(n)
                owner = np.repeat(np.arange(len(n)), n)
                at = pa.array(owner)
                begin = part.column("lo").to_numpy()[owner] + windows - offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(at) for c in ("id", "fp", "trigger", "once")]
                    + [pa.array(span_hashes(data, windows, windows + length, 23).view(np.int64)), pa.array(begin)],
                    names=["id", "fp", "trigger", "once", "key", "start"],
                )

    return run


def _apply(names: list[str]):
    """Unite the spans of each text and cut them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                data, offsets = text_buffer(part.column("body"))
                gone = np.zeros(len(data) + 1, np.int32)
                spans = part.column("found")
                size = np.array([0 if s is None else s for s in spans.value_lengths().to_pylist()], np.int64)
                flat = spans.flatten()
                base = np.repeat(offsets[:-1], size)
                np.add.at(gone, base + flat.field("start").to_numpy(zero_copy_only=False), 1)
                np.add.at(gone, base + flat.field("end").to_numpy(zero_copy_only=False), -1)
                cut = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(cut)])
                starts = cut.copy()
                starts[1:] &= ~cut[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                starts[inner] = cut[inner]
                runs = np.concatenate([[0], np.cumsum(starts)])
                kept = data[~cut].tobytes()
                edge = (offsets - total[offsets]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])),
                     pa.array(np.diff(runs[offsets])), pa.array([kept[a:b] for a, b in zip(edge, edge[1:])], pa.binary())],
                    names=[*names, "n_bytes", "n_removed", "n_spans", "kept_bytes"],
                )

    return run


def remove_repeats(
    docs: DataFrame, length: int = 200, max_bucket: int = 32_768, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (binary) of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    ).withColumn("fp", F.hash("body"))
    phrases = rows.mapInArrow(
        _parse_rows(length), with_fields(rows, ["id", "fp"], "lo bigint, n bigint, trigger bigint, phrase bigint")
    )
    shared = (
        phrases.groupBy("trigger")
        .agg(F.count("*").alias("times"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
        .filter("times > 1").select("trigger", (F.col("low") == F.col("high")).alias("same"))
    )
    held = materialize(phrases.join(shared, "trigger"), "phrases")
    span = lambda frame: frame.select("id", "fp", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    unlike = held.filter(~F.col("same"))
    entries = materialize(
        unlike.groupBy("trigger", "phrase").agg(
            F.count("*").alias("times"), F.min(F.struct("id", "fp", "lo", "n")).alias("at")
        ),
        "dictionary",
    )
    often = entries.filter("times > 1").select("trigger", "phrase")
    sizes = entries.groupBy("trigger").agg(F.count("*").alias("size"))
    wanted = (
        entries.join(sizes, "trigger")
        .groupBy(F.col("at.id").alias("wid"), F.col("at.fp").alias("wfp"))
        .agg(F.collect_list(F.struct("at.lo", "at.n", "trigger", (F.col("times") == 1).alias("once"), "size")).alias("wanted"))
    )
    coded = rows.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("fp") == F.col("wfp")))
    coded = materialize(
        coded.select("id", "fp", "body", "wanted").mapInArrow(
            _cut_phrases(length),
            with_fields(rows, ["id", "fp"], "lo bigint, n bigint, trigger bigint, once boolean, size bigint, code binary"),
        ),
        "phrase-bytes",
    )
    spans_of = with_fields(rows, ["id", "fp"], "start bigint, end bigint")
    fields = ["id", "fp", "lo", "n", "trigger", "once", "code"]
    sorted_ones = (
        coded.filter(F.col("size") <= max_bucket).select(fields).repartition("trigger").sortWithinPartitions("trigger")
        .mapInArrow(_sort_bucket(length), spans_of)
    )
    keyed = coded.filter(F.col("size") > max_bucket).select(fields).mapInArrow(
        _key_windows(length), with_fields(rows, ["id", "fp"], "trigger bigint, once boolean, key bigint, start bigint")
    )
    repeated = keyed.groupBy("trigger", "key").agg(F.count("*").alias("c")).filter("c > 1").select("trigger", "key")
    hot = keyed.filter("once").join(repeated, ["trigger", "key"]).select(
        "id", "fp", "start", (F.col("start") + length).alias("end")
    )
    found = (
        span(held.filter("same")).union(span(unlike.join(often, ["trigger", "phrase"]))).union(sorted_ones).union(hot)
        .groupBy(F.col("id").alias("fid"), F.col("fp").alias("ffp"))
        .agg(F.collect_list(F.struct("start", "end")).alias("found"))
    )
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("fp") == F.col("ffp")), "left").select(
        F.col("id").alias(id_col), "body", "found"
    )
    return joined.mapInArrow(
        _apply([id_col]), with_fields(joined, [id_col], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
    )
