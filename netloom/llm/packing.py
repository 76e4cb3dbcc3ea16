"""Best-fit packing of token pieces into sequences of bounded length, in bulk-synchronous rounds.

1. *Pieces.* Each text is tokenised (its distinct words, see :class:`Tokens`), ``end_id`` is
   appended, and texts above ``capacity`` are cut into full pieces; the first may be shorter.
2. *Sort.* Pieces of one length are alike, so pieces are sorted by length and numbered within
   it: counts per (length, block) are map-side combined, their running totals give every
   piece its rank. Sizes are the counts of ranges ``(length, first rank, count)``, gaps are
   ranges ``(gap, first sequence, count)``: at most a few thousand rows at any corpus size.
3. *Rounds* (:func:`pack_counts`). A sweep over sizes from small to large keeps the waiting
   pieces on a stack, so that every gap meets its best fit, the longest waiting piece that
   it can hold; the pieces and gaps of a match are paired by rank, which settles all
   conflicts at once, and a gap takes as many pieces of that length as fit. Gaps are updated
   and the sweep is repeated until nothing fits; then the longest waiting pieces open as
   many sequences as the waiting tokens need at least.
4. *Places.* Each piece finds its sequence and offset by (length, rank) in the table of
   matches, which is bounded by ``capacity`` and the number of rounds.

Only the counts of lengths (at most ``capacity`` rows) go to the driver, for the sweeps.

Defined cases: a null or empty text is the end token alone; a null id is kept; repeated rows
are pieces of their own; an empty table gives an empty result; ties of length are ordered by
rank, whose order has no meaning; a very long text is tokenised in parts that end before a
blank and a letter; other columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.bpe import _piece_groups, numbered_words
from netloom.llm.common import bounded_batches, materialize, slices, with_fields


def byte_alphabet() -> list[str]:
    """The character that byte-level tokenizers write for each byte: printable ones stand for
    themselves, the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Tokens:
    """Ids of whole texts by a byte-level ``tokenizers`` file.

    Each distinct word of a batch goes through the tokenizer's model once, and a bounded
    table keeps the ids for later batches. Texts that hold an added token of the tokenizer
    are encoded whole instead.
    """

    def __init__(self, path: str, max_known: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.known: dict[str, bytes] = {}
        self.max_known = max_known

    def _codes(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian bytes."""
        if len(self.known) > self.max_known:
            self.known.clear()
        known, tokenize, out = self.known, self.tokenizer.model.tokenize, []
        for word in words:
            code = known.get(word)
            if code is None:
                found = tokenize(word.encode().decode("latin-1").translate(self.alphabet))
                code = known[word] = array("I", [t.id for t in found]).tobytes()
            out.append(code)
        return out

    def ids(self, values: list[str]) -> list[np.ndarray]:
        whole = {i for i, v in enumerate(values) if any(a in v for a in self.added)}
        out: list[list[np.ndarray]] = []
        for group in _piece_groups([v for i, v in enumerate(values) if i not in whole] if whole else values):
            words, number, counts = numbered_words([piece for _, piece in group])
            codes = self._codes(words)
            size = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
            flat = np.frombuffer(b"".join(codes), np.uint32)
            begin, length = (np.cumsum(size) - size)[number], size[number]
            stop = np.cumsum(length)
            at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - length), length)
            edges = np.concatenate([[0], stop])[np.cumsum(counts)]
            for (opens, _), cell in zip(group, np.split(flat[at], edges[:-1])):
                if opens:
                    out.append([cell])
                else:
                    out[-1].append(cell)
        done = iter([np.concatenate(parts) for parts in out])
        direct = {i: self.tokenizer.encode(values[i], add_special_tokens=False).ids for i in whole}
        return [np.array(direct[i], np.uint32) if i in direct else next(done) for i in range(len(values))]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            for part in slices(batch, "body"):
                owner, number, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(tokens.ids(part.column("body").to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(row)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                     *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _sweep(waiting: dict[int, list], gaps: list, matches: list) -> tuple[list, bool]:
    """One round: each gap takes pieces of the longest waiting length that it can hold.

    ``waiting``: length -> [next rank, count]; ``gaps``: (gap, first sequence, count, used).
    """
    stack = sorted(n for n, (_, count) in waiting.items() if count)
    left, moved, at, below = [], False, 0, []
    for gap, sequence, count, used in sorted(gaps):
        while at < len(stack) and stack[at] <= gap:
            below.append(stack[at])
            at += 1
        while count and below:
            length = below[-1]
            rank, many = waiting[length]
            if not many:
                below.pop()
                continue
            each = min(gap // length, many)
            full = min(count, many // each)
            matches.append((length, rank, rank + full * each, sequence, each, used))
            waiting[length] = [rank + full * each, many - full * each]
            left.append((gap - full and gap - each * length, sequence, full, used + each * length))
            sequence, count, moved = sequence + full, count - full, True
        if count:
            left.append((gap, sequence, count, used))
    return left, moved


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (length, first rank, end rank, first sequence, pieces a sequence, offset) for counts per length.

    The ranks of a match fill its sequences in order, ``pieces a sequence`` each.
    """
    waiting = {n: [0, c] for n, c in counts.items() if c}
    gaps, matches, opened = [], [], 0
    while any(c for _, c in waiting.values()):
        # As many sequences as the waiting tokens need at least, for the longest pieces; a
        # piece above half the capacity shares its sequence with no other of these.
        need = -(-sum(n * c for n, (_, c) in waiting.items()) // capacity)
        need = max(need, sum(c for n, (_, c) in waiting.items() if 2 * n > capacity))
        for length in sorted(waiting, reverse=True):
            rank, many = waiting[length]
            take = min(need, many)
            if take:
                matches.append((length, rank, rank + take, opened, 1, 0))
                waiting[length] = [rank + take, many - take]
                gaps.append((capacity - length, opened, take, length))
                opened, need = opened + take, need - take
        moved = True
        while moved:
            least = min((n for n, (_, c) in waiting.items() if c), default=capacity + 1)
            gaps, moved = _sweep(waiting, [g for g in gaps if g[0] >= least], matches)
    return matches


def _place(matches_in):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, width = matches_in.value
        length, lo, _, sequence, each, used = rows.T
        keys = length * width + lo
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, own * width + rank, side="right") - 1
            step = rank - lo[at]
            where = pa.array(sequence[at] + step // each[at]), pa.array(used[at] + step % each[at] * own)
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *where], names=[*kept, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", block_rows: int = 100_000,
) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of each piece."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    found = with_fields(rows, ["id"], "piece int, start long, length long, ids_crc32 long")
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), found), "pieces")
    # Blocks split lengths that many pieces share, so that numbering one takes a bounded group.
    blocks = 64 + pieces.count() // block_rows
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = materialize(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "length-counts")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("id", "piece", "start")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets.hint("merge"), ["length", "block"])
        .select(*pieces.columns[:-1], (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    )
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    matches = pack_counts({r["length"]: r["n"] for r in sizes}, capacity)
    table = np.array(sorted(matches), np.int64).reshape(-1, 6)
    width = int(max((r["n"] for r in sizes), default=0)) + 1
    placed = ranked.mapInArrow(
        _place(spark.sparkContext.broadcast((table, width))),
        with_fields(ranked, ranked.columns[:-1], "sequence_id long, offset long"),
    )
    return placed.withColumnRenamed("id", id_col)
