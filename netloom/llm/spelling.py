"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

1. *Words.* Each text's letter runs are counted once per text; one shuffle counts words over
   the corpus. A rule that is fixed by text id and word drops one letter of some runs, which
   stands for misspellings.
2. *Blocks.* A pair of words one edit apart has lengths that are equal or adjacent, and one
   half of the shorter word stands unchanged at the same end of the longer one. Words are
   blocked by (length, which half, the half's letters); a block of length L holds words of L
   and of L + 1 letters. A block above ``block`` words is dealt into tiles, and every two
   tiles meet in a row group of their own, so no block of any size lies in one task.
3. *Gram matrices.* Inside a group, letters are hashed to ``LETTERS`` columns of counts, and
   NumPy products of count blocks give squared distances |x|^2 + |y|^2 - 2xy. One edit
   changes at most two counts by one, so pairs at a distance of at most two are kept.
4. *Verification.* Kept pairs are compared letter by letter from both ends (:func:`near_pairs`).
   A pair whose both halves agree would be met twice; the block of the second half leaves it out.
5. *Forms.* A group gives one row for each word that has a near word in it: the number, and
   the near word of largest count. Groups are summed, forms are looked up, and roots are
   found by pointer doubling in the logarithm of the longest chain of forms.

Defined cases: a null or empty text has no words; a null id drops no letters; repeated rows
count again (and drop the same letters); ties go to the word first in code-point order; a
word of any length is one word; a very long text is read in one pass of its task; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, slices

#: Letters of words: ASCII and Latin-1, as the contract has them.
RUN = "[A-Za-zÀ-ÿ]"
#: Columns of counts; two letters in one column only let more pairs through to verification.
LETTERS = 32
#: A run loses a letter when this divides its hash.
DROP_EVERY = 31


def text_words(doc_id, text: str, at_least: int, find) -> Counter:
    """Words of one text and how often each occurs."""
    out: Counter = Counter()
    seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(find(text.encode().lower().decode())).items():
        if seed is not None:
            h = zlib.crc32(run.encode(), seed)
            if h % DROP_EVERY == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
        if len(run) >= at_least:
            out[run] += n
    return out


def _count_words(at_least: int, flush: int = 500_000):
    find = re.compile(f"{RUN}{{{at_least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "c"]
            )

        for batch in batches:
            for part in slices(batch, "body"):
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("body").to_pylist()):
                    for word, n in text_words(doc_id, text, at_least, find).items():
                        total[word] += n
                if len(total) >= flush:
                    yield rows()
                    total.clear()
        yield rows()

    return run


def letter_counts(words: list[str]) -> np.ndarray:
    """Counts of hashed letters, a row for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    cell = row * LETTERS + points % LETTERS
    return np.bincount(cell, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.float32)


def _padded(words: list[str], right: bool) -> np.ndarray:
    """Code points of each word, aligned left or right; the rest is -1."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), int(size.max(initial=1))), -1, np.int32)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    if right:
        place = out.shape[1] - np.repeat(size, size) + place
    out[row, place] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


class Tile:
    """Words of whole groups: the base length, half, side and number of each one's group, and its letters."""

    def __init__(self, words: list[str], base: np.ndarray, tail: np.ndarray, side: np.ndarray, group: np.ndarray):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.base, self.tail, self.side, self.group = base, tail, side, group
        self.counts = letter_counts(words)
        self.square = (self.counts**2).sum(1)
        self.left, self.right = _padded(words, False), _padded(words, True)


def near_pairs(x: Tile, y: Tile, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` that are one edit apart, of one group and opposite sides where it has two.

    In a group of base length L, words of L letters meet those of L and L + 1.
    """
    square = x.square[:, None] + y.square[None, :] - 2 * (x.counts @ y.counts.T)
    close = (square <= 2) & (x.group[:, None] == y.group[None, :])
    if same:
        close &= np.tri(*close.shape, -1, dtype=bool)
    i, j = np.nonzero(close)
    meets = (np.minimum(x.size[i], y.size[j]) == x.base[i]) & ((x.side[i] < 0) | (x.side[i] != y.side[j]))
    i, j = i[meets], j[meets]
    wide = min(x.left.shape[1], y.left.shape[1])
    ahead = (x.left[i, :wide] == y.left[j, :wide]) & (x.left[i, :wide] >= 0)
    behind = (x.right[i, -wide:] == y.right[j, -wide:]) & (x.right[i, -wide:] >= 0)
    short = x.base[i]
    prefix = np.logical_and.accumulate(ahead, axis=1).sum(1)
    suffix = np.logical_and.accumulate(behind[:, ::-1], axis=1).sum(1)
    equal_size = x.size[i] == y.size[j]
    edit = np.where(equal_size, ahead.sum(1) == short - 1, prefix + suffix >= short)
    # A pair whose first halves agree is met in the block of the first half.
    edit &= ~(x.tail[i] & (prefix >= short // 2))
    return i[edit], j[edit]


def _best_near(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a near row, how many they have, and the one of largest count; ties go to the first row."""
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((j, -n[j], i))
    rows, first, number = np.unique(i[order], return_index=True, return_counts=True)
    return rows, number, j[order][first]


def _spans(starts: np.ndarray, total: int, tile: int):
    """Stretches of whole groups of at least ``tile`` rows, or the last ones."""
    at = 0
    for edge in [*starts[1:].tolist(), total]:
        if edge - at >= tile or edge == total:
            yield at, edge
            at = edge


_KEY = ["base", "tail", "part", "lo", "hi"]


def _pair_up(tile: int):
    """Near words of rows that come sorted by group, one row for each word of a stretch that has any."""

    def stretch(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        base, side = rows.column("base").to_numpy(), rows.column("side").to_numpy()
        tail = rows.column("tail").to_numpy(zero_copy_only=False)
        group = np.zeros(len(words), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        for a, b in _spans(starts, len(words), tile):
            cuts = [(k, min(k + 2 * tile, b)) for k in range(a, b, 2 * tile)]
            tiles = [Tile(words[k:m], base[k:m], tail[k:m], side[k:m], group[k:m]) for k, m in cuts]
            found = [
                (pair[0] + cuts[u][0], pair[1] + cuts[v][0])
                for u in range(len(cuts)) for v in range(u + 1) for pair in [near_pairs(tiles[u], tiles[v], u == v)]
            ]
            own, number, near = _best_near(*(np.concatenate(c) for c in zip(*found)), n)
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[k] for k in own.tolist()], pa.string()), pa.array(number.astype(np.int64)),
                     pa.array([words[k] for k in near.tolist()], pa.string()), pa.array(n[near])],
                    names=["word", "n_near", "near", "near_n"],
                )

    def starts_of(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for name in _KEY:
            column = rows.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if left is None else pa.concat_tables([left, rows])).combine_chunks()
            starts = starts_of(rows)
            if len(starts) < 2:
                left = rows
                continue
            last = int(starts[-1])
            left = rows.slice(last)
            yield from stretch(rows.slice(0, last).combine_chunks(), starts[:-1])
        if left is not None and left.num_rows:
            yield from stretch(left, starts_of(left))

    return run


def near_words(words: DataFrame, block: int = 4096, tile: int = 256) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near one; ``words`` are distinct (word, n)."""
    bounded_batches(words.sparkSession, 10_000)
    size = F.length("word")

    def keys(base):
        half = F.floor(base / 2).cast("int")
        head = F.struct(base.alias("base"), F.lit(False).alias("tail"), F.substring("word", 1, half).alias("part"))
        return head, F.struct(base.alias("base"), F.lit(True).alias("tail"), F.substring("word", -(base - half), base).alias("part"))

    keyed = materialize(
        words.select("word", "n", F.explode(F.array(*keys(size), *keys(size - 1))).alias("key")).select("word", "n", "key.*"),
        "half-keys",
    )
    key = ["base", "tail", "part"]
    shared = keyed.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1")
    tiles = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("word"), tiles).cast("int")
    meet = lambda other: F.struct(
        F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"),
        F.when(own == other, F.lit(-1)).otherwise((own > other).cast("int")).alias("side"),
    )
    dealt = (
        keyed.join(shared.hint("merge"), key)
        .select("word", "n", *key, F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), meet)).alias("meet"))
        .select("word", "n", *key, "meet.*")
    )
    found = (
        dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
        .mapInArrow(_pair_up(tile), "word string, n_near bigint, near string, near_n bigint")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow each other from each word of (word, form)."""
    chain = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(
            chain.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "forms",
        )
        chain = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return chain


def variants(
    docs: DataFrame, at_least: int = 7, least: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each word of the corpus.

    Words have ``at_least`` letters and ``least`` occurrences; a form occurs ``times`` as often as its word.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    words = materialize(
        rows.mapInArrow(_count_words(at_least), "word string, c bigint")
        .groupBy("word").agg(F.sum("c").alias("n")).filter(F.col("n") >= least),
        "words",
    )
    near = materialize(near_words(words), "near-words")
    formed = F.col("form_n") >= F.col("n") * times
    linked = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    return linked.join(roots(linked.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
