"""Benchmark decontamination: Wu-Manber search of benchmark windows in documents.

A window is ``words`` consecutive words of an item (or all words of a shorter item). Texts
and windows are normalised to bytes: lower-case words parted by one space, so a window
occurs where its bytes, spaces around included, occur.

Patterns of similar length form a group. For a group with shortest length m, the shift
table says how far a block of bytes at the end of the current m bytes allows to skip; where
it says zero, the bucket of patterns whose m-byte prefix ends in that block is compared
directly. Many stretches of the text are searched in step with array operations, each
skipping by its own shifts; stretches divide the start positions, so none is lost.

The windows are sent to the tasks in blocks of at most ``block_bytes``, whatever the size
of the benchmark; each block is searched in all documents, and the hits of a document are
united over the blocks.

Defined cases: a null or empty text, or one without a word, has no words and no hits; items
without a word have no window; equal windows of several items count for each item; repeated
rows give repeated results; a null item id is reported as the empty string; an empty
benchmark or document table gives clean or no rows. A very long text is searched whole by one
task, in about thirty times its size of memory. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, mix, slices, spread, text_buffer, with_fields

#: Bytes of words; the characters of ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` (A-Z lower-cased first) part words.
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x30:0x3A] = np.arange(0x30, 0x3A)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)
_MAP[0x80:] = np.arange(0x80, 0x100)
TABLE_BITS = 20


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, one space before and after each word; word starts; words before each text."""
    data, offsets = text_buffer(texts)
    # Two spaces between texts would be joined to one; the owner of each word is kept instead,
    # and a zero byte keeps texts apart.
    data, starts = spread(_MAP[data], offsets, 1, 2, 0x20)
    lengths = np.diff(offsets)
    data[starts + lengths + 1] = 0
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    owner = np.repeat(np.arange(len(lengths)), lengths + 3)[keep]
    data = data[keep]
    solid = (data != 0x20) & (data != 0)
    word = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    n_words = np.bincount(owner[word], minlength=len(lengths)) if len(word) else np.zeros(len(lengths), np.int64)
    return data, word, np.concatenate([[0], np.cumsum(n_words)])


def windows(items: list[tuple[str, str]], words: int) -> dict[bytes, tuple[int, set[str]]]:
    """Normalised windows, with their number of words and the items that have them."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    if items:
        data, word, at = normalise(pa.array([t for _, t in items], pa.string()))
        raw = data.tobytes()
        for (item, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist()):
            own = [raw[s : raw.index(b" ", s)] for s in word[a:b].tolist()]
            for i in range(max(len(own) - words + 1, 1) if own else 0):
                part = own[i : i + words]
                found.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
    return found


class Group:
    """Shift table and suffix buckets of patterns of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        skip = self.m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, skip, np.int32)
        for end in range(self.block, self.m + 1):
            key = np.zeros(len(heads), np.uint64)
            for j in range(self.block):
                key |= heads[:, end - self.block + j].astype(np.uint64) << np.uint64(8 * j)
            np.minimum.at(self.shift, self.slot(key), self.m - end)
        self.buckets: dict[int, list[bytes]] = {}
        for p, last in zip(patterns, key.tolist()):  # the block at the end of each prefix
            self.buckets.setdefault(last, []).append(p)
        self.ends = np.sort(np.fromiter(self.buckets, np.uint64, len(self.buckets)))

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (mix(key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, raw: bytes, stretch: int = 512) -> Iterator[tuple[int, bytes]]:
        """Every occurrence (start, pattern)."""
        n = len(data) - self.m + 1
        if n <= 0:
            return
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        blocks = np.ndarray((len(data) + 8,), "<u8", buffer=padded, strides=(1,))
        at = np.arange(0, n, stretch)
        stop = np.minimum(at + stretch, n)
        seen: list[np.ndarray] = []
        while len(at):
            key = blocks[at + (self.m - self.block)] & self.mask
            shift = self.shift[self.slot(key)]
            zero = shift == 0
            if zero.any():
                seen.append(at[zero])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not seen:
            return
        maybe = np.concatenate(seen)
        keys = blocks[maybe + (self.m - self.block)] & self.mask
        place = np.minimum(np.searchsorted(self.ends, keys), len(self.ends) - 1)
        sure = self.ends[place] == keys
        for start, key in zip(maybe[sure].tolist(), keys[sure].tolist()):
            for pattern in self.buckets[key]:
                if raw.startswith(pattern, start):
                    yield start, pattern


class Searcher:
    """All windows of one block of items; short ones are kept apart, since they allow little skipping."""

    def __init__(self, found: dict[bytes, tuple[int, set[str]]], edges: tuple[int, ...] = (8, 16, 32)):
        self.found = found
        by: dict[int, list[bytes]] = {}
        for p in found:
            by.setdefault(sum(len(p) >= e for e in edges), []).append(p)
        self.groups = [Group(p) for p in by.values()]

    def scan(self, texts: pa.Array):
        """Number of words, hit spans [start, end) in words, and items, of each text."""
        data, word, at = normalise(texts)
        raw = data.tobytes()
        hits: dict[int, tuple[list, set]] = {}
        for group in self.groups:
            for start, pattern in group.search(data, raw):
                n, items = self.found[pattern]
                w = int(np.searchsorted(word, start + 1))
                doc = int(np.searchsorted(at, w, side="right")) - 1
                spans, who = hits.setdefault(doc, ([], set()))
                spans.append((w - int(at[doc]), w - int(at[doc]) + n))
                who |= items
        return np.diff(at), hits


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FIELDS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(searcher_in, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(searcher_in.value)
        for batch in batches:
            for part in slices(batch, "body"):
                n_words, hits = searcher.scan(part.column("body"))
                spans, items = [[]] * part.num_rows, [[]] * part.num_rows
                for doc, (own, who) in hits.items():
                    spans[doc] = [{"start": a, "end": b} for a, b in united(own)]
                    items[doc] = sorted(who)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(n_words), pa.array(spans, _SPANS),
                     pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "n_words", "spans", "items"],
                )

    return run


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 10,
    block_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """``id_col``, ``n_words``, united hit ``spans`` (in words) and sorted ``items`` of each row.

    ``id_col`` is carried along and, for a large benchmark, joined on; it may be a struct.
    With ``keep_text`` the text comes back as ``body``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("body"),
    )
    total = items.agg(F.sum(F.octet_length("body") + F.octet_length("item") + 1)).first()[0] or 0
    # A window takes at most about ``words`` times its share of the text.
    n_blocks = max(1, -(-total // max(block_bytes // words, 1)))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("body"))
    own = ["body"] if keep_text else []

    def searched(block: int, frame: DataFrame, names: list[str]) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == block).toLocalIterator()
        found = spark.sparkContext.broadcast(windows([(r["item"], r["body"]) for r in part], words))
        return frame.mapInArrow(_scan(found, names), with_fields(frame, names, _FIELDS))

    if n_blocks == 1:
        return searched(0, rows, [id_col, *own])
    keyed = rows.withColumn("fp", F.xxhash64("body"))
    parts = [
        materialize(searched(b, keyed, [id_col, "fp", *(own if b == 0 else [])]), "windows") for b in range(n_blocks)
    ]
    whole = parts[0]
    whole = whole.drop("body")
    for part in parts[1:]:
        whole = whole.union(part)
    hit = (
        whole.filter(F.size("items") > 0).groupBy(F.col(id_col).alias("hid"), F.col("fp").alias("hfp"))
        .agg(F.flatten(F.collect_list("spans")).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    merged = F.aggregate(
        F.sort_array("spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(span(F.get(acc, F.size(acc) - 1)["start"], F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]))),
            ),
        ).otherwise(F.concat(acc, F.array(span(s["start"], s["end"])))),
    )
    base = parts[0].select(id_col, "fp", *own, "n_words")
    return base.join(
        hit, F.col(id_col).eqNullSafe(F.col("hid")) & (F.col("fp") == F.col("hfp")), "left"
    ).select(
        id_col, *own, "n_words",
        F.coalesce(merged, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def n_hit():
    """Document words inside any occurrence, from the united spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


#: The registered query in SQL (DuckDB): windows of words joined on their text.
DIGEST_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0) i),
x AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM p) s) j),
h AS (SELECT x.r, x.k, x.size, p.item FROM x JOIN p ON p.size = x.size AND p.win = x.win),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM h) c GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) u GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""
