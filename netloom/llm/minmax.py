"""Near-duplicate groups by min-max hashing.

1. One pass over the texts shingles words, and keeps for each of ``permutations`` hash
   permutations both the smallest and the largest value: twice as many signature values as
   hash evaluations, and bands over them.
2. Documents with the same shingle set are one class (its smallest id), so copies cost a
   map-side combined aggregate. Classes that share a band value with the smallest class of
   that band's bucket are joined to it (a star, never all pairs); the connected components
   of these stars are *families*, inside which every link lies.
3. Inside families, links are confirmed on full shingle sets with sparse matrix products
   in blocks of ``block`` classes. A family of one block is done at once. A larger one is
   first linked block by block, each block together with the same few anchors; then the
   classes outside the largest component so far meet each other and that component, block
   against block, so no pair that could still join two components is left out. What a task emits is at most one link for each class, block and
   component, not pairs.
4. Components of the confirmed links are found by repeated contraction to the neighbour of
   lowest random priority; every round is joins and aggregates written to the shared
   folder. No link, component or signature goes to the driver.

The chance that a pair of similarity s shares no band is (1 - s**rows)**bands: below 5e-6
at 0.75 for 32 bands of 4 rows.

Defined cases: a null, empty or white-space text has no shingles, is its own class and is
kept; a text of fewer words than ``words`` is one shingle; rows that repeat an id
are documents of their own as long as they are exact copies, and count as linked where the id
is the smallest of both their texts (number rows first to tell such rows apart, as the
pipeline's stage does); ties of priority go to the smaller id; a very long text is shingled
whole by one task, in about seventy times its size of memory; rows with a null id are left out of grouping and come back with a null
component and kept true; an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, mix, slices, span_hashes, spread, text_buffer

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and how many each text has."""
    data, offsets = text_buffer(texts)
    data, first = spread(_LOWER[data], offsets, 1, 1, 0x20)
    blank = _IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    # Blank runs become one space; texts stay apart because shingles never leave their text.
    text_of_byte = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)[keep]
    data = np.where(blank[keep], np.uint8(0x20), data[keep])
    solid = data != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    owner = text_of_byte[begin] if len(begin) else np.zeros(0, np.int64)
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(n_words)])
    count = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    total = int(count.sum())
    start_word = np.arange(total) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
    end_word = np.minimum(start_word + words, np.repeat(at[1:], count)) - 1
    return span_hashes(data, begin[start_word], end[end_word], 7), count


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, count = shingles(texts, words)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(count)[:-1])] if len(count) else []


def _signatures(words: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, permutations + 1), 11) | np.uint64(1)
        add = mix(np.arange(1, permutations + 1), 13)
        for batch in batches:
            for part in slices(batch, "body"):
                sets = _sets(part.column("body"), words)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                at = np.cumsum(size[full]) - size[full]
                low = np.zeros((len(full), permutations), np.uint64)
                high = np.zeros((len(full), permutations), np.uint64)
                for k in range(permutations if len(full) else 0):
                    value = flat * odd[k] + add[k]
                    value ^= value >> np.uint64(32)
                    low[:, k] = np.minimum.reduceat(value, at)
                    high[:, k] = np.maximum.reduceat(value, at)
                bands = np.zeros((len(full), 2 * permutations // rows), np.uint64)
                both = np.concatenate([low, high], axis=1)
                for b in range(bands.shape[1]):
                    value = np.full(len(full), b + 1, np.uint64)
                    for r in range(rows):
                        value = mix(value ^ both[:, b * rows + r], r)
                    bands[:, b] = value
                digest = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    for j in range(2):
                        digest[full, j] = np.add.reduceat(mix(flat, 17 + j), at)
                filled = np.zeros(len(sets) + 1, np.int32)
                filled[1:][full] = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(size), pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum(filled, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))
                        ),
                    ],
                    names=["id", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``v`` and ``label`` (smallest member of its component) of each vertex of edges (a, b).

    Each round every vertex moves to its neighbour of lowest random priority (or stays), and
    edges follow; a constant share of vertices goes in each round, whatever the shape.
    """
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), name)
    where = materialize(
        edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("at", F.col("v")), name
    )
    step = 0
    while not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = materialize(
            both.groupBy(F.col("a").alias("old"))
            .agg(F.min(rank("b")).alias("near"), F.min(rank("a")).alias("self"))
            .select("old", F.least("near", "self")["v"].alias("new")),
            name,
        )
        edges = materialize(
            edges.join(move.select(F.col("old").alias("a"), F.col("new").alias("na")), "a")
            .join(move.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
            .filter("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(),
            name,
        )
        where = materialize(
            where.join(move.withColumnRenamed("old", "at"), "at", "left")
            .select("v", F.coalesce("new", "at").alias("at")),
            name,
        )
    least = where.groupBy("at").agg(F.min("v").alias("label"))
    return where.join(least, "at").select("v", "label")


def _matches(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` are similar, by exact intersection counts."""
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    rows_l, rows_r = np.repeat(np.arange(len(left)), size_l), np.repeat(np.arange(len(right)), size_r)
    keep_l, keep_r = np.isin(flat_l, shared), np.isin(flat_r, shared)
    col_l, col_r = np.searchsorted(shared, flat_l[keep_l]), np.searchsorted(shared, flat_r[keep_r])
    rows_l, rows_r = rows_l[keep_l], rows_r[keep_r]
    both = np.zeros((len(left), len(right)), np.float64)
    for c in range(0, len(shared), 8192):  # bounded stretches of the dictionary
        wide = min(8192, len(shared) - c)
        a, b = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        for dense, rows, cols in ((a, rows_l, col_l), (b, rows_r, col_r)):
            here = (cols >= c) & (cols < c + wide)
            dense[rows[here], cols[here] - c] = 1
        both += a @ b.T
    union = size_l[:, None] + size_r[None, :] - both
    return 100 * both >= percent * union


def _decode_sets(codes) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint64) for c in codes]


def _link_block(percent: int):
    """Links inside one block: each class to the first class it is similar to, until connected."""

    def run(key, rows):
        ids = rows.column("v").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        codes = rows.column("code").to_pylist()
        like = _matches(sets := _decode_sets([codes[i] for i in order]), sets, percent)
        root = np.arange(len(ids))
        a, b = [], []
        for i in range(len(ids)):
            for j in np.flatnonzero(like[i, :i]):
                if root[i] != root[j]:
                    a.append(ids[j])
                    b.append(ids[i])
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _link_blocks(percent: int):
    """Links between two blocks, one for each class and component of the other block."""

    def run(key, rows):
        side = rows.column("side").to_numpy(zero_copy_only=False)
        ids, label = rows.column("v").to_numpy(), rows.column("label").to_numpy()
        code = rows.column("code").to_pylist()
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(l) and len(r):
            like = _matches(_decode_sets([code[i] for i in l]), _decode_sets([code[i] for i in r]), percent)
            for i, row in zip(l, like):
                hits = r[row]
                hits = hits[label[hits] != label[i]]
                _, first = np.unique(label[hits], return_index=True)
                a += [ids[i]] * len(first)
                b += ids[hits[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _set_codes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                codes = [s.tobytes() for s in _sets(part.column("body"), words)]
                kept = [part.column(n) for n in part.schema.names if n != "body"]
                names = [n for n in part.schema.names if n != "body"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.binary())], names=[*names, "code"])

    return run


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 75,
    permutations: int = 64,
    rows: int = 4,
    block: int = 128,
    anchors: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    )
    signed = materialize(
        texts.mapInArrow(
            _signatures(words, permutations, rows),
            "id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>",
        ),
        "signatures",
    )
    known = signed.filter("id IS NOT NULL AND n_shingles > 0")
    classes = materialize(
        known.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("v"), F.first("bands").alias("bands")), "classes"
    )
    band = classes.select("v", F.explode("bands").alias("band"))
    stars = band.groupBy("band").agg(F.min("v").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    family = materialize(
        components(
            band.join(stars, "band").filter("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")),
            "families",
        ),
        "families",
    )
    member = materialize(
        family.join(family.groupBy("label").agg(F.count("*").alias("m")), "label")
        .select("v", F.col("label").alias("family"), "m"),
        "members",
    )
    coded = materialize(
        texts.join(member, texts["id"] == member["v"])
        .select("v", "family", "m", "body")
        .mapInArrow(_set_codes(words), "v bigint, family bigint, m bigint, code binary"),
        "shingle-sets",
    ).filter(F.octet_length("code") > 0)
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("v"), blocks).cast("int")
    anchor = F.pmod(F.xxhash64("v", F.lit("anchor")), F.ceil(F.col("m") / anchors)) == 0
    within = coded.withColumn(
        "blk",
        F.explode(F.when(anchor & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))),
    )
    near = materialize(within.groupBy("family", "blk").applyInArrow(_link_block(percent), "a bigint, b bigint"), "links")
    large = materialize(member.filter(F.col("m") > block), "large")
    if not large.isEmpty():
        found = components(near, "partial")
        placed = large.join(found, "v", "left").select("v", "family", F.coalesce("label", "v").alias("label"))
        sizes = placed.groupBy("family", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("family").agg(
            F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")
        ).select("family", F.col("top.label").alias("main"), F.col("top.n").alias("n_main"), "all")
        cross = (
            coded.join(placed.select("v", "label"), "v").join(main, "family")
            .withColumn("outer", F.col("label") != F.col("main"))
            .withColumn("nb_main", F.ceil(F.col("n_main") / block).cast("int"))
            .withColumn("nb_out", F.ceil((F.col("all") - F.col("n_main")) / block).cast("int"))
            .filter("nb_out > 0")
            .withColumn("blk", F.pmod(F.xxhash64("v", F.lit("cross")), F.when(F.col("outer"), F.col("nb_out")).otherwise(F.col("nb_main"))).cast("int"))
        )
        # (l, r): an outer block l meets outer blocks r >= l and, as r = -1 - i, main blocks i.
        outer_meets = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nb_main") - 1), lambda i: F.struct(F.col("blk").alias("l"), (-1 - i).alias("r"), F.lit(0).alias("side"))),
            F.flatten(F.transform(
                F.sequence(F.lit(0), F.col("nb_out") - 1),
                lambda i: F.filter(
                    F.array(
                        F.struct(F.col("blk").alias("l"), i.alias("r"), F.lit(0).alias("side")),
                        F.struct(i.alias("l"), F.col("blk").alias("r"), F.lit(1).alias("side")),
                    ),
                    lambda s: s["l"] <= s["r"],
                ),
            )),
        )
        main_meets = F.transform(
            F.sequence(F.lit(0), F.col("nb_out") - 1),
            lambda i: F.struct(i.alias("l"), (-1 - F.col("blk")).alias("r"), F.lit(1).alias("side")),
        )
        more = (
            cross.select("v", "label", "family", "code", F.explode(F.when(F.col("outer"), outer_meets).otherwise(main_meets)).alias("meet"))
            .select("v", "label", "family", "code", "meet.l", "meet.r", "meet.side")
            .groupBy("family", "l", "r").applyInArrow(_link_blocks(percent), "a bigint, b bigint")
        )
        near = near.union(materialize(more, "links"))
    linked = components(near, "components")
    final = classes.join(linked, "v", "left").select("s1", "s2", "n_shingles", F.coalesce("label", "v").alias("cid"))
    shown = known.join(final, ["s1", "s2", "n_shingles"])
    # Rows of one class share a component; see the docstring on repeated ids.
    rest = signed.filter("id IS NULL OR n_shingles = 0").withColumn("cid", F.col("id"))
    return shown.select("id", "n_shingles", "cid").union(rest.select("id", "n_shingles", "cid")).select(
        F.col("id").alias(id_col), "n_shingles", F.col("cid").alias("component_id"),
        F.coalesce(F.col("id") == F.col("cid"), F.lit(True)).alias("kept"),
    )
