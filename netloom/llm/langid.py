"""Language identification by prediction by partial matching over bytes.

For each language a variable-order byte context tree holds how often each byte followed
each context of up to ``order`` bytes in the training texts. The statistics are frozen: a
byte costs -log2 of its probability in the longest context of the tree that ends before it,
where unseen bytes share the escape probability u / (n + u) of a context seen n times with
u different bytes, spread by the next shorter context with the seen bytes excluded; below
order 0 all 256 bytes are equally likely. The code length of a text under a language is the
sum over all its bytes, and the shortest code wins.

Counting is one pass that counts (order + 1)-grams in each task, a map-side combined
shuffle, and marginal sums for the lower orders. A context belongs to a tree only if it
holds at least ``min_share`` of the language's bytes, so a tree has at most 1 / min_share
contexts of each order and the model that is sent to tasks has a size bound that does not
depend on the corpus. Scoring is one pass with table lookups: three bytes give the longest
context, context and byte give the costs under all languages.

Defined cases: text that is null or has no letter is ``und`` with score 0; texts or
languages that are null do not train; ties go to the language first in alphabet; with no
training text every text is ``und``; repeated rows count each; an empty table gives an empty
result. A very long text is scored whole by one task, in about forty times its size of memory.
Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, slices, spread, text_buffer, with_fields

ORDER = 3
UNDETERMINED = "und"


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte: its text, and the integer of the ``ORDER`` bytes before it and itself."""
    data, offsets = text_buffer(texts)
    padded, starts = spread(data, offsets, ORDER, 0, 0x20)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data), dtype=np.int64) + np.repeat(starts - offsets[:-1], np.diff(offsets))
    wide = padded.astype(np.uint32)
    code = wide.copy()
    for back in range(1, ORDER + 1):
        code[back:] |= wide[:-back] << np.uint32(8 * back)
    return owner, code[at], data, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        code, n = kept.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
        )

    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                mine = part.filter(pa.array([x == lang for x in langs]))
                _, code, _, _ = _grams(mine.column("text"))
                unique, n = np.unique(code, return_counts=True)
                if lang in kept:
                    old, m = kept[lang]
                    both, back = np.unique(np.concatenate([old, unique]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([m, n])).astype(np.int64)
                    unique = both
                kept[lang] = unique, n
                if len(unique) > 2_000_000:
                    yield flush(lang)
    for lang in list(kept):
        yield flush(lang)


def train(docs: DataFrame, min_share: float = 2e-5, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Frozen statistics: languages and, for each order, (language, context, byte, count) arrays."""
    bounded_batches(docs.sparkSession)
    grams = materialize(
        docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .filter("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "byte-grams",
    )
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    floor = F.create_map([x for lang in langs for x in (F.lit(lang), F.lit(totals[lang] * min_share))]) if langs else None
    orders = []
    for order in range(ORDER + 1) if langs else ():
        low = F.col("gram").bitwiseAND((1 << (8 * (order + 1))) - 1)
        counts = grams.groupBy("lang", low.alias("gram")).agg(F.sum("n").alias("n"))
        counts = counts.withColumn("context", F.shiftright("gram", 8))
        big = counts.groupBy("lang", "context").agg(F.sum("n").alias("all")).filter(F.col("all") >= floor[F.col("lang")])
        rows = counts.join(big.select("lang", "context"), ["lang", "context"]).select("lang", "gram", "n").toArrow()
        index = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.int64)
        gram = rows.column("gram").to_numpy().astype(np.int64)
        orders.append((index, gram >> 8, gram & 255, rows.column("n").to_numpy().astype(np.int64)))
    return {"langs": langs, "orders": orders}


class Model:
    """Lookup tables of the frozen statistics."""

    def __init__(self, frozen: dict):
        self.langs = frozen["langs"]
        n_lang = len(self.langs)
        if not n_lang:
            return
        # Node 0 is the empty context. lower[k][context] is the node of a context of k bytes.
        nodes: list[dict[int, int]] = [{0: 0}]
        for _, context, _, _ in frozen["orders"][1:]:
            base = sum(map(len, nodes))
            nodes.append({int(c): base + i for i, c in enumerate(np.unique(context))})
        cost = np.zeros((sum(map(len, nodes)), 256, n_lang), np.float32)
        for order, (lang, context, byte, n) in enumerate(frozen["orders"]):
            counts = {}
            for at, (l, c) in enumerate(zip(lang.tolist(), context.tolist())):
                counts.setdefault((l, c), []).append(at)
            for c, node in nodes[order].items():
                parent = self._parent(nodes, order, c)
                for l in range(n_lang):
                    below = 2.0 ** -cost[parent, :, l].astype(np.float64) if order else np.full(256, 1 / 256)
                    rows = counts.get((l, c))
                    if rows is None:
                        cost[node, :, l] = -np.log2(below)
                        continue
                    seen, times = byte[rows], n[rows].astype(np.float64)
                    p = below.copy()
                    rest = 1.0 - p[seen].sum()
                    whole = times.sum() + (len(seen) if len(seen) < 256 else 0)
                    if len(seen) < 256:
                        p *= len(seen) / whole / max(rest, 1e-12)
                    p[seen] = times / whole
                    cost[node, :, l] = -np.log2(np.maximum(p, 1e-30))
        self.cost = cost.reshape(len(cost) * 256, n_lang)
        # The longest context that is a node, for every three bytes.
        longest = np.zeros(1 << 24, np.uint16 if len(cost) <= 1 << 16 else np.int32)
        every = longest.reshape(256, 256, 256)
        for order in range(1, ORDER + 1):
            for c, node in nodes[order].items():
                if order == 1:
                    every[:, :, c] = node
                elif order == 2:
                    every[:, c >> 8, c & 255] = node
                else:
                    longest[c] = node
        self.longest = longest

    @staticmethod
    def _parent(nodes, order, context):
        for k in range(order - 1, 0, -1):
            found = nodes[k].get(context & ((1 << (8 * k)) - 1))
            if found is not None:
                return found
        return 0

    def lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text under each language, and bytes of each text."""
        _, code, data, offsets = _grams(texts)
        row = self.longest[code >> np.uint32(8)].astype(np.int64) * 256 + data
        n = np.diff(offsets)
        bits = np.zeros((len(n), len(self.langs)), np.float64)
        full = np.flatnonzero(n)
        if len(full):
            bits[full] = np.add.reduceat(self.cost[row], offsets[:-1][full], axis=0, dtype=np.float64)
        return bits, n


def _predict(frozen_in, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for part in slices(batch, "body"):
                model = model or Model(frozen_in.value)  # built for each task, so that idle workers hold none
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                if model.langs:
                    bits, n = model.lengths(part.column("body"))
                    best = bits.argmin(axis=1)
                    odds = np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
                    score = np.where(letter, 1 / odds, 0.0)
                    name = np.where(letter, np.array(model.langs, object)[best], UNDETERMINED)
                    rate = np.where(letter, bits.min(axis=1) / np.maximum(n, 1), 0.0)
                else:
                    score, rate = np.zeros(part.num_rows), np.zeros(part.num_rows)
                    name = np.full(part.num_rows, UNDETERMINED, object)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in carried), pa.array(name.tolist(), pa.string()), pa.array(score),
                        pa.array(rate),
                    ],
                    names=[*carried, "lang_pred", "score", "bits_per_byte"],
                )

    return run


def identify(
    docs: DataFrame, frozen: dict, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (its share of the languages' likelihoods), ``bits_per_byte``.

    ``id_col`` is carried along only and may be any column, a struct too; with ``keep_text``
    the text comes back as ``body``.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col), text.alias("body"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(frozen)
    carried = [id_col, "body"] if keep_text else [id_col]
    fields = with_fields(rows, carried, "lang_pred string, score double, bits_per_byte double")
    return rows.mapInArrow(_predict(shared, carried), fields)
