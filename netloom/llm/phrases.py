"""Phrase collocations from sorted streams of n-gram counts.

1. *Count streams.* Texts are cut into pieces and words, which are counted per language.
   A part of a phrase occurs at least as often as the phrase, so only n-grams of frequent
   parts are looked at. Pairs, then triples, are first counted by 64-bit keys, which are a
   quarter of the size of their words; those of frequent keys are then counted by the words
   themselves, so no key decides a count. Tasks know what is frequent from bitmaps of at
   most ``max_bits`` bits, which let everything frequent through and little else.
2. *Two orders.* A stream holds its n-grams as words (``w1``, ``w2``, ``w3``). In prefix order
   (the first words lead) it is merge-joined with the stream of its prefixes, which gives
   the left counts; in suffix order with that of its suffixes, for the right counts. The
   joins are sort-merge joins: both sides are read in key order in lockstep, and no side is
   held as a hash table or sent to all tasks.
3. *Extensions.* Triples in prefix and in suffix order are reduced to their largest count per
   pair, merged with the stream of pairs, and pairs that mostly occur inside a triple go.
4. *Scores* are whole numbers of up to 38 digits; phrases of one language are ranked with a
   limit per task before they meet.

Defined cases: a null or empty text has no words; a null language is ``und``; ids do not
matter, so null or repeated ones count like others; repeated rows count again; an empty table
gives an empty result; ties go by count, then phrase in UTF-8 byte order; a very long text is
counted in parts that begin after a separator (only a piece of many megabytes is held
whole); other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import (
    bounded_batches, distinct_spans, materialize, mix, slices, span_hashes, spread, text_buffer, text_pieces,
)

#: What ends a piece.
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_AFTER_SEPARATOR = re.compile(r"(?<=[.,;:!?\x0A-\x0D])")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: 0 for a byte of a word, 1 for a blank, 2 for a separator.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in SEPARATORS]] = 2
#: A bitmap row of Spark's bitmap functions holds so many bits.
_ROW_BITS = 32_768
#: The second place of a key in a bitmap comes from its bits from here on.
_SECOND = 32


class Places:
    """Where the words of some texts begin and end, in order, and whether the next one or two
    words follow in the same piece."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data, offsets = text_buffer(texts)
        data, first = spread(_LOWER[data], offsets, 1, 1, 0x0A)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[1], kind, [1]]).astype(bool).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        piece = np.cumsum(kind == 2)[begin] if len(begin) else np.zeros(0, np.int64)
        owner = np.searchsorted(first, begin, side="right") - 1
        names = sorted(set(langs))
        place = {name: i for i, name in enumerate(names)}
        lang = np.fromiter((place[x] for x in langs), np.int64, len(langs))[owner]
        self.follows = [np.zeros(len(begin), bool), np.zeros(len(begin), bool)]
        for k in (1, 2):
            self.follows[k - 1][: max(len(begin) - k, 0)] = piece[k:] == piece[: max(len(begin) - k, 0)]
        self.data, self.begin, self.end, self.names, self.lang_of = data, begin, end, names, lang

    def keys(self) -> np.ndarray:
        """A fingerprint of each (lang, word), the same in every task."""
        return word_keys(self.data, self.begin, self.end, self.names, self.lang_of)


class Words(Places):
    """The distinct (lang, word) of some texts, and the ``number`` of each word among them."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        super().__init__(texts, langs)
        one, number = distinct_spans(self.data, self.begin, self.end)
        number = number * len(self.names) + self.lang_of
        _, at, number = np.unique(number, return_index=True, return_inverse=True)
        self.number, self.begin, self.end, self.lang_of = number.reshape(-1), self.begin[at], self.end[at], self.lang_of[at]
        self.lang = pa.array(self.names, pa.string()).take(pa.array(self.lang_of))
        raw = self.data.tobytes()
        self.word = pa.array([raw[a:b].decode() for a, b in zip(self.begin.tolist(), self.end.tolist())], pa.string())


def word_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, names: list[str], lang: np.ndarray) -> np.ndarray:
    raw = np.frombuffer("\0".join([*names, ""]).encode(), np.uint8)
    stop = np.flatnonzero(raw == 0)
    own = span_hashes(raw, np.concatenate([[0], stop[:-1] + 1]).astype(np.int64), stop.astype(np.int64), 31)
    return span_hashes(data, begin, end, 32) ^ mix(own, 33)[lang]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left, 34) ^ mix(right, 35)


def _present(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both places of each key are set."""
    found = np.ones(len(keys), bool)
    for part in (keys, keys >> np.uint64(_SECOND)):
        at = part & np.uint64(len(bitmap) * 8 - 1)
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _places(
    follows: list[np.ndarray], known: np.ndarray, size: int, bitmaps: list[np.ndarray], number: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams of ``size`` words start whose shorter parts are in ``bitmaps``, and their keys.

    ``known`` are the keys of the words in order, or of distinct words that ``number`` names in order.
    """
    alive, at = _present(bitmaps[0], known), np.flatnonzero(follows[size - 2])
    if number is not None:
        alive, known = alive[number], known[number]
    for k in range(size):
        at = at[alive[at + k]]
    pair = lambda k: pair_keys(known[at + k], known[at + k + 1])
    if size == 2:
        return at, pair(0)
    for k in range(2):
        at = at[_present(bitmaps[1], pair(k))]
    return at, pair_keys(pair(0), known[at + 2])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in _slices_of_words(batch):
            counts = np.bincount(words.number, minlength=len(words.word))
            yield pa.RecordBatch.from_arrays([words.lang, words.word, pa.array(counts)], names=["lang", "w1", "c"])


#: Keys of so many n-grams are counted together before they leave a task.
POOL = 1 << 20
#: A batch of counts holds so many rows at most.
_ROWS = 1 << 17


def _key_counts(size: int, bitmaps_in):
    """(k, c): how often each key of an n-gram occurs in some slices.

    Keys are made of the words where they stand: a key bounds a count from above, so words that
    share one need not be told apart, and no slice has to find its distinct words.
    """

    def counted(pool: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = np.unique(np.concatenate(pool), return_counts=True)
        rows = [pa.array(key.view(np.int64)), pa.array(count.astype(np.int32))]
        for a in range(0, len(key), _ROWS):
            yield pa.RecordBatch.from_arrays([c.slice(a, _ROWS) for c in rows], names=["k", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, pool, held = bitmaps_in.value, [], 0
        for batch in batches:
            for texts, langs in _parts(batch):
                words = Places(texts, langs)
                pool.append(_places(words.follows, words.keys(), size, bitmaps)[1])
                held += len(pool[-1])
                if held >= POOL:
                    yield from counted(pool)
                    pool, held = [], 0
        if held:
            yield from counted(pool)

    return run


def _phrase_counts(bitmaps_in):
    """(lang, w1, w2, w3, c) of the pairs (a null ``w3``) and triples of a slice that are in the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = bitmaps_in.value
        for batch in batches:
            for words in _slices_of_words(batch):
                known, total = words.keys(), np.uint64(len(words.word))
                for size in (2, 3):
                    at, key = _places(words.follows, known, size, bitmaps, words.number)
                    at = at[_present(bitmaps[size - 1], key)]
                    # Three numbers of words of one slice fit 64 bits.
                    whole = words.number[at].astype(np.uint64)
                    for k in range(1, size):
                        whole = whole * total + words.number[at + k].astype(np.uint64)
                    whole, count = np.unique(whole, return_counts=True)
                    cells = []
                    for _ in range(size):
                        cells.insert(0, pa.array((whole % total).astype(np.int64)))
                        whole //= total
                    texts = [words.word.take(c) for c in cells]
                    texts += [pa.nulls(len(count), pa.string())] * (3 - size)
                    yield pa.RecordBatch.from_arrays(
                        [words.lang.take(cells[0]), *texts, pa.array(count)], names=["lang", "w1", "w2", "w3", "c"]
                    )

    return run


#: Words of one slice are numbered below two million, so that three numbers fit 64 bits.
SLICE_BYTES = 2 << 20


def _slices_of_words(batch: pa.RecordBatch) -> Iterator[Words]:
    for texts, langs in _parts(batch):
        words = Words(texts, langs)
        if len(words.word):
            yield words


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for part in slices(batch, "body", SLICE_BYTES):
        langs = part.column("lang").to_pylist()
        if (pc.max(pc.binary_length(part.column("body"))).as_py() or 0) <= 2 * SLICE_BYTES:
            yield part.column("body"), langs
            continue
        for text, lang in zip(part.column("body").to_pylist(), langs):
            for piece in text_pieces(text, _AFTER_SEPARATOR, SLICE_BYTES):
                yield pa.array([piece], pa.string()), [lang]


def _word_key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of rows (lang, w1)."""
    for batch in batches:
        names = batch.column("lang").unique().to_pylist()
        lang = pc.index_in(batch.column("lang"), pa.array(names, pa.string())).to_numpy()
        data, offsets = text_buffer(batch.column("w1"))
        keys = word_keys(data, offsets[:-1], offsets[1:], names, lang)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["k"])


def _bitmap(keys: DataFrame, max_bits: int) -> np.ndarray:
    """Two bits for each ``k``, in eight to sixteen for each, ``max_bits`` at most."""
    bits = _ROW_BITS
    while bits < min(max_bits, 8 * keys.count()):
        bits *= 2
    # Spark counts bits from 1, in rows of _ROW_BITS.
    place = lambda key: key.bitwiseAND(bits - 1) + 1
    bit = keys.select(F.explode(F.array(place(F.col("k")), place(F.shiftrightunsigned("k", _SECOND)))).alias("bit"))
    rows = (
        bit.groupBy(F.bitmap_bucket_number("bit").alias("row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("cell"))
        .collect()  # bits / 8 bytes
    )
    out = np.zeros((bits // _ROW_BITS, _ROW_BITS // 8), np.uint8)
    for r in rows:
        out[r["row"] - 1] = np.frombuffer(r["cell"], np.uint8)
    return out.reshape(-1)


def _merged(stream: DataFrame, keys: list[str], parts: DataFrame, name: str) -> DataFrame:
    """``stream``, in the order of ``keys``, with the counts of the parts that these words are."""
    return stream.join(parts.toDF("lang", *keys, name).hint("merge"), ["lang", *keys])


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**15."""
    n = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in (a, left, right)}
    return F.expr(f"({n[a]} * {n[a]} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({n[left]} * {n[right]})")


def collocations(
    docs: DataFrame, least: int = 10, contained_percent: int = 50, top: int = 2000, max_bits: int = 1 << 28,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases.

    ``max_bits`` (a power of two) bounds each of the three bitmaps that go to all tasks (32 MB at 1 << 28).
    """
    if least < 1 or max_bits < _ROW_BITS:
        raise ValueError(f"least must be at least 1, max_bits at least {_ROW_BITS}")
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    send = docs.sparkSession.sparkContext.broadcast
    every = materialize(
        texts.mapInArrow(_word_counts, "lang string, w1 string, c bigint").groupBy("lang", "w1").agg(F.sum("c").alias("f")), "words"
    )
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(every.filter(F.col("f") >= least), "frequent-words")
    bitmaps = [_bitmap(materialize(words.mapInArrow(_word_key_rows, "k bigint"), "frequent-keys"), max_bits)]
    for size in (2, 3):
        keys = texts.mapInArrow(_key_counts(size, send(list(bitmaps))), "k bigint, c int").groupBy("k").agg(F.sum("c").alias("f"))
        bitmaps.append(_bitmap(materialize(keys.filter(F.col("f") >= least).select("k"), "frequent-keys"), max_bits))
    counted = texts.mapInArrow(_phrase_counts(send(bitmaps)), "lang string, w1 string, w2 string, w3 string, c bigint")
    found = counted.groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    found = materialize(found, "phrase-counts")
    pairs, triples = found.filter("w3 IS NULL").drop("w3"), found.filter("w3 IS NOT NULL")

    inside = F.col("f") * 100 >= F.col("a") * contained_percent
    longer = triples.groupBy("lang", "w1", "w2").agg(F.max("f").alias("f")).union(
        triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("f"))
    )
    gone = _merged(longer, ["w1", "w2"], pairs, "a").filter(inside).select("lang", "w1", "w2").distinct()
    alone = pairs.join(gone.hint("merge"), ["lang", "w1", "w2"], "left_anti")
    two = _merged(_merged(alone, ["w1"], words, "l"), ["w2"], words, "r").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r",
        score_of("f", "l", "r").alias("score"),
    )
    by_prefix = _merged(_merged(triples, ["w1", "w2"], pairs, "l2"), ["w1"], words, "l1")
    by_suffix = _merged(_merged(by_prefix, ["w2", "w3"], pairs, "r1"), ["w3"], words, "r2")
    cut = by_suffix.withColumns({"s1": score_of("f", "l1", "r1"), "s2": score_of("f", "l2", "r2")})
    second = F.col("s2") < F.col("s1")
    three = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
        F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = two.union(three).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


#: The registered query in SQL (DuckDB).
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS p FROM docs),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM places WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * p.f * p.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f
                    AND ((t.w1 = p.w1 AND t.w2 = p.w2) OR (t.w2 = p.w1 AND t.w3 = p.w2)))),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2,
         (1000000::HUGEINT * t.f * t.f) // (a1.f::HUGEINT * b1.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (a2.f::HUGEINT * b2.f) AS s2
  FROM f3 t JOIN f1 a1 ON a1.lang = t.lang AND a1.w1 = t.w1 JOIN f2 b1 ON b1.lang = t.lang AND b1.w1 = t.w2 AND b1.w2 = t.w3
            JOIN f2 a2 ON a2.lang = t.lang AND a2.w1 = t.w1 AND a2.w2 = t.w2 JOIN f1 b2 ON b2.lang = t.lang AND b2.w1 = t.w3),
every AS (
  SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000"""
