"""Helpers shared by the text operators: tables, Arrow text buffers, hashing, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b
from re import Pattern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.session import materialize  # noqa: F401  (re-exported)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
BATCH_BYTES = 1 << 20
#: Spans from this length on are fingerprinted by a cryptographic hash: the polynomial has
#: collisions (Thue-Morse words) that start at 1,024 symbols.
LONG_SPAN = 384
_BASE = 0x5851F42D4C957F2D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ASCII text takes the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def with_fields(rows: DataFrame, carried: list[str], ddl: str) -> StructType:
    """The schema of some columns of ``rows`` and new fields."""
    return StructType([rows.schema[c] for c in carried] + StructType.fromDDL(ddl).fields)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Let Arrow batches hold few rows: texts are long, and 10,000 of them have no useful bound.

    Set for the session, since plans read it when they run; a smaller setting stays.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_memory() -> None:
    """Give what a task has freed back to the system: a Python worker lives on, idle or in another task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text; one text is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column]) if column.offset else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(data: np.ndarray, offsets: np.ndarray, before: int, after: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``before`` and ``after`` bytes of ``fill`` around each; starts of the texts."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * (before + after), fill, np.uint8)
    starts = offsets[:-1] + np.arange(n, dtype=np.int64) * (before + after) + before
    lengths = np.diff(offsets)
    out[np.arange(len(data), dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)] = data
    return out, starts


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection for each seed)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + (1 << 18))
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * BATCH_BYTES:  # for one very long text: not kept
            return tables
        _powers[:] = tables
    return _powers


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each ``symbols[start:end]``.

    Below ``LONG_SPAN`` symbols a polynomial over mixed symbols, modulo 2**64, otherwise BLAKE2b.
    """
    up, down = _power_tables(len(symbols) + 1)
    if symbols.dtype == np.uint8:
        values = mix(np.arange(1, 257), seed + 1)[symbols]
    elif symbols.dtype == np.uint32 and len(symbols) > 4096:
        # Most code points are small: a table gives their mixed values.
        values = mix(np.arange(1, 4097), seed + 1)[np.minimum(symbols, 4095)]
        high = np.flatnonzero(symbols > 4095)
        values[high] = mix(symbols[high].astype(np.uint64) + np.uint64(1), seed + 1)
    else:
        values = mix(symbols.astype(np.uint64) + np.uint64(1), seed + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(values * up[: len(symbols)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    found = mix(raw ^ ((ends - starts).astype(np.uint64) * _M2), seed)
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        span = np.ascontiguousarray(symbols[starts[i] : ends[i]])
        found[i] = int.from_bytes(blake2b(span, digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")
    return found


def _alike(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span equals the span whose number stands in ``other``, symbol by symbol."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    return np.array_equal(symbols[within + np.repeat(starts, size)], symbols[within + np.repeat(starts[other], size)])


def distinct_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each content, and for every span the number of its content.

    Contents are told apart by fingerprint, and each span is then compared with the first of
    its number; if any two fingerprints meet, spans are numbered by content instead.
    """
    keys = span_hashes(symbols, starts, ends, 3)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    number = number.reshape(-1)
    if _alike(symbols, starts, ends, first[number]):
        return first, number
    seen: dict[bytes, int] = {}
    spans = zip(starts.tolist(), ends.tolist())
    number = np.fromiter((seen.setdefault(symbols[a:b].tobytes(), len(seen)) for a, b in spans), np.int64, len(starts))
    return np.unique(number, return_index=True)[1], number


def text_pieces(text: str, breaks: Pattern, limit: int = BATCH_BYTES) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut only where ``breaks`` matches the next piece's start."""
    at = 0
    while len(text) - at > limit and (m := breaks.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text
