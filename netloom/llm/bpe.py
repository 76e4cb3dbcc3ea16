"""Byte-level BPE: every distinct word of the corpus is encoded once, ids are joined back.

1. *Pre-tokens.* Each text is cut at the boundaries of the tokenizer's pattern, found over
   whole batches of code points with array operations (:func:`word_starts`).
2. *Explode.* Texts are dealt into blocks of about ``block_bytes``. A block gives the word
   numbers of its texts by position, and its distinct words, dealt by hash of the word into
   parts; both are packed (zstd) and shuffled once by block. Within a block words are numbered
   by content (:func:`~netloom.llm.common.distinct_spans`), no fingerprint decides. If an
   executor is lost, its blocks are made again from the same rows; should the input give other
   rows then, the stamps of a block differ and the job stops instead of mixing them.
3. *Distinct words.* One shuffle brings each part's words together from all blocks, so every
   distinct word of the corpus meets one task, which merges it by rank once and sends the ids
   back to each block that holds it (:func:`_encode_parts`). The number of parts follows the
   size of the texts, so a part's table stays small.
4. *Reassemble.* A cogroup by block puts ids at their positions. No table of words goes to
   the driver or to all tasks, at any size.
5. *Decoding* joins ids to the token-byte table (fixed by the vocabulary) and concatenates.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null id is kept;
repeated rows give repeated results; an empty table gives an empty result; a word of any
length is merged in n log n time; a very long text is one block, tokenised in pieces that
end before a blank and a letter; other columns do not matter.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import BATCH_BYTES, bounded_batches, distinct_spans, free_memory, slices, text_pieces, with_fields

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Pre-tokens that are put at their positions at a time.
STRETCH = 1 << 18
#: Stands between two texts; not a code point.
_EDGE_CODE = 0x110000
#: Fixed values of the pattern: an apostrophe and these letters are a word of their own.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: A pre-token begins at a blank between something that is no white space and a letter.
SAFE_BREAK = regex.compile(r"(?<=\S)(?=\x20\p{L})")
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    global _kinds
    if _kinds is None:
        table = np.zeros(_EDGE_CODE + 1, np.uint8)
        every = np.arange(_EDGE_CODE, dtype=np.uint32)
        at = every[(every < 0xD800) | (every > 0xDFFF)]
        everything = at.tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                table[at[m.start() : m.end()]] = kind
        table[_EDGE_CODE] = EDGE
        _kinds = table
    return _kinds


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where a pre-token begins in ``points``, whose texts are parted (and ended) by an edge."""
    kind = kinds()[points]
    n = len(kind)
    before, after = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    run = (kind != before) | (kind == EDGE)
    start = run.copy()
    # The last white space before something else parts from its run; a blank joins what follows.
    last = np.flatnonzero((kind == SPACE) & (after != SPACE) & (after != EDGE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # An apostrophe that starts a word, with one or two letters of a contraction.
    quote = np.flatnonzero((points == 0x27) & run & start & (after == LETTER))
    if len(quote):
        pad = np.append(points, [_EDGE_CODE, _EDGE_CODE])
        one, two = pad[quote + 1], pad[quote + 2]
        length = np.where(np.isin(one, [ord(c) for c in ONE_LETTER]), 2, 0)
        for pair in TWO_LETTERS:
            length = np.where((length == 0) & (one == ord(pair[0])) & (two == ord(pair[1])), 3, length)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        start[quote + length] = True
    return start


def pre_tokens(values: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts and their code points, starts and ends of all pre-tokens, and the number of each text's."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    joined = "\0".join([*values, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    edges = np.cumsum(lengths + 1) - 1
    points[edges] = _EDGE_CODE
    starts = np.flatnonzero(word_starts(points))
    ends = np.append(starts[1:], len(points))
    real = points[starts] != _EDGE_CODE
    starts, ends = starts[real], ends[real]
    counts = np.diff(np.searchsorted(starts, edges), prepend=0)
    return joined, points, starts, ends, counts


def numbered_words(values: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of some texts, the number of each pre-token in order, and how many each text has."""
    joined, points, starts, ends, counts = pre_tokens(values)
    first, number = distinct_spans(points, starts, ends)
    return [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], number, counts


class Block:
    """Texts of one block: its distinct words, and for each text the word numbers by position."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.size = 0

    def add(self, values: list[str]) -> list[np.ndarray]:
        out = []
        for group in _piece_groups(values):
            words, number, counts = numbered_words([piece for _, piece in group])
            place = np.fromiter((self.words.setdefault(w, len(self.words)) for w in words), np.uint32, len(words))
            cells = np.split(place[number] if len(words) else np.zeros(0, np.uint32), np.cumsum(counts)[:-1])
            for (opens, _), cell in zip(group, cells):
                if opens:
                    out.append([cell])
                else:
                    out[-1].append(cell)
        self.size += sum(map(len, values))
        return [np.concatenate(parts) for parts in out]


def _piece_groups(values: list[str]) -> Iterator[list[tuple[bool, str]]]:
    """Pieces of texts in order, in groups of bounded size; the flag marks a text's first piece."""
    group, size = [], 0
    for text in values:
        for k, piece in enumerate(text_pieces(text, SAFE_BREAK)):
            group.append((k == 0, piece))
            size += len(piece)
            if size >= BATCH_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged, leftmost first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(both := pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, both))
        if (h := left[i]) >= 0 and (r := ranks.get(both := parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, both))
    return [ranks[p] for p in parts if p is not None]


def pack_cells(cells: np.ndarray) -> bytes:
    """Small whole numbers, their bytes sorted by significance and compressed; the size leads."""
    planes = np.ascontiguousarray(cells.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(cells).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_cells(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of words, both packed."""
    joined = b"".join(words)
    packed = len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)
    return pack_cells(np.fromiter(map(len, words), np.uint32, len(words))), packed


def unpack_words(lengths: bytes, packed: bytes) -> list[bytes]:
    stop = np.cumsum(unpack_cells(lengths).astype(np.int64)).tolist()
    joined = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return [joined[a:b] for a, b in zip([0, *stop], stop)]


#: A row of the exploded table is a block's texts (a null part) or its words of one part.
_EXPLODED = "block bigint, part int, {ids} array<{kind}>, stamp binary, counts binary, cells binary, lengths binary, words binary"


def _explode(id_col: str, block_bytes: int, parts: int):
    from pyspark import TaskContext

    names = ["block", "part", id_col, "stamp", "counts", "cells", "lengths", "words"]

    def rows_of(number: int, block: Block, ids: list, numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(numbers)
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(flat, minlength=len(block.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = [w.encode() for w in block.words]
        words = [words[k] for k in order.tolist()]
        ids = pa.concat_arrays(ids)
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        counts = np.fromiter(map(len, numbers), np.uint32, len(numbers))
        stamp = blake2b(b"\0".join(words), digest_size=8).digest()
        packed = [stamp, pack_cells(counts), pack_cells(rank[flat]), None, None]
        head = [pa.array([number]), pa.array([None], pa.int32()), whole]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array([c], pa.binary()) for c in packed)], names=names)
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        by_part = np.argsort(part, kind="stable")
        for own in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(words) else []:
            packed = [stamp, None, pack_cells(own), *pack_words([words[k] for k in own.tolist()])]
            head = [pa.array([number]), pa.array([int(part[own[0]])], pa.int32()), pa.nulls(1, whole.type)]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([c], pa.binary()) for c in packed)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, ids, numbers = TaskContext.get().partitionId() << 32, Block(), [], []
        for batch in batches:
            for part in slices(batch, "body"):
                ids.append(part.column(id_col))
                numbers += block.add(part.column("body").to_pylist())
                if block.size >= block_bytes:
                    yield from rows_of(number, block, ids, numbers)
                    number, block, ids, numbers = number + 1, Block(), [], []
        if numbers:
            yield from rows_of(number, block, ids, numbers)
        block, ids, numbers = None, [], []
        free_memory()

    return run


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["block", "part", "stamp", "cells", "lengths", "words"]
    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column("part"))).select(names)


def _encode_parts(ranks_in):
    """Ids of the words of each row; rows come sorted by part, and a word of a part is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, current = ranks_in.value, {}, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != current:
                    known, current = {}, row["part"]
                codes = []
                for word in unpack_words(row["lengths"], row["words"]):
                    code = known.get(word)
                    if code is None:
                        code = known[word] = array("I", merge(word, ranks)).tobytes()
                    codes.append(code)
                sizes = np.fromiter((len(c) // 4 for c in codes), np.uint32, len(codes))
                out.append((row["block"], row["stamp"], row["cells"], pack_cells(sizes), pack_cells(np.frombuffer(b"".join(codes), np.uint32))))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["of_block", "stamp", "cells", "sizes", "ids"],
            )
        known = None
        free_memory()

    return run


def _reassemble(id_col: str):
    """Ids of each text of a block: those of its words, by position."""

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        places, sizes, codes = (
            [unpack_cells(c) for c in words.column(n).to_pylist()] for n in ("cells", "sizes", "ids")
        )
        flat = np.concatenate([np.zeros(0, np.uint32), *codes]).astype(np.int32)
        size = np.concatenate([np.zeros(0, np.uint32), *sizes]).astype(np.int64)
        # Words stand in the order of their parts: begin and length by word number.
        order = np.concatenate([np.zeros(0, np.uint32), *places]).astype(np.int64)
        begin, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        begin[order], length[order] = np.cumsum(size) - size, size
        texts = texts.filter(pc.is_null(texts.column("part")))
        row = texts.select(["stamp", "counts", "cells"]).to_pylist()[0]
        if any(stamp != row["stamp"] for stamp in words.column("stamp").to_pylist()):
            raise RuntimeError("a block was made twice from different rows: the input gives other rows when it is read again")
        number = unpack_cells(row["cells"])
        edges = np.concatenate([[0], np.cumsum(unpack_cells(row["counts"]).astype(np.int64))])
        stops = np.zeros(len(number) + 1, np.int64)
        np.cumsum(length[number], out=stops[1:])
        found = np.empty(int(stops[-1]), np.int32)
        for k in range(0, len(number), STRETCH):
            some = number[k : k + STRETCH]
            long, stop = length[some], stops[k + 1 : k + 1 + STRETCH]
            at = np.arange(int(stops[k]), int(stop[-1])) + np.repeat(begin[some] - (stop - long), long)
            found[stops[k] : stop[-1]] = flat[at]
        ends = stops[edges]
        ids = texts.column(id_col).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table({
            id_col: ids.flatten(),
            "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found, pa.int32())),
        })

    return run


def encode(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 8 << 20,
    part_bytes: int = 8 << 20,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row's whole text.

    ``part_bytes``: texts of this size give one part of the distinct words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    parts = max(16, (rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // part_bytes)
    schema = _EXPLODED.format(ids=f"`{id_col}`", kind=rows.schema[id_col].dataType.simpleString())
    # One shuffle by block carries both kinds of rows, and both readers share it. They pick
    # their rows themselves: a filter would be pushed below the shuffle and part it in two.
    exploded = rows.mapInArrow(_explode(id_col, block_bytes, parts), schema).repartition("block")
    words = exploded.mapInArrow(_words_only, "block bigint, part int, stamp binary, cells binary, lengths binary, words binary")
    coded = words.repartition("part").sortWithinPartitions("part").mapInArrow(
        _encode_parts(ranks), "of_block bigint, stamp binary, cells binary, sizes binary, ids binary"
    )
    return exploded.groupBy("block").cogroup(coded.groupBy("of_block")).applyInArrow(
        _reassemble(id_col), with_fields(rows, [id_col], "ids array<int>")
    )


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded`` (binary): ids joined to the token-byte table."""
    tokens = load_ranks(ranks_path)
    by_id = [b""] * (max(tokens.values(), default=-1) + 1)
    for token, rank in tokens.items():
        by_id[rank] = token
    lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
    table = encoded.sparkSession.sparkContext.broadcast(
        (np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, at = table.value
        size = np.diff(at)
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                column = part.column(ids_col)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
                length = size[flat]
                stop = np.cumsum(length)
                total = int(stop[-1]) if len(stop) else 0
                source = np.arange(total, dtype=np.int64) + np.repeat(at[flat] - (stop - length), length)
                raw = data[source]
                edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
                texts = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, with_fields(encoded, encoded.columns, "decoded binary"))
