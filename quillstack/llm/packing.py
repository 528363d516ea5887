"""Packing documents into training sequences by first-fit decreasing over a tournament tree.

Documents are encoded, dealt into randomised groups by a hash of id and content, and each group is
packed on its own, so packing needs one shuffle of two-byte ids and no state beyond a group. A task
packs what it holds of a group whenever that reaches a bound of rows or of ids and goes on with the
rest, so rows repeated without end can't fill its memory. Whole
sequences are cut off long documents first. The remainders go, longest first, into the first bin
with room, found in log time by descending a tree of maximal bin capacities. The least filled bin of
a group is then dissolved: into the larger gaps of other bins, and what is left into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import END_ID

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class BinTree:
    """A tournament tree over the free room of bins: the leftmost bin with enough room in O(log n)."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Take `length` from the first bin that has it and return the bin."""
        room = self.room
        at = 1
        while at < self.size:
            at = 2 * at if room[2 * at] >= length else 2 * at + 1
        found = at - self.size
        room[at] -= length
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items are at most `capacity` long. Ties keep their order."""
    tree, out = BinTree(len(lengths), capacity), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.place(lengths[i])
    return out


def pack(lengths: list[int], capacity: int = 4096, least_gap: int = 64) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) covering every id of every item once."""
    pieces, sequence = [], 0
    rest: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((item, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((item, n - n % capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for piece, b in zip(rest, first_fit_decreasing([r[2] for r in rest], capacity), strict=True):
        bins.setdefault(b, []).append(piece)
    held = {b: sum(p[2] for p in ps) for b, ps in bins.items()}
    loose: list[tuple[int, int, int]] = []
    if held:
        least = min(held, key=lambda b: (held[b], -b))
        if held[least] & (held[least] - 1):
            loose = bins.pop(least)
            held.pop(least)
    left = sum(p[2] for p in loose)
    for b in sorted(bins, key=lambda b: held[b]):
        gap = capacity - held[b]
        if gap < least_gap or not left:
            break
        if not held[b] & (held[b] - 1):
            continue
        taken, loose = take(loose, min(gap, left))
        bins[b] += taken
        left -= sum(p[2] for p in taken)
    while left:
        part = 1 << left.bit_length() - 1
        taken, loose = take(loose, part)
        bins[max(bins, default=0) + 1] = taken
        left -= part
    for b in sorted(bins):
        offset = 0
        for item, start, n in bins[b]:
            pieces.append((item, start, n, sequence, offset))
            offset += n
        sequence += 1
    return pieces


def take(pieces: list[tuple[int, int, int]], n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The first n ids of the pieces, and the rest; a piece is cut where it must be."""
    taken, pieces = [], list(pieces)
    while n:
        item, start, length = pieces.pop(0)
        taken.append((item, start, min(length, n)))
        if length > n:
            pieces.insert(0, (item, start + n, length - n))
        n -= min(length, n)
    return taken, pieces


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ids (little-endian u16 where the vocabulary allows it, else u32) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, "ranked")
        narrow = max(bpe.vocab.values(), default=0) < 1 << 16 and max(bpe.added.values(), default=0) < 1 << 16
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py()) + end
                out.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([2 if narrow else 4] * len(out), pa.int32())], names=["doc_id", "ids", "width"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id bigint, ids binary, width int")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, group_rows: int = 1024, group_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone. Rows repeated with one id, or with a null id, are packed
    as documents of their own. An empty table gives no pieces; other columns are ignored. Groups hold
    about `group_rows` documents whatever the size of the table; one that comes out twice as large
    (the same row again and again), or holds `group_bytes` of ids, is packed in several goes.
    """
    groups = max(1, -(-docs.count() // group_rows))
    rows = encoded(docs, path, id_col, text_col).withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.col("ids"), F.lit(seed)), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sequence = None, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence, size
            held.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1]))
            cols: list[list] = [[] for _ in range(7)]
            taken = -1
            for item, start, n, bin_, offset in pack([len(ids) // 4 for _, ids in held], capacity):
                name, ids = held[item]
                row = (name, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, (group << 32) + sequence + bin_, offset)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                taken = max(taken, bin_)
            sequence += taken + 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECES.fieldNames())

        for batch in batches:
            width = batch.column(2)[0].as_py() if batch.num_rows else 4
            for name, ids, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), strict=True):
                if held and (key != group or len(held) >= 2 * group_rows or size >= group_bytes):
                    yield packed()
                if key != group:
                    group, sequence = key, 0
                raw = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4").tobytes()
                held.append((name, raw))
                size += len(raw)
        if held:
            yield packed()

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, PIECES)
