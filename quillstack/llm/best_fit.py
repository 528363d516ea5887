"""Best-two-fit packing of whole documents into sequences.

Documents are encoded and longer ones cut into pieces of a whole sequence. Pieces are dealt into
randomised groups by a hash, and each group is packed on its own: a bin is filled greedily with the
longest pieces that fit, and when nothing fits any more its smallest piece is given back if two
unpacked pieces together fill the gap it leaves more tightly. The unpacked pieces of a group are
counted by length; the set of lengths is one integer used as a row of bits, so the longest length that
fits and the pair with the largest sum are found by shifts instead of searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec

#: The end-of-document id of these sequences.
END_ID = 0

PIECES = "doc_id bigint, piece int, start bigint, ids binary, salt bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


class Unpacked:
    """How many items of each length are unpacked, with the lengths in use as bits, forwards and mirrored."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.many = capacity, [0] * (capacity + 1)
        self.bits = self.mirror = 0
        for n in lengths:
            self.add(n)

    def add(self, n: int) -> None:
        if not self.many[n]:
            self.bits |= 1 << n
            self.mirror |= 1 << self.capacity - n
        self.many[n] += 1

    def take(self, n: int) -> None:
        self.many[n] -= 1
        if not self.many[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << self.capacity - n

    def longest(self, room: int) -> int:
        """The longest unpacked length of at most `room`, or 0."""
        return (self.bits & (1 << room + 1) - 1).bit_length() - 1 if room > 0 and self.bits & (1 << room + 1) - 1 else 0

    def pair(self, room: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum above `above` and of at most `room`; of those, the longest first."""
        for total in range(min(room, self.capacity), above, -1):
            # bit i: lengths i and total - i are both there
            both = self.bits & (self.mirror >> self.capacity - total) if total <= self.capacity else 0
            while both:
                n = both.bit_length() - 1
                if 2 * n < total:
                    break
                if 2 * n > total or self.many[n] > 1:
                    return n, total - n
                both ^= 1 << n
        return None


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items (by number) of every bin; each has 1 to `capacity` ids. Items of equal length keep their order."""
    left = Unpacked(lengths, capacity)
    waiting: dict[int, list[int]] = {}
    for item in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[item], []).append(item)
    bins = []
    while left.bits:
        held, room = [], capacity
        while n := left.longest(room):
            left.take(n)
            held.append(n)
            room -= n
        if room and len(held) > 1 and (two := left.pair(room + held[-1], held[-1])):
            for n in two:
                left.take(n)
            left.add(held.pop())
            held += two
        bins.append([waiting[n].pop() for n in held])
    return bins


def pieces_of(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """PIECES: the ids of every piece (little-endian unsigned 32-bit), with a salt.

    The salt deals rows repeated with one id and text: it holds the task and how many thousands of the
    same row the task has met, whatever their order, so a task run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, part = codec(path, "ranked"), np.asarray([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 24
        met: dict[int, int] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                same = hash((key, ids))
                met[same] = seen = met.get(same, -1) + 1
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    for column, value in zip(columns, (key, piece, start, ids[4 * start : 4 * (start + capacity)], part + (seen >> 10)), strict=True):
                        column.append(value)
                size += len(ids)
                if size > 8 << 20:
                    yield pieces(columns)
                    columns, size = [[] for _ in range(5)], 0
            if columns[0]:
                yield pieces(columns)

    def pieces(columns: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "ids", "salt"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, PIECES)


def pack_whole(docs: DataFrame, path: str, capacity: int = 2048, group_rows: int = 4096, group_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: one row per piece, with its ids.

    Only documents of more than `capacity` ids are cut, into whole sequences and what is left. A null or
    empty text is the end id alone. Rows repeated with one id, or with a null id, are packed as
    documents of their own. An empty table gives no pieces; other columns are ignored. Groups hold about
    `group_rows` documents whatever the size of the table; one that comes out twice as large, or with
    `group_bytes` of ids, is packed in several goes, in an order that doesn't depend on the shuffle.
    """
    groups = max(1, -(-docs.count() // group_rows))
    rows = pieces_of(docs, path, capacity, id_col, text_col)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids", "salt", F.lit(seed)), F.lit(groups))).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sequence = None, 0
        held: list[tuple[int | None, int, int, bytes]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence, size
            columns: list[list] = [[] for _ in range(7)]
            for items in best_two_fit([len(row[3]) // 4 for row in held], capacity):
                offset = 0
                for item in items:
                    key, piece, start, ids = held[item]
                    for column, value in zip(columns, (key, piece, start, len(ids) // 4, ids, (group << 32) + sequence, offset), strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                sequence += 1
            held.clear()
            size = 0
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

        for batch in batches:
            for key, piece, start, ids, grp in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (grp != group or len(held) >= 2 * group_rows or size >= group_bytes):
                    yield packed()
                if grp != group:
                    group, sequence = grp, 0
                held.append((key, piece, start, ids))
                size += len(ids)
        if held:
            yield packed()

    order = ["grp", "doc_id", "piece", "ids"]
    return rows.repartition("grp").sortWithinPartitions(*order).mapInArrow(run, PLACED)
