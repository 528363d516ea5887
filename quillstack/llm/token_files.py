"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents, two bytes each where the vocabulary allows it, the
ends of the documents in the id array as an Elias-Fano sequence, and their document ids as another.
Elias-Fano keeps the low bits of each value packed and the high bits in unary, about 2 + log2(u / n)
bits a value; a sampled select structure, stored with it, returns any boundary without a table of
64-bit offsets. Reading back asks select for every boundary and every id.
Rows are range-partitioned and sorted by id, so files in name order hold the corpus in id order, and
the only state on the driver is one total per range partition.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .common import END_ID, Scratch

MAGIC = b"QTOKEN02"
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n integers below `universe`, with select access.

    `hint` holds the byte of the upper bits in which every SAMPLE-th value lies, `before` how many of
    the values of that sample's run of bytes come before it (under 8): both are stored with the
    sequence, so opening a file builds nothing.
    """

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, hint: bytes | None = None, before: bytes | None = None):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        if hint is None:
            counts = np.cumsum(np.bitwise_count(np.frombuffer(high, np.uint8)), dtype=np.int64)
            wanted = np.arange(0, n, SAMPLE)
            at = np.searchsorted(counts, wanted + 1)
            hint = at.astype("<u4").tobytes()
            before = (wanted - np.where(at > 0, counts[at - 1], 0) if n else at).astype(np.uint8).tobytes()
        self.hint, self.before = hint, before
        self._hint = memoryview(hint).cast("I") if len(hint) else ()

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = np.asarray(values, np.uint64)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        if bits:
            planes = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(planes.ravel(), bitorder="little").tobytes()
        else:
            low = b""
        upper = np.zeros(n + (universe >> bits) + 1, np.uint8)
        upper[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(upper, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th value: from its sample, the few bytes after that, and its own low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        byte, left = self._hint[k], i - k * SAMPLE + self.before[k]
        high = self.high
        while (ones := high[byte].bit_count()) <= left:
            left, byte = left - ones, byte + 1
        rest = high[byte]
        for _ in range(left):
            rest &= rest - 1
        value = byte * 8 + (rest & -rest).bit_length() - 1 - i
        if not self.bits:
            return value
        first = i * self.bits
        stop = first + self.bits
        own = int.from_bytes(self.low[first >> 3 : (stop + 7) >> 3], "little") >> (first & 7)
        return value << self.bits | own & (1 << self.bits) - 1

    def to_bytes(self) -> bytes:
        parts = (self.low, self.high, self.hint, self.before)
        return struct.pack("<QQQQQQ", self.n, self.bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def parse(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = struct.unpack_from("<QQQQQQ", data, at)
        at += 48
        parts = []
        for size in sizes:
            parts.append(bytes(data[at : at + size]))
            at += size
        return cls(n, bits, *parts), at


def pack_file(doc_ids: list, lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """One file: documents in ascending id order, null ids first."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    known = np.asarray([d for d in doc_ids if d is not None], np.int64)
    lowest = int(known[0]) if len(known) else 0
    head = MAGIC + struct.pack("<QQqQ", width, len(doc_ids) - len(known), lowest, len(ids))
    named = EliasFano.of((known.astype(object) - lowest).astype(np.uint64) if len(known) else known, int(known[-1]) - lowest if len(known) else 0)
    return head + EliasFano.of(ends, int(ends[-1]) if len(ends) else 0).to_bytes() + named.to_bytes() + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """Reads what pack_file wrote; documents are reached through select, not an offset table."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        self.width, self.nulls, self.lowest, n = struct.unpack_from("<QQqQ", view, 8)
        self.ends, at = EliasFano.parse(view, 40)
        self.named, at = EliasFano.parse(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", n, at)

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i starts and ends in the id array."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, stop = self.bounds(i)
        return self.ids[start:stop]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.named.select(i - self.nulls) + self.lowest


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI as Spark writes it (file:/x as well as file:///x)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
READ_ROWS = 10_000
READ = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_token_files(docs: DataFrame, path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = 4_000_000) -> DataFrame:
    """Encode and write; returns the committed manifest (part, seq, path, n_docs, n_ids).

    Every attempt of a task writes files of its own names, and only the attempt whose rows reach the
    manifest counts, so a lost executor leaves no file that a reader would take.
    """
    folder = scratch.path("files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, "ranked")
        width = 2 if max(bpe.strings, default=0) < 1 << 16 else 4
        target, root = store(folder)
        target.create_dir(root, recursive=True)
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        end = np.asarray([END_ID], "<u4").tobytes()
        names, lengths, coded, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, lengths, coded, held, seq
            name = f"{root}/{part:07d}-{seq:05d}-{attempt}.tok"
            with target.open_output_stream(name) as f:
                f.write(pack_file(names, lengths, np.frombuffer(b"".join(coded), "<u4"), width))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{name.rpartition('/')[2]}", "n_docs": len(names), "n_ids": held}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            names, lengths, coded, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                names.append(key)
                lengths.append(len(ids) // 4)
                coded.append(ids)
                held += len(ids) // 4
                if held >= ids_per_file:
                    yield flush()
        if names:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash of the text cuts a range of one repeated (or null) id as well
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return scratch.keep(rows.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    spark = manifest.sparkSession
    base, bases = 0, []
    for row in sorted(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((row["part"], base))
        base += row["n"]
    known = spark.createDataFrame(bases, "part int, part_base bigint")
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("earlier", earlier).join(known, "part").select("path", (F.col("earlier") + F.col("part_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, name = store(path)
                with source.open_input_stream(name) as f:
                    file = TokenFile(f.read())
                for at in range(0, len(file), READ_ROWS):
                    cols: tuple[list, list, list, list] = ([], [], [], [])
                    for i in range(at, min(at + READ_ROWS, len(file))):
                        start, stop = file.bounds(i)
                        row = (file.doc_id(i), first + start, stop - start, zlib.crc32(file.ids[start:stop].astype("<u4")))
                        for col, value in zip(cols, row, strict=True):
                            col.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=READ.fieldNames())

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(files, "path").mapInArrow(run, READ)


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files for every document and read them back.

    A null or empty text is the end id alone. Null document ids come first, before all others; rows
    repeated with one id are written one after the other, in the order of a hash of the text. An empty table writes no
    file and gives an empty result. Other columns of the input are ignored.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, scratch, id_col, text_col))
