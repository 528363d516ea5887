"""WARC: a converter for the legacy ARC container, and a de-duplicating archive writer and reader.

An ARC file opens with a version block whose last line names the fields of every header line that
follows: five in version 1, ten in version 2. A header line ends in the declared length of what
follows it. The converter walks those lines and lengths and synthesises what WARC asks for: record
identifiers, ISO timestamps, record types, block and payload digests. Pages are written as ARC
blocks, converted, and stored as WARC files with one gzip member per record; results are read back
from those files alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, copied, dealt, hot_keys
from .token_files import store

#: Field names of the two ARC versions, and the WARC revisit profile.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER, ORIGIN_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def arc_url(url: str | None, page_id) -> str:
    """A URL fit for a blank-separated line; a missing one becomes a URN of the page."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_file(records: list[tuple[str, str, str, bytes]], version: int, name: str, date: str) -> bytes:
    """An ARC file of (url, ip, mime type, network document) records."""
    about = f"{version} 0 quillstack\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = bytearray()

    def line(url: str, ip: str, kind: str, block: bytes) -> bytes:
        middle = [] if version == 1 else ["200", hashlib.md5(block).hexdigest(), "-", str(len(out)), name]
        return (" ".join([url, ip, date, kind, *middle, str(len(block))]) + "\n").encode()

    for url, ip, kind, block in [(f"filedesc://{name}", "0.0.0.0", "text/plain", about), *records]:
        out += line(url, ip, kind, block) + block + b"\n"
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block; fields are counted from the right of a line,
    so a URL with blanks keeps them. Broken lines or lengths raise ValueError."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("ARC header line without an end")
        parts = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        wanted = names or ARC_FIELDS[1] if len(parts) < 10 or names else ARC_FIELDS[2]
        if len(parts) < len(wanted) or not parts[-1].isdigit():
            raise ValueError(f"bad ARC header line: {data[at:stop][:80]!r}")
        keep = len(parts) - len(wanted) + 1
        values = dict(zip(wanted, [" ".join(parts[:keep]), *parts[keep:]], strict=True))
        length = int(values["Archive-length"])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError("ARC record shorter than its declared length")
        at = stop + 1 + length
        if names is None:
            if not values["URL"].startswith("filedesc://"):
                raise ValueError("ARC file without a version block")
            names = block.decode("utf-8", "replace").split("\n")[1].strip().split(" ")
        else:
            yield ArcRecord(values, block)


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """The header part with its blank line, its fields, and the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(data: bytes) -> str:
    return "sha256:" + base64.b16encode(hashlib.sha256(data).digest()).decode().lower()


def convert(record: ArcRecord, origin: tuple | None = None) -> WarcRecord:
    """The WARC equivalent of an ARC record; origin (page id, url) makes it a revisit without payload."""
    head, http, payload = split_http(record.block)
    page = http.get(PAGE_HEADER.lower(), "")
    block = head if origin else record.block
    headers = {
        "WARC-Type": "revisit" if origin else "response",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": warc_date(record.fields["Archive-date"]),
        "WARC-Target-URI": record.fields["URL"],
        "WARC-IP-Address": record.fields["IP-address"],
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": digest(payload),
    }
    if origin:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(origin[0]), "WARC-Refers-To-Target-URI": origin[1], ORIGIN_HEADER: str(origin[0]), "WARC-Truncated": "length"}
    return WarcRecord(headers, block)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of an uncompressed WARC file; digests of blocks and of stored payloads are verified."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers.pop("Content-Length"))
        block = data[stop + 4 : stop + 4 + length]
        if len(block) < length or digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError("damaged WARC record")
        yield WarcRecord(headers, block)
        at = stop + 4 + length + 4


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])
RESULT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, file_bytes: int = 8 << 20, date: str = "19700101000000") -> DataFrame:
    """Write every page; the committed manifest (path, n_records) lists the files that count.

    Payloads are equal by SHA-256; only digests and ids are grouped, with map-side combining. Payloads of
    at least `least` bytes then meet the first of their digest, and a digest that many pages share is dealt
    into slices by page and url; smaller ones, which never refer to others, are written where they are read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("_key", F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256)))
    large = rows.where("_key is not null")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("_first")
    firsts = scratch.keep(large.groupBy("_key").agg(first, F.count(F.lit(1)).alias("_n")).where("_n > 1"), "firsts")
    hot = scratch.keep(hot_keys(firsts, "_key", "_n", pages.count()), "hot")
    origin = F.when(~F.col("_first.page_id").eqNullSafe(F.col("page_id")), F.col("_first.page_id")).alias("origin")
    met = dealt(large, hot, "_key", "page_id", "url").join(copied(firsts.drop("_n"), hot, "_key").hint("merge"), ["_key", "_s"], "left")
    met = met.select("page_id", "url", "html", origin, F.col("_first.url").alias("origin_url"))
    small = rows.where("_key is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("origin"), F.lit(None).cast("string").alias("origin_url"))
    shown = met.unionByName(small)
    folder = scratch.path("files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = store(folder)
        target.create_dir(root, recursive=True)
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        records: list = []
        origins: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal records, origins, held, seq
            name = f"{part:07d}-{seq:05d}-{attempt}"
            arc = arc_file(records, 1 + seq % 2, f"{name}.arc", date)
            with target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as f:
                for record, origin in zip(parse_arc(arc), origins, strict=True):
                    f.write(gzip.compress(convert(record, origin).to_bytes(), 1, mtime=0))
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([len(records)], pa.int64())], names=MANIFEST.fieldNames())
            records, origins, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            page, url, html, origin, origin_url = batch.columns
            for i in range(batch.num_rows):
                key, body = page[i].as_py(), html[i].as_py().encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{PAGE_HEADER}: {'' if key is None else key}\r\n\r\n"
                records.append((arc_url(url[i].as_py(), key), "0.0.0.0", "text/html", head.encode() + body))
                first = origin[i].as_py()
                origins.append(None if first is None else (first, arc_url(origin_url[i].as_py(), first)))
                held += len(body) + 200
                if held >= file_bytes:
                    yield flush()
        if records:
            yield flush()

    return scratch.keep(shown.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per record read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = store(path)
                with source.open_input_stream(name, compression=None) as f:
                    data = f.read()
                out = []
                for record in (r for part in gzip_members(data) for r in parse_warc(part)):
                    _, http, payload = split_http(record.block)
                    kind, named = record.headers["WARC-Type"], record.headers["WARC-Payload-Digest"]
                    if kind == "response" and digest(payload) != named:
                        raise ValueError("payload does not match its digest")
                    page, first = http[PAGE_HEADER.lower()], record.headers.get(ORIGIN_HEADER)
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    out.append((int(page) if page else None, size, named.partition(":")[2], kind, int(first) if first else None))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=RESULT.fieldNames())

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(files, "path").mapInArrow(run, RESULT)


def gzip_members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each; input is fed in small steps, so that what lies
    beyond a member is not copied for every member."""
    at = 0
    while at < len(data):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("gzip member without an end")
            step = data[at : at + 16384]
            out.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        yield b"".join(out)


def warc_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every page by way of ARC and read the archives back.

    A null html is an empty payload. Of equal payloads of at least 100 bytes the smallest page id (a
    null id last) is the response; rows repeated with that id are responses too. A null or blank URL
    becomes a URN, and characters that would break a header line are percent-encoded. An empty table
    writes nothing and gives an empty result; other columns are ignored.
    """
    return read_archives(write_archives(pages, Scratch(pages.sparkSession, "warc"), id_col, url_col, html_col))
