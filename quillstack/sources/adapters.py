"""Input adapters as a Spark data source: files of documents as rows of pages, chosen by a registered id.

    register(spark)
    spark.read.format("quill-pages").option("adapter", "page-text").load(folder)

Every file of the folder is one document, named before the adapter's suffix; files are planned in
partitions of bounded bytes, and a filter on `document` prunes them before any is opened. `quill-files`
writes rows (path, content) as files: tasks write into folders of their own attempt and check every file
by its hash after the copy, and a reader takes what the commit lists. A task that is killed leaves
nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .strict_json import strict_load

PAGES = "document string, page int, ord int, kind string, source string"
COMMITTED = "_committed.json"
#: Files are planned together up to so many bytes.
PARTITION_BYTES = 32 << 20


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder as Spark writes it: a plain path, file:/x and file:///x alike."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


# -- the registry ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Adapter:
    """What an input format is called, which operations it offers, and how a file becomes (page, ord, kind, source)."""

    id: str
    suffix: str
    operations: frozenset[str]
    rows: Callable[[bytes], Iterator[tuple[int, int, str, str]]]


def page_text(content: bytes) -> Iterator[tuple[int, int, str, str]]:
    """Form feeds end pages; a blank last page is dropped."""
    pages = content.decode("utf-8").split("\f")
    if not pages[-1].strip():
        pages.pop()
    for page, text in enumerate(pages, 1):
        yield page, 0, "page", text


def content_items(content: bytes) -> Iterator[tuple[int, int, str, str]]:
    """The items of a strict JSON list, in their order; pages count from 1."""
    items = strict_load(content)
    if not isinstance(items, list):
        raise ValueError("a content list is a JSON array")
    for place, item in enumerate(items):
        page = item.get("page_idx") if isinstance(item, dict) else None
        if not isinstance(page, int) or isinstance(page, bool) or page < 0:
            raise ValueError(f"item {place} has no page")
        yield page + 1, place, str(item.get("type", "")), str(item.get("text", ""))


ADAPTERS: dict[str, Adapter] = {}


def offer(adapter: Adapter) -> None:
    """Register an adapter; an id is taken once."""
    if adapter.id in ADAPTERS:
        raise ValueError(f"adapter {adapter.id} is registered already")
    ADAPTERS[adapter.id] = adapter


offer(Adapter("page-text", ".txt", frozenset({"source"}), page_text))
offer(Adapter("content-list", "_content_list.json", frozenset({"import"}), content_items))


def adapter_for(adapter_id: str | None, operation: str | None = None) -> Adapter:
    """The adapter of an id; unknown ids, and operations that it doesn't offer, are refused."""
    found = ADAPTERS.get(adapter_id or "")
    if found is None:
        raise ValueError(f"unknown adapter {adapter_id!r}; known are {', '.join(sorted(ADAPTERS))}")
    if operation is not None and operation not in found.operations:
        raise ValueError(f"adapter {adapter_id!r} has no operation {operation!r}")
    return found


# -- reading -----------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """What one task reads: files (name, path), or all that a task's manifest (path, hash) lists."""

    files: list[tuple[str, str]] = field(default_factory=list)
    manifest: tuple[str, str] | None = None


def checked_body(at: fs.FileSystem, path: str, sha256: str | None) -> bytes:
    """A file's bytes; what differs from its hash in the commit is refused."""
    with at.open_input_stream(path) as f:
        body = f.read()
    if sha256 is not None and hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError(f"{path} has changed since the commit")
    return body


class PageReader(DataSourceReader):
    def __init__(self, folder: str, adapter: Adapter, most: int):
        self.folder, self.adapter, self.most = folder, adapter, most
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on the document prunes files; other filters are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("document",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One for each manifest of the commit, so planning holds a line for a writing task and not for a file;
        a folder without a commit is listed, and its files are planned together up to a bound of bytes."""
        at, root = store(self.folder)
        if at.get_file_info(f"{root}/{COMMITTED}").type == fs.FileType.File:
            return [Files(manifest=(f"{root}/{m['path']}", m["sha256"])) for m in json.loads(checked_body(at, f"{root}/{COMMITTED}", None)) if m["files"]] or [Files()]
        out, held = [Files()], 0
        infos = at.get_file_info(fs.FileSelector(root, recursive=False))
        for info in sorted((i for i in infos if i.type == fs.FileType.File and self.document(i.base_name) is not None), key=lambda i: i.base_name):
            if out[-1].files and held + info.size > self.most:
                out.append(Files())
                held = 0
            out[-1].files.append((info.base_name, info.path))
            held += info.size
        return out

    def document(self, name: str) -> str | None:
        """The document of a file name; None if the file is none of the adapter's, or is not asked for."""
        if not name.endswith(self.adapter.suffix) or name.startswith(("_", ".")):
            return None
        found = name[: -len(self.adapter.suffix)]
        return found if self.wanted is None or found in self.wanted else None

    def read(self, partition: Files) -> Iterator[tuple]:
        at, root = store(self.folder)
        files = [(name, path, None) for name, path in partition.files]
        if partition.manifest:
            lines = checked_body(at, *partition.manifest).decode().splitlines()
            files = [(m["path"], f"{root}/{m['file']}", m["sha256"]) for m in map(json.loads, lines)]
        for name, path, sha256 in files:
            document = self.document(name)
            if document is not None:
                for row in self.adapter.rows(checked_body(at, path, sha256)):
                    yield (document, *row)


class Pages(DataSource):
    """Options: path, adapter, and operation, which must be one of the adapter's."""

    @classmethod
    def name(cls) -> str:
        return "quill-pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        found = adapter_for(self.options.get("adapter"), self.options.get("operation"))
        return PageReader(self.options["path"], found, int(self.options.get("partitionbytes", PARTITION_BYTES)))


def safe_name(path: str | None) -> bool:
    """Relative, without .. parts, backslashes or NUL."""
    return bool(path) and not re.search(r"^/|^[A-Za-z]:|\\|\x00", path) and not {"", ".", ".."} & set(path.split("/"))


# -- writing -----------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its manifest, and its folder in case of an abort."""

    folder: str
    path: str
    sha256: str
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex[:12]
        at, root = store(folder)
        if not overwrite and at.get_file_info(f"{root}/{COMMITTED}").type == fs.FileType.File:
            raise ValueError(f"{folder} has been written already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, root = store(self.folder)
        mine = f"part-{self.run}-{uuid.uuid4().hex[:12]}"
        at.create_dir(f"{root}/{mine}", recursive=True)
        lines = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = content.as_py() or b""
                if not safe_name(name):
                    raise ValueError(f"unsafe path {name!r}")
                file = f"{mine}/{len(lines):07d}"
                with at.open_output_stream(f"{root}/{file}") as f:
                    f.write(body)
                with at.open_input_stream(f"{root}/{file}") as f:
                    digest = hashlib.sha256(f.read()).hexdigest()
                if digest != hashlib.sha256(body).hexdigest():
                    raise ValueError(f"{name} was not copied whole")
                lines.append(json.dumps({"path": name, "file": file, "bytes": len(body), "sha256": digest}))
        body = "".join(line + "\n" for line in lines).encode()
        with at.open_output_stream(f"{root}/{mine}/_manifest.jsonl") as f:
            f.write(body)
        return Written(mine, f"{mine}/_manifest.jsonl", hashlib.sha256(body).hexdigest(), len(lines))

    def commit(self, messages: list[Written | None]) -> None:
        """One small file that names the tasks' manifests; it appears whole, and with it all they list."""
        at, root = store(self.folder)
        body = json.dumps([{"path": m.path, "sha256": m.sha256, "files": m.files} for m in messages if m])
        with at.open_output_stream(f"{root}/{COMMITTED}.{self.run}") as f:
            f.write(body.encode())
        at.move(f"{root}/{COMMITTED}.{self.run}", f"{root}/{COMMITTED}")

    def abort(self, messages: list[Written | None]) -> None:
        at, root = store(self.folder)
        for m in messages:
            if m:
                at.delete_dir(f"{root}/{m.folder}")


class FileSink(DataSource):
    """Options: path. Rows: path, content."""

    @classmethod
    def name(cls) -> str:
        return "quill-files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if [f.name for f in schema] != ["path", "content"]:
            raise ValueError("files are rows of path and content")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    spark.dataSource.register(FileSink)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Files (path, content) into a folder as one commit; a path given twice is refused."""
    twice = files.groupBy("path").count().where("count > 1 or path is null").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['path']!r} is given more than once or empty")
    register(files.sparkSession)
    files.select("path", "content").write.format("quill-files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def read_pages(spark: SparkSession, folder: str, adapter: str, operation: str | None = None) -> DataFrame:
    adapter_for(adapter, operation)
    register(spark)
    source = spark.read.format("quill-pages").option("adapter", adapter)
    return (source.option("operation", operation) if operation else source).load(folder)
