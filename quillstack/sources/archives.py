"""Word-processor archives as rows: paragraphs, outside links and media of binary files (path, content).

Files are read by Spark's binaryFile source; one file is parsed at a time in a Python worker and its rows
leave in batches, so a task holds one archive. Markup with a document type is refused, so entities can't grow.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: The namespaces of the markup.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
SIDES = ("left", "right", "top", "bottom")

PARAGRAPHS = (
    "path string, ord int, text string, style string, left string, right string, top string, top_size string, bottom string, "
    "indent_left string, indent_right string, numbered boolean, math boolean, ruled boolean, runs array<struct<text:string,bold:boolean>>"
)
PARTS = "path string, kind string, name string, error string"
BATCH = 4096


def parsed(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data:
        raise ValueError("document type")
    return ElementTree.fromstring(data)


def _value(node: ElementTree.Element | None, name: str = "val") -> str:
    return "" if node is None else node.get(WORD + name, "")


def _shown(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(WORD + "t"))


def _bold(run: ElementTree.Element) -> bool:
    mark = run.find(f"{WORD}rPr/{WORD}b")
    return mark is not None and _value(mark) not in ("0", "false", "off")


def styles_of(archive: zipfile.ZipFile) -> dict[str, str]:
    """Style names by id; headings are capitalised as programs show them."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    names = {s.get(WORD + "styleId", ""): _value(s.find(WORD + "name")) for s in parsed(archive.read("word/styles.xml")).iter(WORD + "style")}
    return {k: "H" + v[1:] if v.startswith("heading ") else v for k, v in names.items()}


def paragraph(node: ElementTree.Element, styles: dict[str, str]) -> tuple:
    """One paragraph of the body as the columns from text to runs."""
    at = lambda path: node.find(f"{WORD}pPr/" + "/".join(WORD + p for p in path.split("/")))
    border = {side: at(f"pBdr/{side}") for side in SIDES}
    style = _value(at("pStyle"))
    runs = [{"text": _shown(r), "bold": _bold(r)} for r in node.findall(WORD + "r")]
    math = any(True for kind in ("oMath", "oMathPara") for _ in node.iter(MATH + kind))
    ruled = any(e.tag.rpartition("}")[2] == "rect" and any(k.rpartition("}")[2] == "hr" and v == "t" for k, v in e.attrib.items()) for e in node.iter())
    colours = {side: _value(border[side], "color") for side in SIDES}
    return (
        _shown(node), styles.get(style, style or "Normal"), colours["left"], colours["right"], colours["top"], _value(border["top"], "sz"), colours["bottom"],
        _value(at("ind"), "left"), _value(at("ind"), "right"), at("numPr") is not None, math, ruled, runs,
    )


def paragraphs(files: DataFrame) -> DataFrame:
    """path, ord and what each paragraph of the body shows; files that are no such archive give no row (see parts)."""
    names = [c.split()[0] for c in PARAGRAPHS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        body = parsed(archive.read("word/document.xml")).find(WORD + "body")
                        styles = styles_of(archive)
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError):
                    continue
                found = [] if body is None else body.findall(WORD + "p")
                for start in range(0, len(found), BATCH):
                    rows = [(path, start + k, *paragraph(p, styles)) for k, p in enumerate(found[start : start + BATCH])]
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, PARAGRAPHS)


def parts(files: DataFrame) -> DataFrame:
    """path, kind (link, media or unreadable), name, error: targets outside the archive, media in it, and files that can't be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        parsed(archive.read("word/document.xml"))
                        relations = parsed(archive.read("word/_rels/document.xml.rels"))
                        media = [n for n in archive.namelist() if n.startswith("word/media/") and not n.endswith("/")]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((path, "unreadable", None, type(e).__name__))
                    continue
                rows += [(path, "link", r.get("Target"), None) for r in relations if r.get("TargetMode") == "External"]
                rows += [(path, "media", n, None) for n in media]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "error"])

    return files.select("path", "content").mapInPandas(read, PARTS)
