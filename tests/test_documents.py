"""Archives, pictures, headings, callouts, tool output and the six renderings on small made-up inputs."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillstack.functions import geometry as geo
from quillstack.operators import headings, rendering
from quillstack.sources import archives, assets, images

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
BODY = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>1 Title</w:t></w:r></w:p>
<w:p><w:pPr><w:pBdr><w:left w:color="AA0000"/><w:top w:color="00BB00" w:sz="8"/></w:pBdr><w:ind w:left="120"/><w:numPr/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Tip</w:t></w:r><w:r><w:t> </w:t></w:r></w:p>
<w:p><m:oMath/><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>x</w:t></w:r></w:p>
<w:tbl><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tbl>
<w:p><w:r><w:pict><v:rect xmlns:v="v" xmlns:o="o" o:hr="t"/></w:pict></w:r></w:p>
</w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'
RELATIONS = '<R xmlns="r"><I Target="http://a" TargetMode="External"/><I Target="media/a.png"/></R>'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark):
    good = packed(**{"word/document.xml": BODY, "word/styles.xml": STYLES, "word/_rels/document.xml.rels": RELATIONS, "word/media/a.png": b"x"})
    typed = packed(**{"word/document.xml": "<!DOCTYPE a>" + BODY, "word/_rels/document.xml.rels": RELATIONS})
    files = spark.createDataFrame([("a", good), ("b", b"no archive"), ("c", None), ("d", typed), ("e", packed(x="y"))], "path string, content binary")
    rows = archives.paragraphs(files).orderBy("ord").collect()
    assert [(r.path, r.ord, r.text, r.style) for r in rows] == [("a", 0, "1 Title", "Heading 1"), ("a", 1, "Tip ", "Normal"), ("a", 2, "x", "Normal"), ("a", 3, "", "Normal")]
    assert (rows[1].left, rows[1].right, rows[1].top, rows[1].top_size, rows[1].indent_left, rows[1].numbered) == ("AA0000", "", "00BB00", "8", "120", True)
    assert [r.math for r in rows] == [False, False, True, False] and [r.ruled for r in rows] == [False, False, False, True]
    label = archives.paragraphs(files).select("ord", headings.bold_label(F.col("text"), F.col("runs")).alias("b")).orderBy("ord").collect()
    assert [r.b for r in label] == [False, True, False, False]
    assert {(r.path, r.kind, r.name) for r in archives.parts(files).collect()} == {("a", "link", "http://a"), ("a", "media", "word/media/a.png"), *((p, "unreadable", None) for p in "bcde")}
    assert archives.paragraphs(files.limit(0)).collect() == []


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, lines, lace=0, extra=b""):
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, lace)) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def filtered(kind, line, above, step):
    """The bytes of a line under a filter, by the definition of the format."""
    out = bytearray([kind])
    for i, v in enumerate(line):
        a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
        p = a + b - c
        nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
        out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import random

    random.seed(kind)
    lines = [bytes(random.choice((0, 100, 247, 248, 255)) for _ in range(7 * 3)) for _ in range(5)]
    above = [bytes(21), *lines]
    data = png(7, 5, 8, 2, [filtered(kind, line, above[k], 3) for k, line in enumerate(lines)])
    grey = [(line[i] * 19595 + line[i + 1] * 38470 + line[i + 2] * 7471 + 32768) >> 16 for line in lines for i in range(0, 21, 3)]
    assert images.facts(data, 1000) == (7, 5, sum(g < 248 for g in grey) / 35, None)


def test_png_kinds(spark):
    ink = {
        "bits": (png(10, 1, 1, 0, [b"\0\xf0\x00"]), 0.6),
        "palette": (png(4, 1, 2, 3, [b"\0\x1b"], extra=chunk(b"PLTE", bytes([255] * 6 + [0] * 6))), 0.5),
        "wide": (png(2, 1, 16, 0, [b"\0\xff\xff\x00\xff"]), 0.5),
        "alpha": (png(1, 1, 8, 6, [b"\0\xff\xff\xff\x00"]), 0.0),
        "laced": (png(2, 2, 8, 0, [b"\0\x00", b"\0\xff", b"\0\x00\xff"], lace=1), 0.5),
    }
    whole = ink["wide"][0]
    bad = {
        "empty": (b"", "signature"), "null": (None, "signature"), "cut": (whole[:-14], "cut short"), "flipped": (whole[:-20] + b"?" + whole[-19:], "checksum"),
        "lines": (png(2, 9, 16, 0, [b"\0\0\0\0\0"]), "cut short"), "index": (png(1, 1, 8, 3, [b"\0\x05"], extra=chunk(b"PLTE", b"abc")), "palette"), "depth": (png(1, 1, 4, 2, [b"\0\0\0"]), "head"),
        "large": (png(200_000, 200_000, 8, 0, [b""]), "too large"), "filter": (png(1, 1, 8, 0, [b"\x07\x00"]), "filter"),
    }
    files = spark.createDataFrame([(k, v[0]) for k, v in {**ink, **bad}.items()], "path string, content binary")
    found = {r.path: r for r in images.png_facts(files).collect()}
    assert {k: found[k].ink for k in ink} == {k: v for k, (_, v) in ink.items()}
    assert {r.path: r.error for r in images.invalid_pngs(files).collect()} == {k: v for k, (_, v) in bad.items()}


def test_paired_headings(spark):
    rows = [
        (1, "header", 2, "1.2 Name / 1.2 名称"), (2, "header", 2, "3 Other"), (3, "rule", None, None), (4, "header", 2, "3 其他"), (5, "header", 2, "4 Same"), (6, "header", 2, "4 Same"),
        (7, "header", 2, "5 别"), (8, "header", 2, "6 A"), (9, "text", None, "between"), (10, "header", 2, "6 甲"), (11, "header", 3, "7 B"), (12, "header", 2, "7 乙"), (13, "header", 2, None), (14, "header", 2, "a / b"),
    ]
    blocks = spark.createDataFrame([("d", *r) for r in rows], "doc string, ord int, kind string, level int, text string")
    out = [(r.ord, r.part, r.kind, r.text) for r in headings.paired_headings(blocks, "doc", "ord").orderBy("ord", "part").collect()]
    assert out == [
        (1, 0, "header", "1.2 Name"), (1, 1, "paragraph", "名称"), (2, 0, "header", "3 Other"), (3, 0, "rule", None), (4, 0, "paragraph", "其他"), (5, 0, "header", "4 Same"),
        (7, 0, "paragraph", "5 别"), (8, 0, "header", "6 A"), (9, 0, "text", "between"), (10, 0, "header", "6 甲"), (11, 0, "header", "7 B"), (12, 0, "header", "7 乙"), (13, 0, "header", None), (14, 0, "header", "a / b"),
    ]


def test_callouts_and_tools(spark):
    roles = [("tip", r"^tip\b", "提示"), ("note", r"^note\b", None), ("both", "提", None)]
    rows = spark.createDataFrame([(" TIP one",), ("note",), ("小提示",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(headings.callout_role(F.col("t"), roles)).collect()] == ["tip", "note", "both", None, None]
    assert [r[0] for r in rows.select(headings.callout_role(F.col("t"), roles[:2], with_target=False)).collect()] == ["tip", "note", None, None, None]
    logs = spark.createDataFrame([(1, "ok\nMissing character: x\nReference `a' on page 1 undefined\nOverfull \\hbox (1pt)\n x Overfull \\hbox"), (2, ""), (3, None)], "id int, log string")
    assert sorted((r.id, r.check, r.line_no) for r in headings.log_findings(logs, "id", "log").collect()) == [(1, "missing_character", 1), (1, "overfull_box", 3), (1, "undefined_reference", 2)]
    tool = spark.createDataFrame([("Title: a\nPages:   12\n", "name emb\n---- ---\nA  yes no \nB  yes yes \n"), ("none", "h\n-\nA  no no \n"), ("", "")], "info string, fonts string")
    assert [tuple(r) for r in tool.select(headings.reported_pages(F.col("info")), headings.all_embedded(F.col("fonts"))).collect()] == [(12, True), (None, False), (None, True)]


def test_six_renderings(spark):
    rows = [("a", "heading", "2.1 N_m"), ("b", "callout", "C"), ("c", "caption", "Fig"), ("d", "prose", "P"), ("e", "code", "x\n  y"), ("f", "list", "* one\n\n + two"), ("g", "list", "* one\ntwo"), ("h", "table", "<table><tr><td>1</td></tr></table>"), ("i", "table", "<table><script></table>")]
    blocks = spark.createDataFrame([(*r, "0" * 64, "T") for r in rows], "id string, kind string, source string, source_sha256 string, translation string")
    tail = lambda df, c: {r.id: r[c] and r[c].split("\n", 1)[1] for r in df.collect()}
    quoted = "\\begin{BilingualTranslation}\n%s\n\\end{BilingualTranslation}"
    tex = tail(rendering.bilingual_latex(blocks), "tex")
    assert tex["a"] == "\\subsection{2.1 N\\_m}\n" + quoted % "\\textbf{T}" and tex["d"] == "P\n\n" + quoted % "T"
    assert tex["b"] == "\\begin{BilingualCallout}\nC\n\\end{BilingualCallout}\n" + quoted % "\\textbf{T}"
    assert tex["c"] == "\\begin{center}\\small\\itshape\nFig\\par\n\\color{TranslationColor}T\n\\end{center}"
    only = rendering.translation_only(blocks)
    assert set(tail(only, "md").values()) == {"> T"} and set(tail(only, "tex").values()) == {quoted % "T"}
    md = tail(rendering.source_only_markdown(blocks), "md")
    assert (md["a"], md["c"], md["d"], md["e"]) == ("### 2.1 N\\_m", "*Fig*", "P", "```text\nx\n  y\n```")
    assert (md["f"], md["g"], md["i"]) == ("- one\n- two", "\\* one\ntwo".replace("\\*", "\\*"), None)
    assert md["h"] == "```{=html}\n<table><tr><td>1</td></tr></table>\n```"
    plain = tail(rendering.source_only_latex(blocks), "tex")
    assert plain["a"] == "\\subsection{2.1 N\\_m}" and plain["c"] == "\\begin{center}\\small\\itshape\nFig\n\\end{center}"
    assert plain["e"] == "\\begin{Verbatim}[fontsize=\\small,breaklines=true,breakanywhere=true]\nx\n  y\n\\end{Verbatim}"


def test_raster_coverage(spark):
    pages = spark.createDataFrame([(1, 100.0, 200.0, 0), (2, 200.0, 100.0, 90), (3, 100.0, 100.0, 0), (4, 0.0, 10.0, 0), (5, 100.0, 100.0, 180), (6, 100.0, 100.0, 0)], "page int, width double, height double, turn int")
    boxes = [(1, 0.0, 0.0, 50.0, 100.0), (1, 25.0, 50.0, 75.0, 100.0), (2, -50.0, 0.0, 50.0, 200.0), (3, 200.0, 0.0, 300.0, 50.0), (5, 90.0, 90.0, 150.0, 100.0), (6, float("nan"), 0.0, 1.0, 1.0), (6, 0.0, 0.0, 9.0, 9.0)]
    images_ = spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.page: r.ratio for r in geo.raster_coverage(pages, images_).collect()} == {1: 0.3125, 2: 0.5, 3: 0.0, 4: None, 5: 0.01, 6: None}


def test_assets(spark, tmp_path):
    dot = png(1, 1, 8, 0, [b"\0\0"])
    other = png(1, 1, 8, 0, [b"\0\xff"])
    files = spark.createDataFrame([("img/a.png", dot), ("img/A.png", other), ("b.png", dot), ("../c.png", dot), ("d.png", b"x"), ("e.png", None)], "path string, content binary")
    rows = {r.path: r for r in assets.asset_rows(files).collect()}
    digest = hashlib.sha256(dot).hexdigest()
    assert set(rows) == {"img/a.png", "img/A.png", "b.png", "../c.png"} and rows["b.png"].sha256 == digest and rows["b.png"].bytes == len(dot)
    assert rows["b.png"].id == "asset-" + hashlib.sha256(f"b.png\0{digest}".encode()).hexdigest()[:24]
    assert {(r.path, r.check) for r in assets.asset_faults(files).collect()} == {("img/a.png", "collision"), ("img/A.png", "collision"), ("../c.png", "unsafe"), ("d.png", "undecodable"), ("e.png", "undecodable")}
    assert assets.freeze(files, str(tmp_path / "frozen")).collect() == []
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        assets.freeze(files, str(tmp_path / "frozen"))
    copies = spark.read.parquet(str(tmp_path / "frozen"))
    visuals = spark.createDataFrame([("v1", "img/a.png"), ("v2", "b.png"), ("v3", "none.png"), ("v4", "x/b.png")], "id string, path string")
    found = assets.visual_paths(visuals, copies.unionByName(spark.createDataFrame([("x/b.png", other, "0" * 64)], copies.schema)))
    assert {(r.id, r.path, r.problem) for r in found.collect()} == {("v1", "assets/a.png", None), ("v2", "assets/b.png", "same_name"), ("v3", "assets/none.png", "missing"), ("v4", "assets/b.png", "same_name")}
