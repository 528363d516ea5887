"""Operators on small literal tables: goldens, and one mutation for each failure reason."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstack.functions import geometry as geo
from quillstack.functions import text as tx
from quillstack.operators import classify, evidence, gates, inventory, joins, protect, rendering, review, sequences
from quillstack.sources import content_list, sinks
from quillstack.sources import strict_json as sj
from quillstack.streaming import responses as stream

SHA = {"a": "1" * 64, "b": "2" * 64, "c": "3" * 64}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t="ﬁne  “q” — x ’s") == "fine \"q\" - x 's"
    assert one(spark, tx.ascii_tokens(F.col("t")), t="It's v1.2.3, naïve _x9") == ["it's", "v1", "2.3", "na", "ve", "_x9"]
    assert one(spark, tx.ngrams(F.split("t", " "), 3), t="a b") == []
    assert one(spark, tx.ngrams(F.split("t", " "), 3), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, tx.problem_ids(F.col("t")), t="PROBLEM (a_1) 问题（b2)") == ["a_1", "b2"]
    assert one(spark, tx.urls(F.col("t")), t="see https://b.c/d. and http://a.b;") == ["http://a.b", "https://b.c/d"]
    assert one(spark, tx.markdown_escape(F.col("t")), t="a*b\\c #") == "a\\*b\\\\c \\#"
    assert one(spark, tx.markdown_quote(F.col("t")), t="a\n\nb") == "> a\n>\n> b"
    assert one(spark, tx.occurrences(F.col("t"), F.lit("aa")), t="aaaa b aa") == 3
    assert one(spark, tx.contains_cjk(F.col("t")), t="x漢") and not one(spark, tx.contains_cjk(F.col("t")), t="é")
    assert one(spark, tx.latex_escape(F.col("t")), t="a\\b_{c} 5% ≤ \U0001d4a9︀") == "a\\textbackslash{}b\\_\\{c\\} 5\\% \\BilingualMath{\\leq} \\BilingualMath{\\mathcal{N}}"
    assert one(spark, tx.repair_linebreaks(F.col("t")), t="inter-\nnal soft­ly\nline\n\nnext https://x.y/\nz/ q") == "inter-nal softly line\n\nnext https://x.y/z/q"
    assert one(spark, tx.collision_key(F.col("t")), t="STRASSE/É") == tx.unicodedata.normalize("NFC", "STRASSE/É").casefold()
    assert one(spark, tx.table_html(F.col("t")), t="<html><body><table><tr><td colspan='2'>a&amp;b</td></tr></table></body></html>") == '<table><tr><td colspan="2">a&amp;b</td></tr></table>'
    for bad in ("<table><script>x</script></table>", "<table onclick='x'></table>", "<p>x</p>", "<table></table><table></table>", "<table><tr></table>"):
        assert one(spark, tx.table_html(F.col("t")), t=bad) is None


def test_strict_json(spark):
    good = one(spark, sj.strict_json(F.col("t")), t=b'{"b": 1, "a": [true, null]}')
    assert good.json == '{"a":[true,null],"b":1}' and good.error is None
    for bad, why in ((b'{"a":1,"a":2}', "repeated"), (b'{"a":NaN}', "finite"), (b"\xef\xbb\xbf{}", "mark"), (b"\xff", "decode"), (b"{", "Expecting"), (b"[" * 100_000, "deep")):
        assert why in one(spark, sj.strict_json(F.col("t")), t=bad).error


def test_pages_paths_boxes(spark):
    docs = spark.createDataFrame([(1, "a\fb\f  "), (2, "x")], "id int, t string")
    assert [tuple(r) for r in sj.pages_of(docs, "id", "t").orderBy("id", "page").collect()] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]
    for p, ok in (("a/b.png", True), ("/a", False), ("a/../b", False), ("a\\b", False), ("C:x", False), ("a//b", False)):
        assert one(spark, sj.safe_path(F.col("p")), p=p) is ok
    assert one(spark, sj.valid_content_box(F.col("b")), b=[0, 0, 10, 1000]) and not one(spark, sj.valid_content_box(F.col("b")), b=[0, 0, 10, 1001])
    assert one(spark, geo.scaled_box(F.col("b"), F.array(F.lit(200.0), F.lit(400.0))), b=[1.0, 2.0, 199.9, 400.0]) == [5, 5, 999, 1000]
    tree = json.dumps({"p/q": [{"type": "text", "bbox": [1, 2, 3, 4], "kids": [{"image_path": "i.png"}]}]})
    found = sj.walk_tree(spark, spark.createDataFrame([(1, tree)], "id int, t string"), "id", "t").collect()
    assert [(r.pointer, r.type, r.image_path) for r in found] == [("/p~1q/0", "text", None), ("/p~1q/0/kids/0", None, "i.png")]


ITEMS = [
    {"type": "header", "text": "H", "bbox": [0, 0, 10, 10], "page_idx": 0},
    {"type": "text", "text": "Title", "text_level": 1, "bbox": [0, 0, 10, 10], "page_idx": 0},
    {"type": "text", "text": "Body", "bbox": [0, 20, 10, 30], "page_idx": 0},
    {"type": "equation", "text": "x=1", "img_path": "e.png", "bbox": [0, 30, 10, 40], "page_idx": 0},
    {"type": "image", "img_path": "i.png", "image_caption": ["Fig 1", "more"], "image_footnote": ["n"], "bbox": [0, 40, 10, 50], "page_idx": 1},
    {"type": "table", "table_body": "<table></table>", "img_path": "t.png", "table_caption": ["T"], "table_footnote": [], "bbox": [0, 50, 10, 60], "page_idx": 1},
    {"type": "code", "sub_type": "algorithm", "code_body": "c", "code_caption": ["A"], "bbox": [0, 60, 10, 70], "page_idx": 1},
    {"type": "list", "sub_type": "ref_text", "list_items": ["r1", "r2"], "bbox": [0, 70, 10, 80], "page_idx": 1},
    {"type": "page_footnote", "text": "foot", "bbox": [0, 80, 10, 90], "page_idx": 1},
]


def test_content_list(spark):
    items = content_list.items_of(spark.createDataFrame([("d", json.dumps(ITEMS))], "document_id string, content string")).cache()
    rows = content_list.blocks_of(items).orderBy("ord").collect()
    assert [(r.kind, r.adapter_role, r.translatable) for r in rows] == [
        ("artifact", "header", False), ("heading", "title", True), ("prose", "paragraph", True), ("math", "equation_visual", False),
        ("image", "image", False), ("caption", "image_caption", True), ("caption", "image_caption", True), ("caption", "image_footnote", True),
        ("table", "table", False), ("image", "table_visual", False), ("caption", "table_caption", True),
        ("code", "algorithm", False), ("caption", "algorithm_caption", True), ("list", "reference", True), ("prose", "page_footnote", True),
    ]
    by = {r.adapter_role: r for r in rows}
    assert by["table_caption"].caption_parent == by["table"].id and by["reference"].source == "- r1\n- r2"
    assert sum(r.is_visual for r in rows) == 3 and len({r.id for r in rows}) == len(rows)
    assert content_list.item_faults(items).count() == 0
    for change, fault in (({"type": "video"}, "unsupported type"), ({"bbox": [0, 0, 0, 5]}, "bad box"), ({"text": " "}, "text missing"), ({"page_idx": -1}, "bad page"), ({"sub_type": "x"}, "unsupported subtype")):
        bad = [ITEMS[0], ITEMS[2] | change]
        found = content_list.item_faults(content_list.items_of(spark.createDataFrame([("d", json.dumps(bad))], "document_id string, content string"))).collect()
        assert fault in {r.fault for r in found}


def test_tree_match(spark):
    items = spark.createDataFrame([(0, 0, "text", [0, 0, 500, 500]), (1, 0, "table", [0, 0, 500, 500]), (2, 0, "image", [0, 0, 9, 9])], "item int, page int, type string, bbox array<int>")
    nodes = spark.createDataFrame([(0, "title", [0.0, 0.0, 50.0, 50.0], [100.0, 100.0], "/0"), (0, "image_body", [0.0, 0.0, 0.9, 0.9], [100.0, 100.0], "/1"), (0, "image", [0.0, 0.0, 0.9, 0.9], [100.0, 100.0], "/2")], "page int, type string, bbox array<double>, size array<double>, pointer string")
    assert sorted((r.item, r.status, r.pointer) for r in sj.match_tree(items, nodes).collect()) == [(0, "exact", "/0"), (1, "unmatched", None), (2, "ambiguous", None)]


def test_selectors(spark):
    roles = [{"role": "generic", "selectors": [{"node_types": ["prose"]}]}, {"role": "abstract", "selectors": [{"source_pattern": "^abstract"}]}, {"role": "note", "selectors": [{"adapter_role": "page_footnote"}, {"sub_types": ["x"]}]}]
    rows = [("paragraph", "prose", None, " ABSTRACT text"), ("page-footnote", "prose", None, "abstract"), ("heading", "other", "X", "abstract"), (None, "prose", None, "z"), (None, "q", None, "z")]
    blocks = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "i int, adapter_role string, node_type string, sub_type string, source string, text_level int")
    assert [r.role for r in classify.classify(blocks, roles).orderBy("i").collect()] == ["abstract", "note", "note", "generic", None]
    assert one(spark, classify.font_role(F.col("f")), f="CM MI-10") == "math" and one(spark, classify.font_role(F.col("f")), f="DejaVu Sans Mono") == "code"
    assert one(spark, classify.auxiliary_role(F.col("f")), f="Aside_Text") == "marginalia"


def test_selectors_of_ascii_words(spark):
    """An edge of ASCII words lies beside ü too; by default a letter is a letter."""
    roles = [{"role": "r", "selectors": [{"source_pattern": r"\bdie\b|\d"}]}]
    texts = ["Die Katze", "ü | Dieüauß", "Diesel", "a٣", "9", "die_", r"\bdie"]
    blocks = spark.createDataFrame(list(enumerate(texts)), "i int, source string").selectExpr("i", "source", *[f"cast(null as string) as {c}" for c in ("adapter_role", "node_type", "sub_type")], "cast(null as int) as text_level")
    hits = lambda **k: [r.i for r in classify.classify(blocks, roles, **k).orderBy("i").collect() if r.role]
    assert hits(ascii_only=True) == [0, 1, 4] and hits() == [0, 3, 4]


def test_selector_winner_as_its_sql(spark, tmp_path):
    import duckdb

    from quillstack.plans import oracles, queries

    rows = [(1, "und Dieüauß", "de", "src9"), (2, "die", "de", "src9"), (3, "Diesel", "de", "src9"), (4, "theé", "fr", "src2"), (5, "٣", "fr", "src9"), (6, "3", "fr", "src9"), (7, None, "de", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = f"with documents as (select * from '{tmp_path}/documents.parquet/*.parquet') select * from ({oracles.ORACLES['selector_winner']})"
    assert sorted(map(tuple, queries.selector_winner(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())


def test_protection(spark):
    text = "Mail a.b@c.org about v 1.2.3, Problem (x_1), see https://h.i/j/\nk [3, 4] and 5 GB at /usr/lib --flag foo.py float32."
    row = spark.createDataFrame([(text,)], "s string").select("s", protect.protect(F.col("s")).alias("p")).select("s", "p.*").cache()
    spans = row.first().spans
    assert [s["role"] for s in spans] == ["email", "version", "problem_id", "url", "citation", "number", "path", "cli_flag", "dotted_identifier", "dtype"]
    assert spans[3]["value"] == "https://h.i/j/k"
    assert row.select(protect.restore(F.col("protected"), F.col("spans"))).first()[0] == text.replace("j/\nk", "j/k")
    assert row.select(protect.placeholders_match(F.col("protected"), F.col("spans"))).first()[0]
    assert not row.select(protect.placeholders_match(F.concat("protected", F.lit("⟦K001⟧")), F.col("spans"))).first()[0]


def test_protection_of_many_and_of_markers(spark):
    """More than 999 spans, texts that hold markers, none at all, null, and letters outside the basic plane."""
    texts = ["x 1 " * 1200, "⟦K002⟧ and 5 ⟦K001⟧ 6", "", "no literals", None, "𝛼𝛽 7 é 8.1.2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", protect.protect(F.col("t")).alias("p")).select("i", "t", "p.*")
    out = rows.select("i", "t", "protected", "spans", protect.restore(F.col("protected"), F.col("spans")).alias("back"), protect.placeholders_match(F.col("protected"), F.col("spans")).alias("whole")).orderBy("i").collect()
    assert [r.back for r in out] == texts
    assert [len(r.spans) for r in out] == [1200, 4, 0, 0, 0, 2] and [r.whole for r in out if r.t is not None] == [True] * 5
    assert out[0].protected.endswith("x ⟦K1200⟧ ") and out[1].protected == "⟦K001⟧ and ⟦K002⟧ ⟦K003⟧ ⟦K004⟧"


def test_spans_are_brute_force(spark):
    """The bitmap against a comparison of every candidate with every span taken."""
    rng = random.Random(3)
    pool = ["a_b", "x.py", "1.2.3", "--f", "https://a.b/c", "[1, 2]", " ", "Problem (q)", "float32", "/u/v", "m@n.org", "12 GB", "\n", "word", "a.b.c"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        fonts = [(k, k + rng.randint(0, 6), "code") for k in range(0, len(text), 11)]
        found = [(rank, *m.span(re.compile(p).groups), role) for role, p, rank in [*protect.LITERALS, protect.OWN] for m in re.finditer(p, text)]
        found += [(100, a, b, f"font_{r}") for a, b, r in fonts if b <= len(text) and text[a:b].strip()]
        want: list = []
        for _, a, b, role in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])):
            if a < b and not any(a < e and s < b for s, e, _ in want):
                want.append((a, b, role))
        assert [x[:2] for x in protect.find_spans(text, fonts)] == [x[:2] for x in sorted(want)]


def test_span_faults(spark):
    rows = [(1, "abc def", [(0, 3, "code", "abc")]), (2, "abc", [(0, 9, "code", "abc")]), (3, "abc def", [(4, 7, "math", "def"), (0, 3, "code", "abc")]), (4, "abc", [(0, 2, "bold", "zz")]), (5, "abc", [])]
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int,role:string,text:string>>")
    assert sorted(map(tuple, protect.span_faults(df, "i", "t", "s").collect())) == [(2, "bounds"), (3, "order"), (4, "role"), (4, "text")]


def test_strict_json_limits():
    deep = lambda n: b"[" * n + b"]" * n
    assert sj.strict_load(deep(128)) and sj.strict_load(b"[1" + b",1" * 999_990 + b"]")
    for data in (deep(130), b"[1" + b",1" * 1_000_000 + b"]", b'{"a":1,"a":2}', b"NaN", b"\xef\xbb\xbf1"):
        with pytest.raises(ValueError):
            sj.strict_load(data)


def test_table_limits():
    cell = "<table><tr><td{}>x</td></tr></table>".format
    assert tx.canonical_table(cell(' colspan="2"')) and tx.canonical_table('<table><tr><th scope="row">x</th></tr></table>')
    for bad in (cell(' colspan="0"'), cell(' colspan="10001"'), cell(' colspan="٣"'), '<table><tr><th scope="zz">x</th></tr></table>', "<table></table>", "<table><tr></tr></table>", "<!-- c -->" + cell(""), cell("").replace("x", "<!-- c -->")):
        assert tx.canonical_table(bad) is None


def test_folds_leave_the_input_alone(spark):
    rows = spark.createDataFrame([(1, 0, 5)], "g int, o int, n int")
    sequences.greedy_chunks(rows, ["g"], "o", "n", 10)
    sequences.anchored_clusters(rows, ["g"], "o", "n", 1.0)
    assert rows.columns == ["g", "o", "n"]


def test_paragraphs_by_role_and_member_order(spark):
    rows = spark.createDataFrame([(1, 0, "and", "a", "b", [], []), (1, 1, "and", "a", "b", [], []), (1, 2, "and", "c", "b", [], []), (1, 3, "x", "c", "b", ["r"], []), (1, 4, "x", "c", "b", [], ["g"])], "g int, o int, t string, role string, output string, relations array<string>, groups array<string>")
    assert [r.island for r in sequences.paragraph_islands(rows, ["g"], "o", "t", roles=True).orderBy("o").collect()] == [1, 1, 2, 3, 4]
    members = spark.createDataFrame([(g, k, i) for g, run in enumerate([[3, 4, 5], [5, 3, 4], [4, 3, 5], [3, 3]]) for k, i in enumerate(run)], "g int, k int, i int")
    assert [r.order for r in sequences.member_order(members, "g", "k", "i").orderBy("g").collect()] == ["in_order", "rotated", "broken", "broken"]


def test_visuals_and_glossary(spark):
    row = spark.createDataFrame([("img/a_1.png", "A [new] *map*")], "path string, alt string")
    assert row.select(rendering.visual_markdown(F.col("path"), F.col("alt"))).first()[0] == "![A \\[new\\] \\*map\\*](img/a_1.png)"
    assert "{img/a\\_1.png}\n\\end{center}" in row.select(rendering.visual_latex(F.col("path"))).first()[0]
    blocks = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, source_sha256 string")
    made = [rendering.empty_glossary(df, "p", "zh").first() for df in (blocks, blocks.orderBy(F.desc("id")), blocks.where("id = 'a'"), blocks.limit(0))]
    assert made[0] == made[1] and made[0].source_digest != made[2].source_digest and made[0].terms == [] and made[3].source_blocks == 0


def test_no_hash_fails_closed(spark):
    """A missing hash proves nothing: the answer, pin, block or file counts as changed."""
    asked = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "id string, sha string")
    answers = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), ("d", "1")], "id string, sha string")
    assert {r.id: r.status for r in joins.responses(asked, answers, "id", "sha").collect()} == {"a": "stale", "b": "answered", "c": "stale", "d": "unknown"}
    lineage = spark.createDataFrame([(1, "x", None), (1, "y", "1"), (1, "z", "1")], "work int, artifact string, sha256 string")
    there = spark.createDataFrame([(1, "x", "1"), (1, "y", "1"), (1, "z", "2")], "work int, artifact string, sha256 string")
    assert {(r.artifact, r.problem) for r in review.stale(lineage, there).collect()} == {("x", "unpinned"), ("z", "changed")}
    blocks = spark.createDataFrame([("a", 1, "t", None, ["l"]), ("b", 1, None, SHA["a"], ["l"]), ("c", 1, "a", hashlib.sha256(b"a").hexdigest(), ["l"])], "id string, page int, source string, source_sha256 string, links array<string>")
    one_page = spark.createDataFrame([(1, 1, 1)], "page int, first_page int, last_page int")
    found = gates.source_gate(blocks, spark.createDataFrame([("l",)], "id string"), spark.createDataFrame([], "id string, anchor_id string"), one_page.select("page"), one_page.drop("page"))
    assert {(r.check, r.subject) for r in found.collect()} == {("block_hash", "a"), ("block_hash", "b")}
    frozen = spark.createDataFrame([(1, "p", None, None), (1, "q", 1, "s")], "document int, path string, size int, sha256 string")
    files = spark.createDataFrame([(1, "p", 1, "s"), (1, "q", 1, "s")], "document int, path string, size int, sha256 string")
    assert {(r.check, r.subject) for r in evidence.frozen_faults(frozen, files).collect()} == {("file_size", "p"), ("file_hash", "p")}


def test_substantive_text(spark):
    rows = [(1, 1, "a  b", "prose"), (1, 1, "skip", "artifact"), (1, 1, "skip", "image"), (1, 1, "<table><td>x &amp;lt; y&nbsp;</td></table>", "table"), (1, 1, "<b>", None)]
    blocks = spark.createDataFrame(rows, "document int, page int, t string, kind string")
    pages = spark.createDataFrame([(1, 1), (1, 2)], "document int, page int")
    assert sorted(map(tuple, evidence.text_lengths(blocks, pages, "t", "kind").collect())) == [(1, 1, len("a b x &lt; y <b>")), (1, 2, 0)]
    assert one(spark, tx.strip_markup(F.col("t")), t="<p>a&nbsp;&amp;&quot;b&#39; &amp;amp;</p>") == "a &\"b' &amp;"


@pytest.mark.parametrize(
    ("wrapped", "whole"),
    [
        ("see https://a.b/\nc/ d e", "see https://a.b/c/d e"),
        ("https://a.b/\n c-\nd_ \ne.\n\nNext", "https://a.b/c-d_e.\n\nNext"),
        ("https:// foo", "https:// foo"),
        ("https://a.b/ Upper", "https://a.b/ Upper"),
        ("two https://a.b/\nx and http://c.d/-\ny", "two https://a.b/x and http://c.d/-y"),
        ("well-\nknown A-\nB", "well-known A- B"),
        ("so\u00adft\n \n\n  \t\nend \n", "soft\n\nend"),
        ("a\n\n\x0b\n\nb", "a\n\nb"),
        ("", ""),
        (None, None),
    ],
)
def test_repaired_lines(spark, wrapped, whole):
    assert spark.createDataFrame([(wrapped,)], "t string").select(tx.repair_linebreaks(F.col("t")).alias("x")).first().x == whole


def test_uris_and_groups_on_pages(spark):
    text = spark.createDataFrame([(1, "see <https://a.b/c?x=1> and (https://d.e/f)."), (1, "https://x.org/a_(b) too"), (2, "https://g.h")], "document int, md string")
    uris = spark.createDataFrame([(1, u) for u in ("https://a.b/c", "https://a.b/c?x=1", "https://d.e/f", "https://g.h", "https://x.org/a_(b)")], "document int, uri string")
    # an address of another document doesn't count, one with brackets does
    assert [r.uri for r in gates.missing_uris(uris, text).collect()] == ["https://g.h"]
    pages = spark.createDataFrame([(1, 1, "A longer text on a page of its own", 0.5, 595.28, 841.89), (1, 2, "x", 0.0, 595.28, 800.0), (2, 1, "zz and text on no page", 0.1, None, None)], "document int, page int, text string, ink double, width double, height double")
    groups = spark.createDataFrame([(1, "a", "text on a page"), (1, "b", "x"), (1, "c", "text on no page"), (1, "d", "zz"), (1, "e", None)], "document int, group_id string, text string")
    found = {(r.document, r.check, r.subject) for r in gates.render_gate(pages, groups).collect()}
    assert found == {(1, "blank_page", "2"), (1, "page_size", "2"), (2, "page_size", "1"), *((1, "group_present", g) for g in "cde")}


def test_islands_and_folds(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 1, 30, 4, 4, 4])] + [(2, 0, 99)], "g int, o int, n int")
    assert [r.chunk for r in sequences.greedy_chunks(rows, ["g"], "o", "n", 10).orderBy("g", "o").collect()] == [1, 1, 2, 3, 4, 4, 5, 1]
    ys = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate([0, 10, 18, 19, 30, 40])], "g int, o int, y double")
    assert [r.cluster for r in sequences.anchored_clusters(ys, ["g"], "o", "y", 18.0).orderBy("o").collect()] == [1, 1, 1, 2, 2, 3]
    block = lambda o, t, y0, **k: (1, o, t, k.get("kind", "prose"), True, k.get("cap"), 0.0, y0, y0 + 10)
    blocks = spark.createDataFrame([block(0, "It ends.", 0.0), block(1, "it goes", 12.0), block(2, "on and", 24.0), block(3, "off", 60.0), block(4, "x", 72.0, kind="code"), block(5, "The cat of", 84.0, cap="p"), block(6, "y", 96.0)], "g int, o int, t string, kind string, translatable boolean, caption_parent string, x0 double, y0 double, y1 double")
    assert [r.island for r in sequences.paragraph_islands(blocks, ["g"], "o", "t", geometry=True).orderBy("o").collect()] == [1, 2, 2, 3, 4, 5, 6]


def test_joins(spark):
    boxes = "page int, {0}id int, {0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], boxes.format("a_"))
    b = spark.createDataFrame([(1, 1, 5.0, 5.0, 15.0, 15.0), (1, 2, 10.0, 0.0, 20.0, 10.0), (1, 3, 1.0, 1.0, 2.0, 2.0), (2, 4, 0.0, 0.0, 9.0, 9.0)], boxes.format("b_"))
    assert sorted(r.b_id for r in joins.overlapping(a, b, "page").collect()) == [1, 3]
    assert [r.b_id for r in joins.overlapping(a, b, "page", 0.65).collect()] == [3]
    rects = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 0.0, 0.0, 1.0, 1.0), (1, 5.0, 5.0, 5.0, 9.0), (2, 0.0, 0.0, 1.0, 4.0)], "g int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, geo.union_area(rects, "g").collect())) == [(1, 7.0), (2, 4.0)]
    texts = spark.createDataFrame([(1, "a Cell, b"), (2, "excels"), (3, "C++ code")], "id int, t string")
    terms = [{"source": "cell", "targets": ["z"], "enforce": True}, {"source": "C++", "targets": ["C"], "case_sensitive": True, "enforce": True}]
    hits = joins.glossary_hits(texts, terms, "id", "t")
    assert sorted((r.id, r.term) for r in hits.collect()) == [(1, "cell"), (3, "C++")]
    assert [r.id for r in joins.glossary_violations(hits, "t").collect()] == [1]


REQUESTS = [("r1", SHA["a"], "the quick brown fox jumps over a lazy dog again and on", [("⟦K001⟧", "v1")], [("fox", True, ["狐"])])]
REQUEST = "id string, source_sha256 string, source string, spans array<struct<placeholder:string,value:string>>, terms array<struct<term:string,enforce:boolean,targets:array<string>>>"


@pytest.mark.parametrize(
    ("answers", "checks"),
    [
        ([("r1", SHA["a"], "狐 ⟦K001⟧")], set()),
        ([], {"response"}),
        ([("r1", SHA["a"], "狐 ⟦K001⟧"), ("r1", SHA["a"], "狐 ⟦K001⟧")], {"response"}),
        ([("r1", SHA["b"], "狐 ⟦K001⟧")], {"response"}),
        ([("r1", SHA["a"], "狐 ⟦K001⟧"), ("r9", SHA["a"], "狐")], {"response"}),
        ([("r1", SHA["a"], "狐 ⟦K001⟧⟦K001⟧")], {"placeholders"}),
        ([("r1", SHA["a"], "猫 ⟦K001⟧")], {"glossary"}),
        ([("r1", SHA["a"], REQUESTS[0][2] + " ⟦K001⟧")], {"untranslated", "copied", "glossary"}),
    ],
)
def test_translation_gate(spark, answers, checks):
    found = gates.translation_gate(spark.createDataFrame(REQUESTS, REQUEST), spark.createDataFrame(answers, "id string, source_sha256 string, translation string"))
    assert {r.check for r in found.collect()} == checks


def test_output_and_render_gates(spark):
    blocks = spark.createDataFrame([(1, "b1", SHA["a"], "segment"), (1, "b2", SHA["b"], "segment")], "document int, id string, source_sha256 string, mode string")
    mark = lambda i, s: f"<!-- bilingual:segment id={i} source_sha256={s} -->"
    pins = spark.createDataFrame([("x", "1")], "artifact string, sha256 string")
    uris = spark.createDataFrame([(1, "http://u")], "document int, uri string")
    good = mark("b1", SHA["a"]) + mark("b2", SHA["b"]) + "http://u"
    for md, art, checks in ((good, "1", set()), (mark("b1", SHA["a"]) * 2 + "http://u", "1", {"markers", "marker_once"}), (mark("b1", SHA["c"]) + mark("b2", SHA["b"]) + "⟦K007⟧", "2", {"marker_content", "pins", "uris", "placeholder_left"})):
        found = gates.output_gate(blocks, spark.createDataFrame([(1, md)], "document int, md string"), spark.createDataFrame([("x", art)], "artifact string, sha256 string"), pins, uris)
        assert {r.check for r in found.collect()} == checks
    elsewhere = gates.output_gate(blocks, spark.createDataFrame([(1, mark("b1", SHA["a"])), (2, mark("b2", SHA["b"]) + "http://u")], "document int, md string"), spark.createDataFrame([("x", "1")], "artifact string, sha256 string"), pins, uris)
    assert {(r.document, r.check, r.subject) for r in elsewhere.collect()} == {(1, "markers", "b2"), (2, "markers", "b2"), (1, "uris", "http://u")}
    unhashed = blocks.withColumn("source_sha256", F.lit(None).cast("string"))
    assert gates.output_gate(unhashed, spark.createDataFrame([(1, good)], "document int, md string"), pins, pins, uris).where("check = 'marker_content'").count() == 2
    status = gates.document_status(elsewhere, spark.createDataFrame([(1,), (2,), (3,)], "document int"))
    assert {r.document: (r.failures, r.status) for r in status.collect()} == {1: (2, "failed"), 2: (1, "failed"), 3: (0, "passed")}
    pages = spark.createDataFrame([(1, 1, "full of text here", 0.1, 595.28, 841.89), (1, 2, "", 0.001, 595.0, 900.0)], "document int, page int, text string, ink double, width double, height double")
    groups = spark.createDataFrame([(1, "g1", "full of"), (1, "g2", "gone")], "document int, group_id string, text string")
    assert {(r.check, r.subject) for r in gates.render_gate(pages, groups).collect()} == {("blank_page", "2"), ("page_size", "2"), ("group_present", "g2")}
    assert {r.gate: r.status for r in gates.gate_status(gates.render_gate(pages, groups), ["render", "other"]).collect()} == {"render": "failed", "other": "passed"}


def test_problem_gate_spans_blocks(spark):
    blocks = spark.createDataFrame([("d", 1, "Problem"), ("d", 2, "(a1) text")], "doc string, ord int, source string")
    pages = spark.createDataFrame([("d", "Problem (a1) Problem (b2)")], "doc string, text string")
    assert [(r.check, r.subject) for r in gates.problem_gate(blocks, pages, "doc", "ord").collect()] == [("problem_missing", "b2")]


def test_rendering_and_medians(spark):
    rows = spark.createDataFrame([("b1", "heading", "2.1 Name", SHA["a"], "名"), ("b2", "caption", "Fig", SHA["b"], "图")], "id string, kind string, source string, source_sha256 string, translation string")
    md = {r.id: r.md for r in rendering.bilingual_markdown(rows).collect()}
    assert md["b1"].endswith("\n### 2.1 Name\n\n> **名**") and md["b2"].endswith("\n*Fig*\n\n> *图*")
    assert {r.id: r.tex for r in rendering.bilingual_latex(rows).collect()}["b1"].startswith("\\SegmentAnchor{b1}\n\\subsection{2.1 Name}")
    values = spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)] + [(2, 7)], "g int, v int")
    assert {r.g: r.median for r in inventory.ranked_median(values, "g", "v").collect()} == {1: 3, 2: 7}
    assert {r.g: r.m for r in values.groupBy("g").agg(inventory.upper_median("v").alias("m")).collect()} == {1: 3, 2: 7}


def test_sinks(spark, tmp_path):
    rows = spark.range(20).withColumn("chunk", (F.col("id") / 8).cast("int") + 1)
    sinks.write_records(rows, str(tmp_path / "r"), "id")
    with pytest.raises(Exception, match="exist"):
        sinks.write_records(rows, str(tmp_path / "r"), "id")
    sinks.write_batches(rows, str(tmp_path / "b"), "chunk", "id")
    assert sorted(p.name for p in (tmp_path / "b").glob("part=*")) == ["part=part-0001", "part=part-0002", "part=part-0003"]
    assert sj.read_records(spark, str(tmp_path / "r"), rows.schema).count() == 20


def test_response_stream(spark, tmp_path):
    """Restarts, repeats, late requests and answers without a hash; a batch changes only the ids it holds."""
    asked, inbox = tmp_path / "asked", tmp_path / "in"
    asked.mkdir()
    inbox.mkdir()
    put = lambda folder, name, *rows: (folder / name).write_text("".join(json.dumps(dict(zip(("id", "source_sha256", "translation"), r, strict=False))) + "\n" for r in rows))
    report, checkpoint = str(tmp_path / "rep"), str(tmp_path / "cp")

    def again():
        stream.audit_stream(stream.requests_from(spark, str(asked)), stream.answers_from(spark, str(inbox)), report, checkpoint).awaitTermination()
        rows = spark.read.parquet(report)
        return {r.id: r.status for r in stream.statuses(rows).collect()}, rows.count()

    put(asked, "1.json", ("r1", "h1"), ("r2", "h2"), ("r3", "h3"), ("r4", None))
    put(inbox, "1.json", ("r1", "h1", "x"), ("r2", "old", "y"), ("r4", None, "z"), (None, "h", "?"))
    first, n = again()
    assert first == {"r1": "answered", "r2": "stale", "r3": "pending", "r4": "stale"} and n == 4
    assert again() == (first, n)
    put(inbox, "2.json", ("r1", "h1", "again"), ("zz", "h9", "early"))
    second, n = again()
    assert second == first | {"r1": "repeated", "zz": "early"} and n == 6
    put(asked, "2.json", ("zz", "h9"))
    put(inbox, "3.json", ("r3", "h3", "late"))
    third, n = again()
    assert third == second | {"zz": "answered", "r3": "answered"} and n == 8
