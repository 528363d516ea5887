"""Inline runs and tree rewriting: goldens, nothing lost or doubled, and one mutation for each fault of a group."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from quillstack.functions import runs as rn
from quillstack.operators import syntax_tree as tree

BLOCKS = f"document int, path array<int>, kind string, level int, runs {rn.RUNS}"


def inline(text, marks=()):
    """Runs of a text; | is a soft break."""
    out = []
    for k, word in enumerate(text.split()):
        if k:
            out.append(("Space", None, list(marks)))
        out.append(("SoftBreak", None, list(marks)) if word == "|" else ("Str", word, list(marks)))
    return out


def texts_of(spark, column, runs):
    held = spark.createDataFrame([(runs,)], f"r {rn.RUNS}")
    return held.select(F.transform(column(F.col("r")), rn.shown).alias("x")).first().x


@pytest.mark.parametrize(
    ("runs", "parts"),
    [
        (inline("one two"), ["one two"]),
        (inline("one | two"), ["one ", " two"]),
        (inline("| | a"), [" ", " a"]),
        (inline("left / 右 half"), ["left", "右 half"]),
        (inline("左 / right"), ["左 / right"]),
        (inline("left / 右 / 二"), ["left", "右 / 二"]),
        (inline("a / b / 右"), ["a", "b / 右"]),
        (inline("/ 右"), ["/ 右"]),
        (inline("no slash 右"), ["no slash 右"]),
        (inline("see ") + inline("en / 中", [("Strong", 1)]) + inline("after"), ["en", "中"]),
        (inline("en / 中", [("Span", 1)]), ["en / 中"]),
        (inline("中 / x", [("Emph", 1)]) + inline("/ y"), ["中 / x/ y"]),
        (inline("a ", [("Emph", 1)]) + inline("b / c", [("Emph", 2)]) + inline("x / 中", [("Emph", 3)]), ["x", "中"]),
        ([], []),
    ],
)
def test_pieces(spark, runs, parts):
    assert texts_of(spark, rn.pieces, runs) == parts


def test_stars(spark):
    runs = [("Str", "**bold**", []), ("Str", "x**y", []), ("Code", "2**3", []), ("Str", "**in**", [("Underline", 1)]), ("Math", "a**b", [])]
    made = spark.createDataFrame([(runs,)], f"r {rn.RUNS}").select(rn.without_stars(F.col("r")).alias("x")).first().x
    assert [(r.kind, r.text, [m.kind for m in r.marks]) for r in made] == [("Str", "bold", ["Strong"]), ("Str", "xy", []), ("Code", "2**3", []), ("Str", "**in**", ["Underline"]), ("Math", "a**b", [])]


def test_words(spark):
    held = spark.createDataFrame([(" a  b\n", ), ("",)], "t string").select(rn.words(F.col("t")).alias("r"), rn.shown(rn.words(F.col("t"))).alias("s")).collect()
    assert [r.s for r in held] == ["a b", ""] and [x.kind for x in held[0].r] == ["Str", "Space", "Str"] and held[1].r == []


def shown(rows):
    """kind and text of every block below its parent, in order."""
    return [(".".join(map(str, r.parent)), r.kind, r.t) for r in rows.withColumn("t", rn.shown(F.col("runs"))).orderBy("document", "place").collect()]


PROBLEM = [
    (1, [0], "Header", 1, inline("1 Title / 1 题目")),
    (1, [1], "BlockQuote", None, None),
    (1, [1, 0], "Para", None, inline("Problem one | 问题 一")),
    (1, [1, 1], "OrderedList", None, None),
    (1, [1, 1, 0], "Item", None, None),
    (1, [1, 1, 0, 0], "Plain", None, inline("first / 第一")),
    (1, [1, 1, 0, 1], "BlockQuote", None, None),
    (1, [1, 1, 0, 1, 0], "Para", None, inline("深 | deep")),
    (1, [1, 1, 1], "Item", None, None),
    (1, [1, 1, 1, 0], "Plain", None, inline("second")),
    (1, [1, 2], "CodeBlock", None, inline("code / 漢")),
    (1, [2], "BlockQuote", None, None),
    (1, [2, 0], "Para", None, inline("Problem two | more")),
    (1, [3], "Table", None, None),
    (1, [3, 0], "Para", None, inline("cell | 格")),
    (1, [4], "Div", None, None),
    (1, [4, 0], "Para", None, inline("a | b")),
]


def test_problems(spark):
    blocks = spark.createDataFrame(PROBLEM, BLOCKS)
    rows, counts = tree.with_problems(blocks, lambda t: t.contains("Problem"))
    assert shown(rows) == [
        ("", "Header", "1 Title"), ("", "Para", "题目"),
        ("", "BlockQuote", None),
        ("1", "Para", tree.PROBLEM_BEGIN), ("1", "Para", "Problem one "), ("1", "OrderedList", None),
        ("1.1.1", "Item", None), ("1.1.1.0", "Plain", "first"), ("1.1.1", "Item", None), ("1.1.1.1", "Plain", "second"),
        ("1", "HorizontalRule", None), ("1", "Para", " 问题 一"), ("1", "OrderedList", None),
        ("1.3.1", "Item", None), ("1.3.1.0", "Plain", "第一"), ("1.3.1.0", "BlockQuote", None), ("1.3.1.0.1.0", "Para", "深   deep"),
        ("1", "CodeBlock", "code / 漢"), ("1", "Para", tree.PROBLEM_END),
        ("", "BlockQuote", None), ("2", "Para", "Problem two   more"),
        ("", "Table", None), ("3", "Para", "cell   格"),
        ("", "Div", None), ("4", "Para", "a "), ("4", "Para", " b"),
    ]
    assert [tuple(r) for r in counts.collect()] == [(1, 2)]
    # every parent is there, once, and no word is lost or doubled
    found = rows.withColumn("t", rn.shown(F.col("runs"))).collect()
    places = collections.Counter(tuple(r.place) for r in found)
    assert max(places.values()) == 1 and all(tuple(r.parent) in places for r in found if r.parent)
    words = lambda texts: collections.Counter(w for t in texts if t for w in t.split())
    before = words(" ".join(t or "" for _, t, _ in b[4]) for b in PROBLEM if b[4])
    after = words(r.t for r in found if r.t not in (tree.PROBLEM_BEGIN, tree.PROBLEM_END))
    # a slash between halves goes, and the number that the translated heading repeats
    assert before - after == collections.Counter({"/": 2, "1": 1}) and not after - before


def test_empty_tree(spark):
    rows, counts = tree.with_problems(spark.createDataFrame([], BLOCKS), lambda t: F.lit(True))
    assert rows.collect() == [] and counts.collect() == []


def segment(doc, n, node, source=True, target=1):
    rows = [(doc, [n * 10], "RawBlock", None, [("Str", f"<!-- bilingual:segment id={node} x -->", [])])]
    if source:
        rows.append((doc, [n * 10 + 1], "Para", None, inline(f"source {node}")))
    for k in range(target):
        rows += [(doc, [n * 10 + 2 + k], "BlockQuote", None, None), (doc, [n * 10 + 2 + k, 0], "Para", None, inline(f"译 {node}"))]
    return rows


GROUPS = "document int, group_id string, role string, style string, membership string, anchor string, members array<string>"
GROUP = (1, "g", "remark", "quote", "complete", "a", ["a", "b"])


FAULTS = [
    ([("a",), ("b",), ("c",)], [GROUP], set()),
    ([("a",), ("b", False, 0)], [GROUP], set()),
    ([("a", False, 0), ("b",)], [(*GROUP[:6], ["b", "a"])], set()),
    ([("a",), ("b",)], [(*GROUP[:6], ["b", "a"])], {"member_order"}),
    ([("a",), ("x",), ("b",)], [GROUP], {"members_not_contiguous"}),
    ([("a",)], [GROUP], {"member_absent"}),
    ([("a",), ("b",), ("a",)], [GROUP], {"marker_repeated", "member_order"}),
    ([("a",), ("b",)], [GROUP, (*GROUP[:1], "h", *GROUP[2:6], ["b"])], {"node_shared"}),
    ([("a", True, 0), ("b", True, 0)], [GROUP], {"not_bilingual"}),
    ([("a", False, 1), ("b",)], [GROUP], {"member_content"}),
    ([("a", True, 2), ("b",)], [GROUP], {"member_content"}),
    ([("a",), ("b",)], [(*GROUP[:4], "anchor-only", "a", ["a", "b"])], {"anchor_only_members", "anchor_only_target"}),
    ([("a",), ("b",)], [(*GROUP[:4], "anchor-only", "a", ["a"])], set()),
    ([("a", True, 0), ("b",)], [(*GROUP[:4], "anchor-only", "a", ["a"])], {"anchor_only_target", "not_bilingual"}),
    ([("a",)], [(*GROUP[:6], [])], {"group_invalid"}),
]


def test_group_faults(spark):
    """One document for each case."""
    rows = [r for d, (segments, _, _) in enumerate(FAULTS) for n, s in enumerate(segments) for r in segment(d, n, *s)]
    groups = [(d, *g[1:]) for d, (_, listed, _) in enumerate(FAULTS) for g in listed]
    found = tree.segment_faults(tree.segments(spark.createDataFrame(rows, BLOCKS)), spark.createDataFrame(groups, GROUPS)).collect()
    for d, (_, _, checks) in enumerate(FAULTS):
        assert {r.check for r in found if r.document == d} == checks, d


def test_groups(spark):
    rows = [(1, [0], "Para", None, inline("before | all"))] + [r for n, s in enumerate([("a",), ("b",), ("c",)], 1) for r in segment(1, n, *s)] + segment(2, 0, "a")
    made, faults = tree.with_groups(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([GROUP, (2, "g2", *GROUP[2:])], GROUPS))
    assert [(r.document, r.check) for r in faults.collect()] == [(2, "member_absent")]
    name = "|remark|quote|complete|g"
    assert shown(made) == [
        ("", "Para", "before "), ("", "Para", " all"), ("", "BlockQuote", None),
        ("10", "Para", tree.CALLOUT_BEGIN + name), ("10", "Para", "source a"), ("10", "Para", "source b"), ("10", "HorizontalRule", None),
        ("10", "Para", "译 a"), ("10", "Para", "译 b"), ("10", "Para", tree.CALLOUT_END + name),
        ("", "RawBlock", "<!-- bilingual:segment id=c x -->"), ("", "Para", "source c"), ("", "BlockQuote", None), ("32", "Para", "译 c"),
    ]
    counts = tree.group_counts(spark.createDataFrame([GROUP, (1, "h", "remark", "quote", "anchor-only", "c", ["c"])], GROUPS), spark.createDataFrame([("remark",), ("proof",)], "role string"))
    assert sorted(map(tuple, counts.collect())) == [(1, "proof", 0, 0, 0), (1, "remark", 2, 1, 1)]
