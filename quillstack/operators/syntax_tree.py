"""Document syntax trees as an ordered relation, and the two rewritings before a tree is rendered.

A block is a row (document, path, kind, level, runs): path is its place among the blocks of its
document, child by child, so that a prefix names an ancestor and comparing paths gives document order;
runs is its inline content (functions.runs) or null. List items are blocks of kind Item. Rewriting
gives rows (document, place, parent, kind, level, runs): `place` orders all blocks of the result,
`parent` is the place of the block around them and empty at the top. Cutting a paragraph appends its
part to the path, so nothing has to be numbered again. Every step is a projection, an aggregate by
block or an equi-join by place; the only windows are those by document of headings and segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs as rn
from ..functions.text import contains_cjk
from ..sources.scratch import written
from .headings import paired_headings

PLACE = "array<int>"
#: Paragraphs, lists, and the blocks whose children are rewritten; all others are left as they are.
PARAGRAPHS = ("Para", "Plain")
LISTS = ("BulletList", "OrderedList")
OPENED = ("BlockQuote", "BulletList", "OrderedList", "Div", "Item")
#: The texts that open and close a regrouped problem, and those of a grouped role.
PROBLEM_BEGIN, PROBLEM_END = "V2-PROBLEM-CALLOUT-BEGIN", "V2-PROBLEM-CALLOUT-END"
CALLOUT_BEGIN, CALLOUT_END = "V23-CALLOUT-BEGIN", "V23-CALLOUT-END"
#: Fixed value: the marker of a segment in a raw block.
SEGMENT = r"<!--\s*bilingual:\S+\s+id=(\S+)\s+"
#: Where the two languages of a regrouped quote go: the markers and the rule between have the even places.
SOURCE, TARGET = 1, 3

RESULT = ["document", "place", "parent", "kind", "level", "runs"]


def place(*parts: Column | int) -> Column:
    return F.concat(*[F.array(F.lit(p).cast("int")) if isinstance(p, int) else p for p in parts])


def upto(path: Column, n: int | Column) -> Column:
    return F.slice(path, 1, n)


def prefixes(path: Column, least: int = 1) -> Column:
    """The path and all its prefixes of at least `least` steps."""
    return F.when(F.size(path) >= least, F.transform(F.sequence(F.lit(least), F.size(path)), lambda n: F.slice(path, F.lit(1), n))).otherwise(F.array().cast(f"array<{PLACE}>"))


def side_of(text: Column) -> Column:
    return F.when(contains_cjk(text), TARGET).otherwise(SOURCE)


def subtree_texts(blocks: DataFrame) -> DataFrame:
    """document, path, text: what a block shows with all that lies in it, in order."""
    leaves = blocks.select("document", F.col("path").alias("_p"), rn.shown(F.col("runs")).alias("_t")).where("_t is not null")
    around = leaves.select("document", F.explode(prefixes(F.col("_p"))).alias("path"), "_p", "_t")
    return around.groupBy("document", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda s: s["_t"]), "").alias("text"))


def rewritable(blocks: DataFrame) -> DataFrame:
    """The blocks, with `open`: whether all blocks around them are among those that are rewritten."""
    shut = blocks.where(~F.col("kind").isin(*OPENED, *PARAGRAPHS)).select("document", F.col("path").alias("_around"), F.lit(True).alias("_shut"))
    inside = blocks.where(F.size("path") > 1).select("document", "path", F.explode(prefixes(F.slice("path", 1, F.size("path") - 1))).alias("_around"))
    closed = inside.join(shut, ["document", "_around"], "left_semi").select("document", "path").distinct().withColumn("_closed", F.lit(True))
    return blocks.join(closed, ["document", "path"], "left").withColumn("open", F.col("_closed").isNull()).drop("_closed")


def cut_paragraphs(blocks: DataFrame) -> DataFrame:
    """document, path, part, kind, level, runs: every paragraph in the pieces of functions.runs; other blocks as one part."""
    rows = rewritable(blocks)
    cut = F.col("kind").isin(*PARAGRAPHS) & F.col("open")
    parts = F.when(cut, rn.pieces(F.coalesce("runs", rn.no_runs()))).otherwise(F.array("runs"))
    return rows.select("document", "path", F.posexplode(parts).alias("part", "runs"), "kind", "level")


def normalized(blocks: DataFrame) -> DataFrame:
    """RESULT: the blocks with their paragraphs cut."""
    parent = F.slice("path", 1, F.size("path") - 1)
    return cut_paragraphs(blocks).select("document", F.when(F.col("kind").isin(*PARAGRAPHS), F.concat("path", F.array("part"))).otherwise(F.col("path")).alias("place"), parent.alias("parent"), "kind", "level", "runs")


def untouched(blocks: DataFrame) -> DataFrame:
    return blocks.select("document", F.col("path").alias("place"), F.slice("path", 1, F.size("path") - 1).alias("parent"), "kind", "level", "runs")


def regrouped(blocks: DataFrame) -> DataFrame:
    """RESULT for top-level quotes (all blocks of each): the source language first, then a rule and the target language.

    A paragraph goes by pieces, another block whole, each to the language of its text; a list is split
    into one list for each language, item by item. A quote without both languages stays as it was.
    """
    depth = F.size("path")
    top = upto(F.col("path"), 1)
    lists = blocks.where((depth == 2) & F.col("kind").isin(*LISTS)).select("document", F.col("path").alias("_list"), F.col("kind").alias("_list_kind"))
    rows = blocks.where(depth > 1).withColumn("_second", upto(F.col("path"), 2))
    listed = lists.select("document", F.col("_list").alias("_second"), "_list")
    rows = rows.join(listed, ["document", "_second"], "left")
    # what is sorted as one: a child of the quote, or a child of an item of a list
    unit = F.when(F.col("_list").isNull(), F.col("_second")).otherwise(upto(F.col("path"), 4))
    rows = rows.withColumn("_unit", unit).where("_list is null or size(path) >= 4")
    own = F.col("path") == F.col("_unit")
    paragraph = own & F.col("kind").isin(*PARAGRAPHS)

    cut = rows.where(paragraph).select("document", "_unit", "_list", F.posexplode(rn.pieces(F.coalesce("runs", rn.no_runs()))).alias("_part", "runs"), "kind", "level")
    cut = cut.withColumn("_side", side_of(rn.shown(F.col("runs")))).withColumn("path", F.col("_unit"))
    whole = rows.where(~paragraph)
    texts = subtree_texts(whole).join(whole.where(own).select("document", F.col("path")), ["document", "path"]).select("document", F.col("path").alias("_unit"), side_of(F.col("text")).alias("_side"))
    sides = whole.select("document", "_unit").distinct().join(texts, ["document", "_unit"], "left").na.fill(SOURCE, ["_side"])
    whole = whole.join(sides, ["document", "_unit"]).withColumn("_part", F.lit(0))
    columns = ["document", "path", "_unit", "_list", "_part", "_side", "kind", "level", "runs"]
    sorted_ = written(cut.select(columns).unionByName(whole.select(columns)), "sides")

    slot = F.array(F.col("_side").cast("int"))
    moved = lambda p: F.concat(upto(F.col("path"), 1), slot, p)
    size = F.size("_unit")
    below = F.slice("path", size + 1, F.size("path"))
    unit_place = F.concat(upto(F.col("_unit"), 1), slot, F.slice("_unit", 2, size), F.array("_part"))
    above = F.when(F.col("_list").isNull(), upto(F.col("_unit"), 1)).otherwise(moved(F.slice("_unit", 2, 2)))
    inner = F.when(F.size(below) == 1, unit_place).otherwise(F.concat(unit_place, F.slice(below, 1, F.size(below) - 1)))
    content = sorted_.select("document", F.concat(unit_place, below).alias("place"), F.when(F.size(below) == 0, above).otherwise(inner).alias("parent"), "kind", "level", "runs", top.alias("quote"), "_side")

    in_lists = sorted_.where("_list is not null").join(lists, ["document", "_list"])
    none = F.lit(None).cast(rn.RUNS)
    item = in_lists.select("document", moved(F.slice("_unit", 2, 2)).alias("place"), moved(F.slice("_unit", 2, 1)).alias("parent"), F.lit("Item").alias("kind"), F.lit(None).cast("int").alias("level"), "_side", top.alias("quote")).distinct()
    holder = in_lists.select("document", moved(F.slice("_unit", 2, 1)).alias("place"), top.alias("parent"), F.col("_list_kind").alias("kind"), F.lit(None).cast("int").alias("level"), "_side", top.alias("quote")).distinct()
    made = content.unionByName(item.withColumn("runs", none)).unionByName(holder.withColumn("runs", none))

    both = sorted_.groupBy("document", top.alias("quote")).agg(F.count_distinct("_side").alias("n")).where("n = 2").drop("n")
    quotes = blocks.where(depth == 1).withColumn("quote", F.col("path"))
    two = quotes.join(both, ["document", "quote"])
    mark = lambda n, kind, text: two.select("document", place(F.col("path"), n).alias("place"), F.col("path").alias("parent"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), (rn.words(F.lit(text)) if text else none).alias("runs"))
    out = [made.join(both, ["document", "quote"], "left_semi").select(RESULT), untouched(two.drop("quote")), mark(0, "Para", PROBLEM_BEGIN), mark(2, "HorizontalRule", ""), mark(4, "Para", PROBLEM_END)]
    plain = blocks.withColumn("quote", top).join(both, ["document", "quote"], "left_anti").drop("quote")
    return reduce(DataFrame.unionByName, [*out, untouched(plain)])


def with_headings(rows: DataFrame) -> DataFrame:
    """RESULT with the headings at the top paired by language (operators.headings)."""
    top = F.size("parent") == 0
    kind = F.when(F.col("kind") == "Header", "header").when(F.col("kind") == "HorizontalRule", "rule").otherwise("other")
    heads = rows.where(top).select("document", F.col("place").alias("ord"), kind.alias("kind"), "level", F.coalesce(rn.shown(F.col("runs")), F.lit("")).alias("text"))
    after = paired_headings(heads, "document", "ord").select("document", F.col("ord").alias("place"), "part", F.col("kind").alias("_kind"), F.col("level").alias("_level"), "text")
    both = rows.where(top).join(after, ["document", "place"])
    paired = F.col("_kind").isin("header", "paragraph")
    same = (F.col("_kind") == "header") & (rn.shown(F.col("runs")) == F.col("text"))
    both = both.select(
        "document",
        F.when(F.col("part") > 0, F.concat("place", F.array("part"))).otherwise(F.col("place")).alias("place"),
        "parent",
        F.when(F.col("_kind") == "paragraph", "Para").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("_kind") == "paragraph", F.lit(None)).otherwise(F.col("level")).alias("level"),
        F.when(paired & ~same, rn.words(F.col("text"))).otherwise(F.col("runs")).alias("runs"),
    )
    return both.unionByName(rows.where(~top).select(RESULT))


def problem_quotes(blocks: DataFrame, is_problem) -> DataFrame:
    """document, path: the quotes at the top whose text a rule (a Column of the text) calls a problem."""
    quotes = blocks.where((F.size("path") == 1) & (F.col("kind") == "BlockQuote")).select("document", "path")
    texts = subtree_texts(blocks).where(F.size("path") == 1)
    return quotes.join(texts, ["document", "path"]).where(is_problem(F.col("text"))).select("document", "path")


def with_problems(blocks: DataFrame, is_problem) -> tuple[DataFrame, DataFrame]:
    """The tree with its problems regrouped, all other blocks normalised and headings paired, and document, problems."""
    blocks = written(blocks, "tree")
    problems = written(problem_quotes(blocks, is_problem), "problems")
    keyed = blocks.withColumn("_top", upto(F.col("path"), 1))
    named = problems.select("document", F.col("path").alias("_top"))
    ours = written(keyed.join(named, ["document", "_top"], "left_semi").drop("_top"), "quotes")
    rest = keyed.join(named, ["document", "_top"], "left_anti").drop("_top")
    counts = blocks.select("document").distinct().join(problems.groupBy("document").agg(F.count(F.lit(1)).alias("problems")), "document", "left").na.fill(0, ["problems"])
    return with_headings(written(regrouped(ours).unionByName(normalized(rest)), "rewritten")), counts


# -- segments ----------------------------------------------------------------------------------------


def segments(blocks: DataFrame) -> DataFrame:
    """The blocks with `segment`, the number of the segment they lie in (0 before the first marker), and the
    `node` of its marker where the block is one."""
    top = blocks.where(F.size("path") == 1)
    node = F.when(top["kind"].isin("RawBlock", "RawInline"), F.nullif(F.regexp_extract(rn.shown(F.col("runs")), SEGMENT, 1), F.lit("")))
    marks = top.select("document", F.col("path").alias("_top"), node.alias("node"))
    marks = marks.withColumn("segment", F.count("node").over(Window.partitionBy("document").orderBy("_top").rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.withColumn("_top", upto(F.col("path"), 1)).join(marks, ["document", "_top"]).withColumn("node", F.when(F.size("path") == 1, F.col("node")))


def segment_faults(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """document, check, subject: what forbids grouping the segments of a document.

    rows: of `segments`; groups: document, group_id, role, style, membership (complete or anchor-only),
    anchor, members (node ids in order).
    """
    marks = rows.where("node is not null").select("document", "node", "segment")
    edges = groups.select("document", "group_id", F.posexplode("members").alias("k", "node"))
    found = edges.join(marks, ["document", "node"], "left")
    told = lambda df, check, subject: df.select("document", F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"))
    tops = rows.where("size(path) = 1 and node is null and segment > 0")
    quote = F.count_if(F.col("kind") == "BlockQuote").alias("target")
    filled = tops.groupBy("document", "segment").agg(quote, F.count_if(F.col("kind") != "BlockQuote").alias("source"))
    member = found.where("segment is not null").join(filled, ["document", "segment"], "left").na.fill(0, ["target", "source"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("k", "segment"))), lambda s: s["segment"])
    by_group = member.groupBy("document", "group_id").agg(
        order.alias("at"), F.count(F.lit(1)).alias("n"), F.min("segment").alias("lo"), F.max("segment").alias("hi"), F.count_distinct("segment").alias("d"),
        F.sum("target").alias("target"), F.sum("source").alias("source"), F.max(F.when(F.col("target") + F.col("source") > 0, F.col("segment"))).alias("last_filled"),
        F.min(F.when(F.col("target") + F.col("source") > 0, F.col("segment"))).alias("first_filled"),
    )
    by_group = by_group.join(groups.select("document", "group_id", "membership"), ["document", "group_id"])
    straight = F.col("at") == F.array_sort("at")
    turned = (F.get("at", F.lit(0)) == F.col("hi")) & (F.coalesce("first_filled", "hi") == F.col("hi"))
    gap = (F.col("d") != F.col("n")) | (F.col("hi") - F.col("lo") + 1 != F.col("n"))
    return reduce(DataFrame.unionByName, [
        told(groups.where("coalesce(size(members), 0) < 1 or group_id is null or group_id = ''"), "group_invalid", "group_id"),
        told(groups.where("membership = 'anchor-only' and not (members <=> array(anchor))"), "anchor_only_members", "group_id"),
        told(edges.groupBy("document", "node").count().where("count > 1"), "node_shared", "node"),
        told(marks.groupBy("document", "node").count().where("count > 1"), "marker_repeated", "node"),
        told(found.where("segment is null"), "member_absent", "node"),
        told(by_group.where(gap), "members_not_contiguous", "group_id"),
        told(by_group.where(~gap & ~straight & ~turned), "member_order", "group_id"),
        told(member.where("(source = 0 and target > 0) or target > 1"), "member_content", "node"),
        told(by_group.where("source = 0 or target = 0"), "not_bilingual", "group_id"),
        told(by_group.where("membership = 'anchor-only' and target <> 1"), "anchor_only_target", "group_id"),
    ])


def with_groups(blocks: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree with the segments of each group in one quote, and the faults; documents with faults give no tree.

    The sources of a group come first, then a rule and the content of its translations, between two
    marks that name role, style, membership and group. Other segments keep their markers.
    """
    rows, groups = written(segments(blocks), "segments"), written(groups, "groups")
    faults = written(segment_faults(rows, groups), "faults")
    sound = rows.join(faults.select("document").distinct(), "document", "left_anti")
    edges = groups.select("document", "group_id", "role", "style", "membership", F.posexplode("members").alias("k", "node"))
    owner = sound.where("node is not null").select("document", "node", "segment", F.col("path").alias("_at")).join(edges, ["document", "node"]).drop("node")
    first = Window.partitionBy("document", "group_id")
    owner = owner.withColumn("_at", F.min("_at").over(first))
    mine = written(sound.join(owner, ["document", "segment"], "left"), "owned")
    free = mine.where("group_id is null").select(blocks.columns)
    body = mine.where("group_id is not null and node is null")
    top_kind = body.where("size(path) = 1").select("document", "_top", F.col("kind").alias("_top_kind"))
    body = body.join(top_kind, ["document", "_top"])
    cut = cut_paragraphs(body.select("document", "path", "kind", "level", "runs"))
    info = body.select("document", "path", "_at", "k", F.when(F.col("_top_kind") == "BlockQuote", TARGET).otherwise(SOURCE).cast("int").alias("_side"), "_top_kind")
    cut = cut.join(info, ["document", "path"]).where("not (_top_kind = 'BlockQuote' and size(path) = 1)")
    # a translation's own quote dissolves, so its children come to stand where the others do
    dropped = F.when(F.col("_side") == TARGET, 1).otherwise(0)
    address = lambda path: F.concat("_at", F.array("_side"), F.array("k"), path)
    parent = F.when(F.size("path") == 1 + dropped, F.col("_at")).otherwise(address(F.slice("path", 1, F.size("path") - 1)))
    last = F.when(F.col("kind").isin(*PARAGRAPHS), F.array("part")).otherwise(F.array().cast(PLACE))
    content = cut.select("document", F.concat(address(F.col("path")), last).alias("place"), parent.alias("parent"), "kind", "level", "runs")

    heads = owner.select("document", "group_id", "role", "style", "membership", "_at").distinct()
    empty, none, no_level = F.array().cast(PLACE), F.lit(None).cast(rn.RUNS), F.lit(None).cast("int")
    label = lambda text: rn.words(F.concat_ws("|", F.lit(text), "role", "style", "membership", "group_id"))
    row = lambda at, parent, kind, runs: heads.select("document", at.alias("place"), parent.alias("parent"), F.lit(kind).alias("kind"), no_level.alias("level"), runs.alias("runs"))
    at = F.col("_at")
    made = [row(at, empty, "BlockQuote", none), row(place(at, 0), at, "Para", label(CALLOUT_BEGIN)), row(place(at, 2), at, "HorizontalRule", none), row(place(at, 4), at, "Para", label(CALLOUT_END))]
    return with_headings(written(reduce(DataFrame.unionByName, [normalized(free), content, *made]), "grouped")), faults


def group_counts(groups: DataFrame, roles: DataFrame) -> DataFrame:
    """document, role, grouped, complete, anchor_only for every role (role) of the profile."""
    n = groups.groupBy("document", "role").agg(F.count(F.lit(1)).alias("grouped"), F.count_if(F.col("membership") == "complete").alias("complete"), F.count_if(F.col("membership") == "anchor-only").alias("anchor_only"))
    every = groups.select("document").distinct().crossJoin(F.broadcast(roles.select("role").distinct()))  # a profile has a few dozen roles
    return every.join(n, ["document", "role"], "left").na.fill(0)


def shown_tree(rows: DataFrame) -> DataFrame:
    """document, place, nested, kind, level, text of a RESULT: one row a block, for reports."""
    return rows.select("document", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), (F.size("parent") > 0).alias("nested"), "kind", "level", rn.shown(F.col("runs")).alias("text"))
