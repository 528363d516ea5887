"""Order-dependent operators: windows where the rule looks at neighbours, folds where it carries state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentence ends, and words that can't end a sentence.
SENTENCE_END = r"(?d)[.!?;:。！？；：][\"')\]]?$"
CONNECTIVES = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "or", "the", "to", "with"]
THEOREMS = ["theorem", "lemma", "proposition", "corollary"]


def neighbours(rows: DataFrame, by: list[str], ord_col: str, text: str, eligible: Column, most: int = 320) -> DataFrame:
    """rows with context_before and context_after: the nearest eligible text in the same group, or ""."""
    w = Window.partitionBy(*by).orderBy(ord_col)
    value = F.when(eligible & (F.trim(F.col(text)) != ""), F.substring(F.trim(F.replace(F.col(text), F.lit("\n"), F.lit(" "))), 1, most))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("context_before", F.coalesce(before, F.lit(""))).withColumn("context_after", F.coalesce(after, F.lit("")))


def open_ended(text: Column) -> Column:
    """True if a text breaks off: no sentence mark at its end, or a connective as its last word."""
    tail = F.lower(F.regexp_extract(text, r"(?dU)([A-Za-z]+)\W*$", 1))
    return ~text.rlike(SENTENCE_END) | tail.isin(CONNECTIVES)


def islands(rows: DataFrame, by: list[str], ord_col: str, joins_previous: Column, name: str = "island") -> DataFrame:
    """Gaps and islands: a row opens an island unless it joins the row before it in its group."""
    w = Window.partitionBy(*by).orderBy(ord_col)
    opens = F.when(F.coalesce(joins_previous, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def paragraph_islands(blocks: DataFrame, by: list[str], ord_col: str, text: str, geometry: bool = False, most: int = 1800, roles: bool = False) -> DataFrame:
    """Adjacent fragments of one paragraph share an island: the earlier breaks off and both fit in `most`.

    With geometry, both also need a vertical gap of -2 to 10 and left edges within 44 (columns x0, y0,
    y1), a grouped kind, and no part in a caption (columns kind, translatable, caption_parent). With
    roles, both also need the same role and output, and neither may have relations or belong to a
    group (columns role, output, relations, groups; the last two are arrays).
    """
    w = Window.partitionBy(*by).orderBy(ord_col)
    lag = lambda c: F.lag(c).over(w)
    joins = open_ended(lag(F.col(text))) & (F.length(lag(F.col(text))) + F.length(text) <= most)
    if geometry:
        kinds = ["prose", "list"]
        joins = joins & F.col("kind").isin(kinds) & lag("kind").isin(kinds) & F.col("translatable") & lag("translatable") & F.col("caption_parent").isNull() & lag("caption_parent").isNull()
        joins = joins & (F.col("y0") - lag("y1")).between(-2, 10) & (F.abs(lag("x0") - F.col("x0")) <= 44)
    if roles:
        joins = joins & (F.col("role") == lag("role")) & (F.col("output") == lag("output"))
        for c in ("relations", "groups"):
            joins = joins & (F.size(F.col(c)) == 0) & (F.size(lag(c)) == 0)
    return islands(blocks, by, ord_col, joins)


def greedy_chunks(rows: DataFrame, by: list[str], ord_col: str, chars: str, most: int) -> DataFrame:
    """rows with chunk, from 1: a new chunk starts where the sum would exceed `most`; a row that is too
    long has one of its own.

    Where a chunk starts depends on where the last one started, so this is a fold and no window sum.
    Rows of a group arrive sorted and only three numbers are carried, so a group of any length streams.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])
    order = [*by, ord_col]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartition(parts, *by) if by else rows.coalesce(1)).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk, held = object(), 0, 0
        for batch in batches:
            keys = list(map(tuple, batch[by].to_numpy().tolist())) if by else [()] * len(batch)
            out = []
            for key, n in zip(keys, batch[chars].tolist(), strict=True):
                if key != last:
                    last, chunk, held = key, 1, 0
                elif held and held + n > most:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield batch.assign(chunk=out)

    return dealt.mapInPandas(run, schema)


def anchored_clusters(rows: DataFrame, by: list[str], ord_col: str, value: str, reach: float) -> DataFrame:
    """rows with cluster, from 1: a row joins while it lies within `reach` of its cluster's first row."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *by).sortWithinPartitions(*by, value, ord_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, cluster, anchor = object(), 0, 0.0
        for batch in batches:
            out = []
            for key, x in zip(map(tuple, batch[by].to_numpy().tolist()), batch[value].tolist(), strict=True):
                if key != last:
                    last, cluster, anchor = key, 1, x
                elif x - anchor > reach:
                    cluster, anchor = cluster + 1, x
                out.append(cluster)
            yield batch.assign(cluster=out)

    return dealt.mapInPandas(run, schema)


def page_order(rows: DataFrame, page: str, ord_col: str) -> DataFrame:
    """rows with page_order, and starts_page for the first row of each page."""
    w = Window.partitionBy(page).orderBy(ord_col)
    return rows.withColumn("page_order", F.row_number().over(w)).withColumn("starts_page", F.col("page_order") == 1)


def first_title(rows: DataFrame, by: list[str], ord_col: str, level: str) -> DataFrame:
    """rows with is_title: the first row of the group whose level is above 0."""
    w = Window.partitionBy(*by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.when(F.col(level) > 0, 1).otherwise(0)).over(w)
    return rows.withColumn("is_title", (F.col(level) > 0) & (seen == 1))


def backward_steps(rows: DataFrame, by: list[str], ord_col: str, page: str) -> DataFrame:
    """Rows whose page is below that of the row before them."""
    w = Window.partitionBy(*by).orderBy(ord_col)
    return rows.withColumn("previous_page", F.lag(page).over(w)).where(F.col("previous_page") > F.col(page))


def index_mismatch(rows: DataFrame, by: list[str], ord_col: str, index: str) -> DataFrame:
    """Rows whose stored zero-based index is not their position."""
    w = Window.partitionBy(*by).orderBy(ord_col)
    return rows.withColumn("position", F.row_number().over(w) - 1).where(~F.col("position").eqNullSafe(F.col(index)))


def numbered_by_first_use(rows: DataFrame, value: str, ord_col: str) -> DataFrame:
    """value, first_at, number: distinct values numbered by where they occur first.

    Numbered within equal slices of the range of first places, and shifted by how many lie in the
    slices before, so no task holds all values.
    """
    firsts = rows.groupBy(value).agg(F.min(ord_col).alias("first_at"))
    slices = 256
    span = firsts.agg(F.min("first_at").alias("_lo"), F.max("first_at").alias("_hi"))
    cut = F.floor((F.col("first_at") - F.col("_lo")) * slices / (F.col("_hi") - F.col("_lo") + 1))
    cut_rows = firsts.crossJoin(F.broadcast(span)).withColumn("_cut", cut).drop("_lo", "_hi")  # span is one row
    sizes = cut_rows.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_cut", (F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n")).alias("_before"))  # at most 256 rows
    inside = F.row_number().over(Window.partitionBy("_cut").orderBy("first_at", value))
    return cut_rows.join(F.broadcast(before), "_cut").select(value, "first_at", (inside + F.col("_before")).cast("int").alias("number"))


def contiguous(rows: DataFrame, group: str, index: str) -> DataFrame:
    """group, members, is_contiguous: indices without gaps or repeats."""
    agg = rows.groupBy(group).agg(F.count(index).alias("members"), F.countDistinct(index).alias("_d"), (F.max(index) - F.min(index) + 1).alias("_span"))
    return agg.select(group, "members", ((F.col("_span") == F.col("members")) & (F.col("_d") == F.col("members"))).alias("is_contiguous"))


def member_order(rows: DataFrame, group: str, listed: str, index: str) -> DataFrame:
    """group, members, order: how the indices run in the order in which members are listed.

    in_order: each is one more than the one before. rotated: in order but for one place, where the last
    index is followed by the first (an anchor listed behind its members). Anything else is broken.
    """
    w = Window.partitionBy(group).orderBy(listed)
    step = rows.withColumn("_step", F.col(index) - F.lag(index).over(w))
    agg = step.groupBy(group).agg(F.count(index).alias("members"), F.count_if(F.col("_step") != 1).alias("_off"), (F.max(index) - F.min(index) + 1).alias("_span"), F.min_by(index, listed).alias("_first"), F.max_by(index, listed).alias("_last"), F.countDistinct(index).alias("_d"))
    whole = (F.col("_span") == F.col("members")) & (F.col("_d") == F.col("members"))
    order = F.when(whole & (F.col("_off") == 0), "in_order").when(whole & (F.col("_off") == 1) & (F.col("_first") == F.col("_last") + 1), "rotated").otherwise("broken")
    return agg.select(group, "members", order.alias("order"))


def segments(rows: DataFrame, by: list[str], ord_col: str, marker: Column) -> DataFrame:
    """rows with segment: 0 before the first marker, then one more at each."""
    w = Window.partitionBy(*by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(marker, 1).otherwise(0)).over(w))


def marker_ranges(rows: DataFrame, by: list[str], ord_col: str, kind: str) -> DataFrame:
    """Begin and end markers: depth after each row, and faults (end without begin, begin inside)."""
    w = Window.partitionBy(*by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(kind) == "begin", 1).when(F.col(kind) == "end", -1).otherwise(0)
    out = rows.withColumn("depth", F.sum(step).over(w))
    fault = F.when(F.col("depth") < 0, "end without begin").when((F.col("depth") > 1) & (F.col(kind) == "begin"), "begin inside")
    return out.withColumn("fault", fault)


def border_ranges(rows: DataFrame, by: list[str], ord_col: str, colour: str, bottom: str) -> DataFrame:
    """group, colour, first, last, rows of each run of one side colour; a bottom border ends a run."""
    w = Window.partitionBy(*by).orderBy(ord_col)
    joins = (F.col(colour) == F.lag(colour).over(w)) & ~F.coalesce(F.lag(bottom).over(w), F.lit(False))
    runs = islands(rows, by, ord_col, joins, "run").where(F.col(colour).isNotNull())
    return runs.groupBy(*by, "run", colour).agg(F.min(ord_col).alias("first"), F.max(ord_col).alias("last"), F.count(F.lit(1)).alias("n"))


def constraint_failures(nodes: DataFrame, by: list[str], ord_col: str, role: str) -> DataFrame:
    """by, and one boolean for each named order rule.

    heading_hierarchy: no subsection before the first section. proof_order: every proof follows a
    theorem since the last section. academic_order: title, abstract, section, references each there and
    in this order by first occurrence, authors between title and abstract.
    """
    w = Window.partitionBy(*by).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.max(F.when(c, F.col(ord_col))).over(w)
    r = F.col(role)
    marked = nodes.withColumn("_section", last(r == "section")).withColumn("_theorem", last(r.isin(THEOREMS)))
    first = lambda name: F.min(F.when(r == name, F.col(ord_col)))
    late = F.max(F.when(r == "author-affiliation", F.col(ord_col)))
    orphan = (r == "proof") & (F.col("_theorem").isNull() | (F.col("_theorem") < F.coalesce("_section", F.col("_theorem"))))
    agg = marked.groupBy(*by).agg(
        (F.count_if((r == "subsection") & F.col("_section").isNull()) == 0).alias("heading_hierarchy"),
        (F.count_if(orphan) == 0).alias("proof_order"),
        *(first(n).alias(f"_{k}") for k, n in (("title", "title"), ("abstract", "abstract"), ("first_section", "section"), ("references", "references"))),
        first("author-affiliation").alias("_early"),
        late.alias("_late"),
    )
    order = (F.col("_title") < F.col("_abstract")) & (F.col("_abstract") < F.col("_first_section")) & (F.col("_first_section") < F.col("_references"))
    authors = F.col("_early").isNull() | ((F.col("_title") < F.col("_early")) & (F.col("_late") < F.col("_abstract")))
    return agg.select(*by, "heading_hierarchy", "proof_order", F.coalesce(order & authors, F.lit(False)).alias("academic_order"))


def column_bounds(captions: DataFrame, by: list[str], x0: str, x1: str, width: float, margin: float = 36.0) -> DataFrame:
    """captions with column_left and column_right: midpoints to the neighbours, margins at the ends."""
    w = Window.partitionBy(*by).orderBy("_centre")
    rows = captions.withColumn("_centre", (F.col(x0) + F.col(x1)) / 2)
    left = F.coalesce((F.lag("_centre").over(w) + F.col("_centre")) / 2, F.lit(margin))
    right = F.coalesce((F.lead("_centre").over(w) + F.col("_centre")) / 2, F.lit(width - margin))
    return rows.withColumn("column_left", left).withColumn("column_right", right).drop("_centre")
