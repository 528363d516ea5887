"""Review, plan and final gates: lineage of hashes, reviewed pages, batches against their plan.

A lineage row (work, artifact, sha256) says what a stage read; an artifact row what is there now.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_cover


def stale(lineage: DataFrame, artifacts: DataFrame) -> DataFrame:
    """work, artifact, problem: what a stage read that is gone, has other content now or was read without a hash."""
    now = artifacts.select("work", "artifact", F.col("sha256").alias("_now"))
    both = lineage.join(now, ["work", "artifact"], "left")
    problem = F.when(F.col("_now").isNull(), "gone").when(F.col("sha256").isNull(), "unpinned").when(F.col("_now") != F.col("sha256"), "changed")
    return both.select("work", "artifact", problem.alias("problem")).where("problem is not null")


def visual_review_faults(reviews: DataFrame, sheets: DataFrame, artifacts: DataFrame, pages: DataFrame) -> DataFrame:
    """work, check, subject: a review without a reviewer or verdict, of sheets that changed since, or of pages
    that the sheets don't cover exactly once.

    reviews: work, reviewer, status; sheets: work, artifact, sha256, first_page, last_page; artifacts:
    work, artifact, sha256; pages: work, page.
    """
    blank = F.coalesce(F.trim("reviewer") == "", F.lit(True))
    row = lambda df, check, subject: df.select("work", F.lit(check).alias("check"), subject.cast("string").alias("subject"))
    shown = sheets.select("work", F.explode(F.sequence("first_page", "last_page")).alias("page")).groupBy("work", "page").agg(F.count(F.lit(1)).alias("covers"))
    both = pages.select("work", "page").withColumn("_there", F.lit(True)).join(shown, ["work", "page"], "full_outer")
    none = pages.select("work").distinct().join(reviews, "work", "left_anti")
    parts = [
        row(none, "review_missing", F.col("work")),
        row(reviews.where(blank), "reviewer", F.col("work")),
        row(reviews.where(~F.coalesce(F.col("status").isin("passed", "failed"), F.lit(False))), "verdict", F.col("status")),
        row(stale(sheets, artifacts), "sheet_stale", F.concat_ws(" ", "artifact", "problem")),
        row(both.where("covers is null"), "page_not_shown", F.col("page")),
        row(both.where("covers > 1"), "page_shown_twice", F.col("page")),
        row(both.where("_there is null"), "page_unknown", F.col("page")),
    ]
    return reduce(DataFrame.unionByName, parts)


def final_status(gates: DataFrame, lineage: DataFrame, artifacts: DataFrame, needed: list[str]) -> DataFrame:
    """work, passed, open, stale, status: final only if every needed gate passed on what is there now."""
    count = gates.where(F.col("gate").isin(needed)).groupBy("work").agg(
        F.count_distinct(F.when(F.col("status") == "passed", F.col("gate"))).alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "manual_review_required").alias("manual"),
    )
    old = stale(lineage, artifacts).groupBy("work").agg(F.count(F.lit(1)).alias("stale"))
    out = count.join(old, "work", "left").na.fill(0, ["stale"]).withColumn("open", F.lit(len(needed)) - F.col("passed"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("stale") > 0, "stale").when(F.col("manual") > 0, "manual_review_required").when(F.col("open") > 0, "pending").otherwise("passed")
    return out.select("work", "passed", "open", "stale", status.alias("status"))


def plan_faults(plan: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """work, check, subject: batches of a plan (work, part, segments, chars, first_id, last_id) against the
    request rows (work, part, id, ord, chars) they name, and answers (work, id) outside the plan or missing."""
    w = Window.partitionBy("work").orderBy("part")
    order = plan.withColumn("_k", F.row_number().over(w)).where("_k <> part")
    real = requests.groupBy("work", "part").agg(F.count(F.lit(1)).alias("_n"), F.sum("chars").alias("_chars"), F.min_by("id", "ord").alias("_first"), F.max_by("id", "ord").alias("_last"))
    both = plan.join(real, ["work", "part"], "full_outer")
    row = lambda df, check, subject: df.select("work", F.lit(check).alias("check"), subject.cast("string").alias("subject"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = both.where("segments is not null and _n is not null")
    parts = [
        row(order, "part_order", F.col("part")),
        row(both.where("_n is null"), "part_empty", F.col("part")),
        row(both.where("segments is null"), "part_unplanned", F.col("part")),
        row(known.where(~same("segments", "_n")), "segments", F.col("part")),
        row(known.where(~same("chars", "_chars")), "characters", F.col("part")),
        row(known.where(~same("first_id", "_first") | ~same("last_id", "_last")), "boundary", F.col("part")),
        row(requests.join(responses, ["work", "id"], "left_anti"), "unanswered", F.col("id")),
        row(responses.join(requests, ["work", "id"], "left_anti"), "unasked", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def log_tail(text: Column, most: int = 5000) -> Column:
    """The last letters of a log; all of a short one."""
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, -most, most))


def least_of(pages: DataFrame, by: str) -> DataFrame:
    """by, least_text, least_ink: the emptiest page of a rendering."""
    return pages.groupBy(by).agg(F.min(F.length(F.trim("text"))).alias("least_text"), F.min("ink").alias("least_ink"))


def callout_ranges(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, matches, range_id: the one framed range (document, range_id, text) that holds the group's text
    (document, group_id, text) whole; null unless exactly one does. Ranges of a document are few, and the
    join is by document."""
    flat = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", " ")
    inside = ranges.select("document", "range_id", flat("text").alias("_r"))
    hit = groups.join(inside, (groups["document"] == inside["document"]) & F.contains(F.col("_r"), flat("text")), "left").select(groups["document"], "group_id", "range_id")
    out = hit.groupBy("document", "group_id").agg(F.count("range_id").alias("matches"), F.min("range_id").alias("range_id"))
    return out.withColumn("range_id", F.when(F.col("matches") == 1, F.col("range_id")))


def disjoint(ranges: DataFrame, key: str) -> DataFrame:
    """key, place, n: places that several ranges (key, first, last) claim."""
    return ranges.select(key, F.explode(F.sequence("first", "last")).alias("place")).groupBy(key, "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def in_order(pieces: DataFrame, key: str, ord_col: str, whole: str, piece: str) -> DataFrame:
    """key, pieces, found, ordered: whether the pieces occur in their container, each behind the one before."""
    w = Window.partitionBy(key).orderBy(ord_col)
    rows = pieces.withColumn("_at", F.expr(f"locate(`{piece}`, `{whole}`)")).withColumn("_before", F.lag("_at").over(w))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("_at") > 0).alias("found"), (F.count_if((F.col("_at") == 0) | (F.col("_at") <= F.col("_before"))) == 0).alias("ordered"))


def evidence_counts(nodes: DataFrame, role: str, visual: Column) -> DataFrame:
    """role, textual, visual: how many nodes of a role are shown by text and by a picture."""
    return nodes.groupBy(role).agg(F.count_if(~visual).alias("textual"), F.count_if(visual).alias("visual"))


def joined_continuations(captions: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """caption, text: a caption's own text and that of the blocks that continue it, in order, joined by blanks."""
    more = pairs.join(texts.select(F.col("id").alias("block"), "ord", "source"), "block").select("caption", "ord", "source")
    own = captions.select(F.col("id").alias("caption"), "ord", "source")
    rows = own.unionByName(more)
    return rows.groupBy("caption").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda s: F.trim(s["source"])), " ").alias("text"))


__all__ = ["callout_ranges", "disjoint", "evidence_counts", "final_status", "in_order", "joined_continuations", "least_of", "log_tail", "plan_faults", "range_cover", "stale", "visual_review_faults"]
