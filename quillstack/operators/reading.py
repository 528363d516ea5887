"""Reading order and line structure of pages, ids by place, build manifests and asset references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.strict_json import safe_path
from .coverage import copy_ratio
from .document_ir import OUTPUT_COLUMNS
from .inventory import ranked_median

#: What ends a sentence before a break, words that open a paragraph, the least extra gap.
LINE_END = r"(?d)[.!?。！？][\"')\]]?$"
OPENERS = r"^(?:Problem|Deliverable|For reference|Note)\b"
SLACK = 0.2


def line_breaks(lines: DataFrame, by: str, ord_col: str, text: str) -> DataFrame:
    """lines (y0, y1) with gap, breaks and paragraph, from 1: a paragraph ends where a sentence does and either
    the gap below it is wider than the median of the group's gaps or an opening word follows."""
    w = Window.partitionBy(by).orderBy(ord_col)
    rows = lines.withColumn("gap", F.col("y0") - F.lag("y1").over(w)).withColumn("_before", F.lag(text).over(w))
    median = ranked_median(rows.where("gap >= 0").select(by, "gap"), by, "gap")
    rows = rows.join(median, by, "left")
    ended = F.rtrim(F.col("_before")).rlike(LINE_END)
    breaks = ended & ((F.col("gap") > F.coalesce("median", F.lit(0.0)) + SLACK) | F.ltrim(F.col(text)).rlike(OPENERS))
    rows = rows.withColumn("breaks", F.coalesce(breaks, F.lit(False))).drop("_before", "median")
    return rows.withColumn("paragraph", F.sum(F.col("breaks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def best_order(candidates: DataFrame, page: str, strategy: str, preference: str, oracle: str, text: str, compatible: bool = False) -> DataFrame:
    """page, strategy, score: the reading order whose text holds most of the oracle's five-grams; the smaller
    preference on a tie. A page without grams scores 1.0 in any order."""
    scored = copy_ratio(candidates, oracle, text, compatible=compatible).withColumn("score", F.when(F.col("grams") > 0, F.col("ratio")).otherwise(1.0))
    best = F.max_by(F.struct(strategy, "score"), F.struct("score", (-F.col(preference)).alias("p")))
    return scored.groupBy(page).agg(best.alias("b")).select(page, F.col(f"b.{strategy}").alias("strategy"), "b.score")


def placed_ids(rows: DataFrame, document: str, page: str, ord_col: str, letter: str) -> DataFrame:
    """rows with place_id: p<page>-<letter><number on its page>, three digits each or as many as it takes."""
    number = F.row_number().over(Window.partitionBy(document, page).orderBy(ord_col))
    return rows.withColumn("place_id", F.format_string(f"p%03d-{letter}%03d", F.col(page), number))


def build_manifest(nodes: DataFrame) -> DataFrame:
    """document, nodes, one count for each output, translatable: what a build will emit."""
    counts = [F.count_if(F.col("output") == name).alias(c) for name, c in OUTPUT_COLUMNS.items()]
    return nodes.groupBy("document").agg(F.count(F.lit(1)).alias("nodes"), *counts, F.count_if(F.col("translatable") & (F.col("output") == "bilingual")).alias("requests"))


def asset_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """document, path, problem: references that leave the folder or name no file of it."""
    safe = F.coalesce(safe_path(F.col("path")), F.lit(False))
    unsafe = references.where(~safe).select("document", "path", F.lit("unsafe").alias("problem"))
    gone = references.where(safe).join(files.select("document", "path"), ["document", "path"], "left_anti").select("document", "path", F.lit("missing").alias("problem"))
    return unsafe.unionByName(gone).distinct()


def relative_to(path: Column, start: Column) -> Column:
    """The part of a POSIX path below a folder; null if it lies elsewhere."""
    folder = F.concat(F.rtrim(start, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, folder), F.substring(path, F.length(folder) + 1, F.length(path)))


def latex_url(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("%5C")), F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))


#: Weights and slants at the end of a font's name.
WEIGHTS = "thin|extralight|light|regular|medium|semibold|demibold|bold|extrabold|black|italic|oblique"


def font_family(path: Column) -> Column:
    """The letters and digits of a font file's name without folder, ending and weights."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(stem, "[^A-Za-z0-9]", "")), f"(?:{WEIGHTS})+$", "")
