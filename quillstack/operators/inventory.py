"""Counts, duplicates, role inventories, roll-ups and report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import masked


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def duplicates(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, n, first_id, last_id of every key that occurs more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def margin_repetitions(lines: DataFrame, text: str, page: str, least: int = 3, compatible: bool = False) -> DataFrame:
    """key, pages: margin texts, digits masked, that occur on at least `least` pages."""
    keyed = lines.select(masked(F.col(text), compatible).alias("key"), page).where("key <> ''")
    return keyed.groupBy("key").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def role_inventory(roles: DataFrame, found: DataFrame) -> DataFrame:
    """roles (role, role_ord, least, most) with counts of found (role, id, group); roles without rows count 0."""
    seen = found.groupBy("role").agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("group").alias("group_count"), F.min("id").alias("first_id"))
    out = roles.join(seen, "role", "left").na.fill(0, ["node_count", "group_count"])
    within = (F.col("node_count") >= F.col("least")) & (F.col("most").isNull() | (F.col("node_count") <= F.col("most")))
    return out.withColumn("within_bounds", within)


def upper_median(values: str) -> Column:
    """The element at n // 2 of the sorted values: an order statistic, not an average of two."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def ranked_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, median: the same order statistic for groups too large to collect; it spills."""
    w = Window.partitionBy(by)
    placed = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where("_r = floor(_n / 2) + 1").select(by, F.col(value).alias("median"))


def weighted_ratios(spans: DataFrame, by: str, weight: str, **flags: Column) -> DataFrame:
    """For each flag, the share of the weight on rows that have it; a group without weight has 0."""
    total = F.greatest(F.sum(weight), F.lit(1))
    return spans.groupBy(by).agg(*[(F.sum(F.when(c, F.col(weight)).otherwise(0)) / total).alias(k) for k, c in flags.items()])


def status_of(gates: DataFrame) -> DataFrame:
    """One row: failed before manual review before passed; no gate at all is pending."""
    n = lambda s: F.count_if(F.col("status") == s)
    roll = F.when(F.count(F.lit(1)) == 0, "pending").when(n("failed") > 0, "failed").when(n("manual_review_required") > 0, "manual_review_required")
    roll = roll.when(F.count_if(~F.col("status").isin("passed", "failed", "manual_review_required")) > 0, "pending").otherwise("passed")
    return gates.agg(F.count(F.lit(1)).alias("gates"), n("passed").alias("passed"), n("failed").alias("failed"), n("manual_review_required").alias("manual"), roll.alias("status"))


def batch_summary(rows: DataFrame, part: str, ord_col: str, id_col: str, chars: str) -> DataFrame:
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"), F.min_by(id_col, ord_col).alias("first_id"), F.max_by(id_col, ord_col).alias("last_id"))


def bounding_box(rects: DataFrame, *keys: str) -> DataFrame:
    return rects.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def most_common(rows: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """by, place, value, n: the most frequent values of each group, ties by value. Counted before they are
    ranked, so a group costs its distinct values."""
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counted.select(by, place.alias("place"), value, "n").where(F.col("place") <= most)


def shortened(items: Column, most: int = 30, shown: int = 20) -> Column:
    """A report list: whole up to `most`, else its first `shown`."""
    return F.when(F.size(items) > most, F.slice(items, 1, shown)).otherwise(items)
