"""Text of page blocks from their spans: spaces between spans, indents of code, paragraphs, fonts and protected runs.

A span row has block, left (the block's x0), line, lx0 .. ly1 (the line's box), x0 .. y1, text, font and
size. Everything is windows by block and row but the grouping of lines, which depends on what was taken
before. A block is a part of a page, so its rows fit a task; blocks are dealt by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import font_role
from .layout import physical_rows
from .reading import line_breaks

#: Least gap of a space in points and in sizes, share of code letters of a code row, width of an indent in sizes.
LEAST_GAP, GAP, CODE_ROW, INDENT = 1.0, 0.14, 0.70, 0.52
BOX = {"lx0": "x0", "ly0": "y0", "lx1": "x1", "ly1": "y1"}


def upper_median(values: Column) -> Column:
    """The middle of collected values, the upper one of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def in_rows(spans: DataFrame) -> DataFrame:
    """Spans that show something with row (from 1 in reading order), its box, piece, prefix and start in the row."""
    lines = physical_rows(spans.select("block", "line", *[F.col(a).alias(b) for a, b in BOX.items()]).distinct(), "block")
    boxes = lines.groupBy("block", "row").agg(F.min("x0").alias("rx0"), F.min("y0").alias("ry0"), F.max("y1").alias("ry1"))
    order = boxes.withColumn("_at", F.row_number().over(Window.partitionBy("block").orderBy("ry0", "rx0", "row")))
    placed = spans.where("text <> ''").join(lines.select("block", "line", "row").join(order, ["block", "row"]), ["block", "line"]).drop("row").withColumnRenamed("_at", "row")
    row = Window.partitionBy("block", "row")
    w = row.orderBy("x0", "y0", "line", "x1", "text")
    gap = F.col("x0") - F.lag("x1").over(w)
    apart = F.coalesce((gap > F.greatest(F.lit(LEAST_GAP), F.col("size") * GAP)) & ~F.lag("text").over(w).rlike("[ \\t]$"), F.lit(False))
    role = font_role(F.col("font"))
    code = F.sum(F.when(role == "code", F.length("text")).otherwise(0)).over(row) / F.sum(F.length("text")).over(row)
    steps = F.bround((F.col("rx0") - F.col("left")) / F.greatest(F.lit(1.0), upper_median(F.collect_list("size").over(row)) * INDENT)).cast("int")
    prefix = F.when(code >= CODE_ROW, F.greatest(F.lit(0), steps)).otherwise(0)
    rows = placed.withColumn("role", role).withColumn("prefix", prefix).withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("piece", F.concat(F.when(apart, " ").otherwise(""), "text"))
    ends = F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", F.col("prefix") + ends - F.length("text"))


def row_texts(placed: DataFrame) -> DataFrame:
    """block, row, y0, y1, body, breaks, paragraph, separator and offset of each row in the block's untrimmed text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda p: p["piece"]), "")
    rows = placed.groupBy("block", "row").agg(F.first("ry0").alias("y0"), F.first("ry1").alias("y1"), F.first("prefix").alias("prefix"), body.alias("body"))
    rows = rows.withColumn("body", F.regexp_replace(F.concat(F.repeat(F.lit(" "), F.col("prefix")), "body"), r"(?U)\s+$", ""))
    rows = line_breaks(rows, "block", "row", "body")
    w = Window.partitionBy("block").orderBy("row")
    rows = rows.withColumn("separator", F.when(F.row_number().over(w) == 1, "").when(F.col("breaks"), "\n\n").otherwise("\n"))
    before = F.sum(F.length("separator") + F.length("body")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("offset", before - F.length("body"))


def whole_texts(rows: DataFrame) -> DataFrame:
    """block, text, trimmed (letters cut at the start), lines, paragraphs."""
    listed = F.array_sort(F.collect_list(F.struct("row", F.concat("separator", "body").alias("s"))))
    out = rows.groupBy("block").agg(F.array_join(F.transform(listed, lambda r: r["s"]), "").alias("_t"), F.count(F.lit(1)).alias("lines"), F.max("paragraph").alias("paragraphs"))
    begun = F.regexp_replace("_t", r"(?U)^\s+", "")
    return out.select("block", F.regexp_replace(begun, r"(?U)\s+$", "").alias("text"), (F.length("_t") - F.length(begun)).alias("trimmed"), "lines", "paragraphs")


def fonts(placed: DataFrame) -> DataFrame:
    """block, fonts: its fonts with their letters, the most used first and the first seen first among equals."""
    each = placed.groupBy("block", "font").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("row", "n")).alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("k"), "seen", "font", "chars")))
    return each.groupBy("block").agg(F.transform(listed, lambda f: F.struct(f["font"].alias("font"), f["chars"].alias("chars"))).alias("fonts"))


def block_texts(spans: DataFrame) -> DataFrame:
    """block, text, lines, paragraphs, sizes, shares of code, math and bold letters (four places) and fonts.

    A block whose spans show nothing gives no row.
    """
    placed = in_rows(spans)
    n = F.length("text")
    share = lambda c: F.round(F.sum(F.when(c, n).otherwise(0)) / F.greatest(F.lit(1), F.sum(n)), 4)
    stats = placed.groupBy("block").agg(
        F.max("size").alias("max_size"), upper_median(F.collect_list("size")).alias("median_size"),
        share(F.col("role") == "code").alias("mono_ratio"), share(F.col("role") == "math").alias("math_ratio"), share(F.contains(F.lower("font"), F.lit("bold"))).alias("bold_ratio"),
    )
    return whole_texts(row_texts(placed)).drop("trimmed").join(stats, "block").join(fonts(placed), "block")


def protected_runs(spans: DataFrame) -> DataFrame:
    """block, start, end, text, role: code and math spans as ranges of the block's text, cut where it is trimmed."""
    placed = in_rows(spans)
    rows = row_texts(placed)
    whole = whole_texts(rows).select("block", F.col("text").alias("_whole"), "trimmed")
    runs = placed.where("role is not null").select("block", "row", "start", F.length("text").alias("_n"), "role").join(rows.select("block", "row", "offset", "body"), ["block", "row"]).join(whole, "block")
    start = F.greatest(F.col("offset") + F.col("start"), F.col("trimmed")) - F.col("trimmed")
    end = F.least(F.col("offset") + F.col("start") + F.col("_n"), F.col("offset") + F.length("body"), F.col("trimmed") + F.length("_whole")) - F.col("trimmed")
    cut = runs.select("block", start.alias("start"), end.alias("end"), "role", "_whole").where("start < end")
    return cut.select("block", "start", "end", F.expr("substring(_whole, cast(start + 1 as int), cast(end - start as int))").alias("text"), "role")
