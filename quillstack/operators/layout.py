"""Page layout: captions, what continues them, the drawings above them, and lines of one row.

Joins run within a page, so their fan-out is bounded by what a page holds; only the growing of a
cluster and of a row, which depend on what was taken before, run as Python, one group at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import horizontal_overlap_ratio
from .sequences import anchored_clusters, column_bounds

#: Fixed values, in points: caption rows, continuation gap and length, reach of drawings, growth, margins, least visual.
ROW_REACH, CONTINUES, LONGEST, ABOVE, HIGHEST, TOUCH, GROW, SLACK, LEAST_W, LEAST_H = 18.0, 24.0, 180, 380.0, 400.0, 3.0, 8.0, 4.0, 40.0, 30.0
CAPTION_END = r"(?d)[.!?。！？][\"')\]]?$"
BOX = ["x0", "y0", "x1", "y1"]


def caption_columns(captions: DataFrame, page: str, width: float) -> DataFrame:
    """Captions (id, x0, y0, x1, y1, source) with cluster and the column each stands in."""
    rows = anchored_clusters(captions.withColumn("_k", F.struct("x0", "id")).withColumn("_o", F.row_number().over(Window.partitionBy(page).orderBy("y0", "_k"))).drop("_k"), [page], "_o", "y0", ROW_REACH)
    return column_bounds(rows.drop("_o"), [page, "cluster"], "x0", "x1", width)


def continuations(captions: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """caption, block: short prose just below a caption that has no end, centred in its column."""
    c = captions.select(page, F.col("id").alias("caption"), F.col("y1").alias("_bottom"), "column_left", "column_right", "source").where(~F.trim("source").rlike(CAPTION_END)).drop("source")
    b = blocks.where(F.col("kind") == "prose").where(F.length("source") <= LONGEST).select(page, F.col("id").alias("block"), "y0", ((F.col("x0") + F.col("x1")) / 2).alias("_centre"))
    near = F.col("y0").between(F.col("_bottom"), F.col("_bottom") + CONTINUES) & F.col("_centre").between(F.col("column_left"), F.col("column_right"))
    return c.join(b, page).where(near & (F.col("caption") != F.col("block"))).select("caption", "block")


def drawings_above(captions: DataFrame, drawings: DataFrame, page: str) -> DataFrame:
    """caption and drawing boxes: drawings that end above a caption, within reach, half inside its column."""
    c = captions.select(page, F.col("id").alias("caption"), F.col("y0").alias("_top"), "column_left", "column_right")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = drawings.where((width * height >= 20) | (F.greatest(width, height) >= 8)).select(page, *BOX)
    reach = (F.col("y1") <= F.col("_top") + TOUCH) & (F.col("_top") - F.col("y1") <= ABOVE) & (F.col("y0") >= F.greatest(F.lit(0.0), F.col("_top") - HIGHEST))
    inside = horizontal_overlap_ratio(F.col("x0"), F.col("x1"), F.col("column_left"), F.col("column_right")) >= 0.5
    return c.join(d, page).where(reach & inside).drop(page)


def grown(boxes: list[tuple[float, float, float, float]], reach: float = GROW) -> tuple[float, float, float, float]:
    """The union that starts at the lowest, largest box and takes in all that touches its widened form."""
    left = sorted(boxes, key=lambda b: (b[3], (b[2] - b[0]) * (b[3] - b[1]), b[2] - b[0] + b[3] - b[1]))
    u = left.pop()
    while True:
        touching = [b for b in left if b[0] <= u[2] + reach and b[2] >= u[0] - reach and b[1] <= u[3] + reach and b[3] >= u[1] - reach]
        if not touching:
            return u
        left = [b for b in left if b not in touching]
        all_ = [u, *touching]
        u = (min(b[0] for b in all_), min(b[1] for b in all_), max(b[2] for b in all_), max(b[3] for b in all_))


def visuals(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """caption, x0 .. y1, resolved: the drawing cluster of each caption, clipped to its column.

    A caption with no drawing in reach has no box and is not resolved.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        u = grown([tuple(b) for b in group[BOX].to_numpy().tolist()])
        first = group.iloc[0]
        x0, x1 = max(first["column_left"], u[0] - SLACK), min(first["column_right"], u[2] + SLACK)
        y0, y1 = max(0.0, u[1] - SLACK), min(first["_top"] - 2, u[3] + SLACK)
        return pd.DataFrame([[first["caption"], x0, y0, x1, y1, bool(x1 - x0 >= LEAST_W and y1 - y0 >= LEAST_H)]], columns=["caption", *BOX, "resolved"])

    kind = dict(candidates.dtypes)["caption"]
    found = candidates.groupBy("caption").applyInPandas(one, f"caption {kind}, x0 double, y0 double, x1 double, y1 double, resolved boolean")
    return captions.select(F.col("id").alias("caption")).join(found, "caption", "left").na.fill(False, ["resolved"])


def physical_rows(lines: DataFrame, block: str, slack: float = 1.2) -> DataFrame:
    """lines (block, line, x0 .. y1) with row: a line joins the first row whose grown edges both lie within slack."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows: list[list[float]] = []
        at = []
        group = group.sort_values(["y0", "x0", "line"], kind="stable")
        for y0, y1 in zip(group["y0"], group["y1"], strict=True):
            k = next((k for k, r in enumerate(rows) if abs(r[0] - y0) <= slack and abs(r[1] - y1) <= slack), len(rows))
            if k == len(rows):
                rows.append([y0, y1])
            else:
                rows[k] = [min(rows[k][0], y0), max(rows[k][1], y1)]
            at.append(k)
        return group.assign(row=at)

    return lines.groupBy(block).applyInPandas(one, T.StructType([*lines.schema.fields, T.StructField("row", T.LongType())]))


def page_list(spec: Column) -> Column:
    """"1, 3-5" as a sorted array of distinct pages; blank parts are skipped."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def spread(p: Column) -> Column:
        ends = F.split(p, "-")
        return F.sequence(F.get(ends, 0).cast("int"), F.element_at(ends, -1).cast("int"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread))))


def expected_roles(specs: DataFrame, spec: str) -> DataFrame:
    """ROLE=COUNT texts as role, expected; rows that don't parse have a null count."""
    parts = F.regexp_extract(spec, r"^([^=]+)=(\d+)$", 1), F.regexp_extract(spec, r"^([^=]+)=(\d+)$", 2)
    return specs.select(F.nullif(parts[0], F.lit("")).alias("role"), F.when(parts[1] != "", parts[1].cast("int")).alias("expected"))
