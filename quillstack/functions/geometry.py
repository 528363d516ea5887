"""Rectangles: predicates as Column builders, and the exact area of a union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_width(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.least(a[1], b[1]) - F.greatest(a[0], b[0])


def intersection(a: str, b: str) -> Column:
    """Area shared by rectangles whose columns are <prefix>x0 .. <prefix>y1; 0 if apart."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = overlap_width((c(a, "x0"), c(a, "x1")), (c(b, "x0"), c(b, "x1")))
    h = overlap_width((c(a, "y0"), c(a, "y1")), (c(b, "y0"), c(b, "y1")))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def horizontal_overlap_ratio(x0: Column, x1: Column, left: Column, right: Column) -> Column:
    """Share of [x0, x1] inside [left, right]; narrower than 1, it is in or out by its left edge."""
    width = x1 - x0
    inside = F.greatest(F.least(x1, right) - F.greatest(x0, left), F.lit(0.0)) / F.greatest(width, F.lit(1.0))
    return F.when(width < 1, x0.between(left, right).cast("double")).otherwise(inside)


def scaled_box(box: Column, size: Column) -> Column:
    """A box in page points as whole thousandths of the page, cut toward zero."""
    return F.array(*[(F.get(box, i) * 1000 / F.get(size, i % 2)).cast("int") for i in range(4)])


def in_bands(rects: DataFrame, low: str, high: str, keys: list[str], bands: DataFrame, first: str, name: str = "_band") -> DataFrame:
    """rects with one row for each band of [low, high) that they reach into, and the first of these; bands (keys, _start, _height)."""
    cut = lambda c: F.floor((F.col(c) - F.col("_start")) / F.col("_height"))
    placed = rects.join(bands, keys).withColumn(first, cut(low))
    return placed.withColumn(name, F.explode(F.sequence(F.col(first), cut(high)))).drop("_start", "_height")


def bands_of(rects: DataFrame, low: str, high: str, keys: list[str], most: int = 4096) -> DataFrame:
    """keys, _start, _height: bands as high as the mean rectangle of the key, and at most `most` of them.

    Rectangles then reach into about two bands each, and only those that share a band can overlap.
    """
    whole = F.max(high) - F.min(low)
    height = F.greatest(F.avg(F.col(high) - F.col(low)), whole / most)
    return rects.groupBy(*keys).agg(F.min(low).alias("_start"), F.when(height > 0, height).otherwise(1.0).alias("_height"))


#: Fixed value: a grid has at most so many columns and rows.
MOST_CELLS = 64


def grid_of(rects: DataFrame, keys: list[str], p: str = "") -> DataFrame:
    """keys, and for x and y: where the grid of the key begins and ends (_x0, _x1), its number of columns (_xn) and
    their width (_xs). Cells are about half as wide and high as the mean rectangle, and fill the box of the rectangles."""

    def axis(c: str) -> list[Column]:
        low, high = f"{p}{c}0", f"{p}{c}1"
        whole = F.max(high) - F.min(low)
        n = F.ceil(2 * whole / F.avg(F.col(high) - F.col(low)))
        n = F.greatest(F.least(F.coalesce(n, F.lit(1)), F.lit(MOST_CELLS)), F.lit(1))
        return [F.min(low).alias(f"_{c}0"), F.max(high).alias(f"_{c}1"), n.alias(f"_{c}n"), (whole / n).alias(f"_{c}s")]

    return rects.groupBy(*keys).agg(*axis("x"), *axis("y"))


GRID = [f"_{c}{k}" for c in "xy" for k in ("0", "1", "n", "s")]


def cell_of(at: Column, c: str) -> Column:
    """The column (c is x) or row (y) of a grid for a place, the nearest one for places outside."""
    k = F.floor((at - F.col(f"_{c}0")) / F.col(f"_{c}s"))
    return F.coalesce(F.greatest(F.least(k, F.col(f"_{c}n") - 1), F.lit(0)), F.lit(0))  # a side of no length has one cell


def edge_of(k: Column, c: str) -> Column:
    return F.when(k == 0, F.col(f"_{c}0")).when(k == F.col(f"_{c}n"), F.col(f"_{c}1")).otherwise(F.col(f"_{c}0") + k * F.col(f"_{c}s"))


def in_cells(rects: DataFrame, keys: list[str], grid: DataFrame, p: str = "") -> DataFrame:
    """rects with the columns of their grid and one row for each cell (_i, _j) that they reach into."""
    placed = rects.join(grid, keys)
    for c, name in (("x", "_i"), ("y", "_j")):
        placed = placed.withColumn(name, F.explode(F.sequence(cell_of(F.col(f"{p}{c}0"), c), cell_of(F.col(f"{p}{c}1"), c))))
    return placed


def in_strips(rects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area, one row for each piece that a rectangle adds: neighbouring distinct x-edges bound strips, and inside
    a strip the y-intervals are merged with a running maximum."""
    edges = rects.select(*keys, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*keys).orderBy("left"))).where("right is not null")
    inside = strips.join(rects, keys).where("x0 <= left and x1 > left")
    before = Window.partitionBy(*keys, "left", "right").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    merged = inside.withColumn("reach", F.max("y1").over(before))
    new = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce("reach", "y0")), F.lit(0.0))
    return merged.select(*keys, ((F.col("right") - F.col("left")) * new).alias("area"))


def union_area(rects: DataFrame, *keys: str) -> DataFrame:
    """keys, area: the exact area covered by the rectangles (x0, y0, x1, y1) of each key.

    Rectangles are cut by a grid. A cell that one of them fills counts whole, and nothing else there is
    looked at; so where many overlap, little is left. The pieces in the other cells are merged in strips,
    each cell by itself. All of it is windows and joins by cell, so a large group spills instead of
    filling a task's memory.
    """
    rects = rects.where("x1 > x0 and y1 > y0").select(*keys, "x0", "y0", "x1", "y1")
    cell = [*keys, "_i", "_j"]
    placed = in_cells(rects, list(keys), grid_of(rects, list(keys)))
    sides, fills, size = {}, F.lit(True), F.lit(1.0)
    for c, name in (("x", "_i"), ("y", "_j")):
        low, high = edge_of(F.col(name), c), edge_of(F.col(name) + 1, c)
        at = {k: cell_of(F.col(f"{c}{k}"), c) for k in "01"}
        sides[f"{c}0"], sides[f"{c}1"] = F.when(F.col(name) > at["0"], low).otherwise(F.col(f"{c}0")), F.when(F.col(name) < at["1"], high).otherwise(F.col(f"{c}1"))
        fills = fills & ((F.col(name) > at["0"]) | (F.col(f"{c}0") <= low)) & ((F.col(name) < at["1"]) | (F.col(f"{c}1") >= high))
        size = size * (high - low)
    pieces = placed.select(*cell, *[v.alias(k) for k, v in sides.items()], fills.alias("_fills"), size.alias("area"))
    whole = pieces.where("_fills").groupBy(*cell).agg(F.first("area").alias("area"))
    rest = pieces.where("not _fills and x1 > x0 and y1 > y0").select(*cell, *sides).join(whole, cell, "left_anti")
    return whole.select(*keys, "area").unionByName(in_strips(rest, cell).select(*keys, "area")).groupBy(*keys).agg(F.sum("area").alias("area"))


def displayed(width: Column, height: Column, turn: Column) -> list[Column]:
    """x0, y0, x1, y1 of an unturned box as a page of the displayed size, turned by 0, 90, 180 or 270 degrees, shows it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    turned = {90: (width - y1, x0, width - y0, x1), 180: (width - x1, height - y1, width - x0, height - y0), 270: (y0, height - x1, y1, height - x0)}
    return [F.coalesce(*[F.when(turn == k, v[i]) for k, v in turned.items()], c) for i, c in enumerate((x0, y0, x1, y1))]


#: A task holds so many rectangles at once, looks at groups of so many or more, and takes so many of a
#: group, the largest first, to cover others. They bound memory and time; rectangles that are left stay in the union.
HELD, LEAST, ROUNDS = 100_000, 16, 200


def outer(sides: np.ndarray) -> np.ndarray:
    """The places of rectangles (x0, y0, x1, y1) that together cover what all of them cover."""
    left = np.argsort((sides[:, 0] - sides[:, 2]) * (sides[:, 3] - sides[:, 1]), kind="stable")
    kept = []
    while len(left) and len(kept) < ROUNDS:
        kept.append(left[:1])
        x0, y0, x1, y1 = sides[left[0]]
        rest = sides[left := left[1:]]
        left = left[(rest[:, 0] < x0) | (rest[:, 1] < y0) | (rest[:, 2] > x1) | (rest[:, 3] > y1)]
    return np.concatenate([*kept, left])


def without_covered(rects: DataFrame, key: str) -> DataFrame:
    """rects (key, x0, y0, x1, y1) without those that another one of the key covers whole, as far as one task sees both.

    The union stays the same, and where many overlap, little is left to be shuffled. A rectangle with a side
    that is no finite number stays.
    """
    columns = [key, "x0", "y0", "x1", "y1"]
    rects = rects.select(columns)

    def pruned(table: pa.Table) -> pa.Table:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        sides = np.stack([table[c].cast(pa.float64()).to_numpy() for c in columns[1:]], 1)
        usable = np.isfinite(sides).all(1)
        kept = [np.flatnonzero(~usable)]
        order = np.flatnonzero(usable)
        order = order[np.argsort(codes[order], kind="stable")]
        sizes = np.bincount(codes[order])
        small = sizes[codes[order]] < LEAST
        kept.append(order[small])
        for group in np.split(order[~small], np.cumsum(sizes[sizes >= LEAST])[:-1]):
            kept.append(group[outer(sides[group])])
        return table.take(pa.array(np.sort(np.concatenate(kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= HELD:
                held = [pruned(pa.concat_tables(held))]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from pruned(pa.concat_tables(held)).to_batches()

    return rects.mapInArrow(run, rects.schema)


def raster_coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """page, ratio: the share of each page (page, width, height, turn) that its images (page, x0 .. y1) cover together.

    Boxes are turned and cut to the page before their union, so overlaps count once; those within another
    one that the same task reads go first. A page without area,
    or with a box that is no finite rectangle, has no ratio.
    """
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    placed = without_covered(images, "page").join(pages, "page")
    whole = usable("x0") & usable("y0") & usable("x1") & usable("y1")
    bad = placed.where(~whole).select("page").distinct().withColumn("_bad", F.lit(True))
    x0, y0, x1, y1 = displayed(F.col("width"), F.col("height"), F.col("turn"))
    zero = F.lit(0.0)
    cut = placed.where(whole).select("page", F.greatest(x0, zero).alias("x0"), F.greatest(y0, zero).alias("y0"), F.least(x1, F.col("width")).alias("x1"), F.least(y1, F.col("height")).alias("y1"))
    covered = union_area(cut, "page")
    out = pages.join(covered, "page", "left").join(bad, "page", "left")
    share = F.round(F.least(F.lit(1.0), F.coalesce("area", zero) / (F.col("width") * F.col("height"))), 6)
    good = F.col("_bad").isNull() & usable("width") & usable("height") & (F.col("width") * F.col("height") > 0)
    return out.select("page", F.when(good, share).alias("ratio"))
