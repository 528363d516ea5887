"""Captions, drawings and rows of a page, on small literal pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import layout


def test_captions_and_drawings(spark):
    captions = spark.createDataFrame(
        [(1, "c1", 50.0, 400.0, 250.0, 410.0, "Figure 1: left"), (1, "c2", 350.0, 405.0, 550.0, 415.0, "Figure 2: right."), (1, "c3", 50.0, 700.0, 250.0, 710.0, "Figure 3")],
        "page int, id string, x0 double, y0 double, x1 double, y1 double, source string",
    )
    placed = layout.caption_columns(captions, "page", 600.0).cache()
    assert {r.id: (r.cluster, r.column_left, r.column_right) for r in placed.collect()} == {"c1": (1, 36.0, 300.0), "c2": (1, 300.0, 564.0), "c3": (2, 36.0, 564.0)}
    blocks = spark.createDataFrame([(1, "b1", "prose", "goes on", 60.0, 420.0, 240.0, 430.0), (1, "b2", "prose", "other", 360.0, 420.0, 500.0, 430.0), (1, "b3", "prose", "x" * 200, 60.0, 420.0, 240.0, 430.0)], "page int, id string, kind string, source string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in layout.continuations(placed, blocks, "page").collect()] == [("c1", "b1")]
    drawings = spark.createDataFrame([(1, *b) for b in ((60.0, 300.0, 100.0, 390.0), (105.0, 300.0, 200.0, 380.0), (60.0, 100.0, 90.0, 120.0), (400.0, 395.0, 402.0, 399.0), (60.0, 10.0, 61.0, 11.0))], "page int, x0 double, y0 double, x1 double, y1 double")
    near = layout.drawings_above(placed, drawings, "page")
    found = {r.caption: (r.x0, r.y0, r.x1, r.y1, r.resolved) for r in layout.visuals(placed, near).collect()}
    assert found["c1"] == (56.0, 296.0, 204.0, 394.0, True)
    assert found["c2"] == (None, None, None, None, False) and set(found) == {"c1", "c2", "c3"}
    assert near.columns == ["caption", "_top", "column_left", "column_right", "x0", "y0", "x1", "y1"]


def test_rows_and_lists(spark):
    lines = spark.createDataFrame([("b", k, 0.0, y0, 9.0, y1) for k, (y0, y1) in enumerate([(0.0, 10.0), (1.0, 11.0), (2.0, 12.0), (20.0, 30.0), (0.5, 25.0)])], "block string, line int, x0 double, y0 double, x1 double, y1 double")
    assert [r.row for r in layout.physical_rows(lines, "block").orderBy("line").collect()] == [0, 0, 2, 3, 1]
    texts = spark.createDataFrame([("3, 1-2,,2",)], "s string")
    assert texts.select(layout.page_list(F.col("s"))).first()[0] == [1, 2, 3]
    roles = layout.expected_roles(spark.createDataFrame([("a=2",), ("b",)], "s string"), "s").collect()
    assert [tuple(r) for r in roles] == [("a", 2), (None, None)]
