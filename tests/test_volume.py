"""What queries write on the way: the bytes of their shuffles against those of their tables, beside brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.functions import geometry as geo
from quillstack.operators import gates, glossary, joins


def moved(spark, rows):
    """The rows, and the bytes that the run wrote to shuffles and spilled."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    out = rows().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = [s for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in before]
    return out, sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in after)


def test_render_gate_moves_no_text_for_each_letter(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    pages = [(d, p, text(3000), 1.0, 595.28, 841.89) for d in range(4) for p in range(10)] + [(9, 0, None, 1.0, 595.28, 841.89)]
    held = {d: [p[2] for p in pages if p[0] == d] for d in (*range(4), 9)}
    texts = [(d, f"{d}.{k}", rng.choice([t[s : s + n], t[s : s + 4] + "z", t[s : s + 8] + "z", text(n)])) for d in range(4) for k, t in enumerate(held[d] * 5) for s, n in [(rng.randrange(2900), rng.choice([1, 7, 8, 9, 40]))]]
    texts += [(9, "none", "a"), (9, "null", None), (7, "gone", ""), (0, "empty", " ")]
    groups = spark.createDataFrame(texts, "document int, group_id string, text string")
    shown = spark.createDataFrame(pages, "document int, page int, text string, ink double, width double, height double")
    found, written = moved(spark, lambda: gates.render_gate(shown, groups).where("check = 'group_present'"))
    want = sorted(g for d, g, t in texts if t is None or not any(t.strip() in p for p in held.get(d, []) if p is not None))
    assert sorted(r.subject for r in found) == want and len(want) > 20
    assert written < 20 * sum(len(p[2] or "") for p in pages)


def test_render_gate_slices(spark, monkeypatch):
    """Heads of a document come in slices, with the same rows."""
    monkeypatch.setattr(gates, "HEADS", 3)
    texts = spark.createDataFrame([(1, f"word number {k}") for k in range(60)] + [(1, "w"), (1, "q")], "document int, _t string")
    shown = spark.createDataFrame([(1, " ".join(f"word number {k}," for k in range(0, 60, 2)))], "document int, _p string")
    want = {f"word number {k}" for k in range(60) if any(str(e).startswith(str(k)) for e in range(0, 60, 2))} | {"w"}
    assert {r._t for r in gates.on_pages(texts, shown).collect()} == want


def boxes(n, seed=3):
    """Rectangles of which many overlap, some equal, some that touch, and a few as large as the page."""
    rng = random.Random(seed)
    side = lambda most: sorted(min(max(int(rng.gauss(0, most / 4)), -most), most) for _ in range(2))
    made = [(x[0], y[0], x[1], y[1]) for x, y in ((side(60), side(40)) for _ in range(n))]
    made += made[:5] + [(0, 0, 5, 5), (5, 0, 9, 5), (0, 5, 5, 9), (-60, 0, 60, 1), (3, 3, 3, 9)]
    return [tuple(map(float, r)) for r in made]


RECTS = "g int, id int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def shuffled(spark):
    """Joins without broadcasts, as of large tables."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.65, 1.0])
def test_overlapping_moves_no_pairs(spark, shuffled, share):
    rows = {g: list(enumerate(boxes(n, g))) for g, n in ((1, 600), (2, 1))}
    df = spark.createDataFrame([(g, i, *r) for g, rs in rows.items() for i, r in rs], RECTS)
    a, b = (df.select("g", *[F.col(c).alias(f"{p}_{c}") for c in df.columns[1:]]) for p in "ab")
    pairs = joins.overlapping(a, b, "g", share)
    got, written = moved(spark, lambda: pairs.groupBy("g").agg(F.count(F.lit(1)), F.sum("shared"), F.sum(F.xxhash64("a_id", "b_id").bitwiseAND(1023))))
    cut = lambda p, q: max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
    want = {g: [s for _, p in rs for _, q in rs if (s := cut(p, q)) > 0 and s >= share * ((q[2] - q[0]) * (q[3] - q[1]))] for g, rs in rows.items()}
    assert {r[0]: (r[1], r[2]) for r in got} == {g: (len(s), sum(s)) for g, s in want.items()}
    assert pairs.select("g", "a_id", "b_id").distinct().count() == sum(map(len, want.values()))
    assert written < 1_000_000


def test_union_area_shapes(spark):
    rows = {1: boxes(500, 1), 2: boxes(40, 2), 3: [(0.0, 0.0, 1.0, 1.0)], 4: [(float(k), 0.0, k + 0.5, 1.0) for k in range(300)], 5: [(0.0, 0.0, 90.0, 90.0)] + [(200.0 + k, 0.0, 201.0 + k, 1.0) for k in range(100)]}
    df = spark.createDataFrame([(g, i, *r) for g, rs in rows.items() for i, r in enumerate(rs)] + [(6, 0, 1.0, 1.0, 1.0, 2.0), (7, 0, None, 0.0, 1.0, 1.0)], RECTS)
    want = {g: len({(x, y) for r in set(rs) for x in range(2 * int(r[0]), int(2 * r[2])) for y in range(int(r[1]), int(r[3]))}) / 2 for g, rs in rows.items()}
    assert {r.g: round(r.area, 9) for r in geo.union_area(df, "g").collect()} == want


def scattered(n, seed):
    """Rectangles of no common edges, and the area of their union by a raster of all edges."""
    gauss = np.random.default_rng(seed).normal(0, 0.125, (n, 4))
    x, y = np.sort(gauss[:, :2]), np.sort(gauss[:, 2:])
    xs, ys = np.unique(x), np.unique(y)
    held = np.zeros((len(xs), len(ys)), bool)
    for (a, b), (c, d) in zip(np.searchsorted(xs, x), np.searchsorted(ys, y), strict=True):
        held[a:b, c:d] = True
    area = (np.outer(np.diff(xs), np.diff(ys)) * held[:-1, :-1]).sum()
    return [(1, i, *map(float, (p[0], q[0], p[1], q[1]))) for i, (p, q) in enumerate(zip(x, y, strict=True))], area


def test_union_area_moves_no_strips(spark, shuffled):
    rows, area = scattered(1500, 7)
    got, written = moved(spark, lambda: geo.union_area(spark.createDataFrame(rows, RECTS), "g"))
    assert [round(r.area, 9) for r in got] == [round(area, 9)]
    assert written < 4_000_000


def test_raster_coverage_moves_no_strips(spark, shuffled):
    """A turned page that cuts most of its boxes."""
    rows, _ = scattered(1500, 8)
    images = spark.createDataFrame(rows, RECTS).withColumnRenamed("g", "page")
    pages = spark.createDataFrame([(1, 0.25, 0.2, 90), (2, 1.0, 1.0, 0)], "page int, width double, height double, turn int")
    got, written = moved(spark, lambda: geo.raster_coverage(pages, images))
    assert {r.page: r.ratio for r in got} == {1: 1.0, 2: 0.0}
    assert written < 2_000_000


def test_raster_coverage_moves_no_covered_boxes(spark, shuffled):
    """Boxes within others are dropped where they are read; odd ones, small pages and pages without a number stay."""
    rows, area = scattered(3000, 9)
    odd = [(2, 0, float("nan"), 0.0, 1.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 1.0), (3, 0, 0.0, 0.0, 0.5, 1.0), (3, 1, 0.0, 0.0, 0.25, 1.0), (None, 0, 0.0, 0.0, 1.0, 1.0), (5, 0, 0.0, 0.0, None, 1.0)]
    apart = [(4, k, float(k), 0.0, k + 0.5, 1.0) for k in range(400)]
    images = spark.createDataFrame(rows + odd + apart, RECTS).withColumnRenamed("g", "page").withColumns({"x0": F.expr("if(page = 1, x0 + 2, x0)"), "x1": F.expr("if(page = 1, x1 + 2, x1)"), "y0": F.expr("if(page = 1, y0 + 2, y0)"), "y1": F.expr("if(page = 1, y1 + 2, y1)")})
    pages = spark.createDataFrame([(1, 4.0, 4.0, 270), (2, 1.0, 1.0, 0), (3, 1.0, 1.0, 180), (4, 400.0, 1.0, 0), (5, 1.0, 1.0, 0), (6, 1.0, 1.0, 0)], "page int, width double, height double, turn int")
    got, written = moved(spark, lambda: geo.raster_coverage(pages, images))
    assert {r.page: r.ratio for r in got} == {1: round(area / 16, 6), 2: None, 3: 0.5, 4: 0.5, 5: None, 6: 0.0}
    assert written < 300_000


def test_outer_boxes_cover_the_same(monkeypatch):
    sides = np.array(boxes(400, 4) * 2)
    cells = lambda rs: {(x, y) for a, b, c, d in rs.astype(int) for x in range(a, c) for y in range(b, d)}
    within = lambda p, q: (p[:2] >= q[:2]).all() and (p[2:] <= q[2:]).all()
    kept = geo.outer(sides)
    assert cells(sides[kept]) == cells(sides) and not any(i != j and within(sides[i], sides[j]) for i in kept for j in kept)
    monkeypatch.setattr(geo, "ROUNDS", 2)
    assert cells(sides[geo.outer(sides)]) == cells(sides)


def test_glossary_join_moves_no_text(spark, shuffled):
    """A table above the size to be shared: words meet terms, and the text isn't sent with each of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeÉé") for _ in range(rng.randint(2, 5)))
    texts = [(k, " ".join(rng.choice([word(), word().upper(), word() + ".", word() + ","]) for _ in range(400))) for k in range(40)] + [(40, None), (41, ""), (0, "again abc.")]
    terms = [(t, k % 3 == 0, k % 2 == 0, ["x"]) for k, t in enumerate(sorted({word() for _ in range(300)} | {word() + "." for _ in range(60)} | {"abc ab", "a", ".", "\U0001d4b3"}))]
    edge = lambda t: (r"(?<!\w)" if t[0] != "." else "") + re.escape(t) + (r"(?!\w)" if t[-1] != "." else "")
    want = sorted((k, t) for k, text in texts if text for t, exact, *_ in terms if re.search(edge(t), text, 0 if exact else re.I))
    hits = glossary.table_hits(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(terms, "source string, case_sensitive boolean, enforce boolean, targets array<string>"), "id", "t", 0)
    got, written = moved(spark, lambda: hits)
    assert sorted((r.id, r.term) for r in got) == want and len(want) > 200
    assert written < 12 * sum(len(t or "") for _, t in texts)


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("again", [[], [(3, "abba again"), (3, "ab abba")]])
def test_glossary_lacking_moves_no_text(spark, shuffled, most, again):
    """Texts are judged where they are read; repeated ids and large tables give the same rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.randint(2, 5)))
    texts = [(k, " ".join(rng.choice([word(), word().upper(), word() + "."]) for _ in range(1000))) for k in range(40)] + [(40, None), (41, ""), *again]
    terms = [(t, k % 3 == 0, k % 2 == 0, [t[::-1], None] if k % 5 else []) for k, t in enumerate(sorted({word() for _ in range(300)} | {"abba", "ab ba"}))]
    found = {(k, t) for k, text in texts if text for t, exact, enforce, _ in terms if enforce and re.search(rf"(?<!\w){t}(?!\w)", text, 0 if exact else re.I)}
    targets = {t[0]: [x for x in t[3] if x] for t in terms}
    want = sorted((k, t) for k, t in found for i, text in texts if i == k and not any(x in (text or "") for x in targets[t]))
    table = spark.createDataFrame(terms, "source string, case_sensitive boolean, enforce boolean, targets array<string>")
    got, written = moved(spark, lambda: glossary.lacking(spark.createDataFrame(texts, "id int, t string"), table, "id", "t", most))
    assert sorted((r.id, r.term) for r in got) == want and len(want) > 200
    assert written < (100_000 if most and not again else 10_000_000)
