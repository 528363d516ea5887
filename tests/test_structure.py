"""Lineage, glossary tables, adapters and the gate on finished files: one mutation for each fault."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstack.operators import binding, coverage
from quillstack.operators import docx_gate as dx
from quillstack.operators import gates, glossary, lineage
from quillstack.sources import adapters

# -- lineage -----------------------------------------------------------------------------------------

EDGE, ARTIFACT = "work int, artifact string, source string, sha256 string", "work int, artifact string, sha256 string"


def stale(spark, edges, now, rounds=5):
    made = lineage.stale_closure(spark.createDataFrame(edges, EDGE), spark.createDataFrame(now, ARTIFACT), rounds)
    return {(r.work, r.artifact): (r.problem, r.sources) for r in made.collect()}


def test_lineage(spark):
    edges = [(1, "ir", "source", "s"), (1, "plan", "ir", "i"), (1, "out", "plan", "p"), (1, "out", "profile", "f"), (1, "side", "profile", "f"), (2, "ir", "source", "s")]
    now = [(w, a, h) for w in (1, 2) for a, h in (("source", "s"), ("ir", "i"), ("plan", "p"), ("out", "o"), ("profile", "f"), ("side", "x"))]
    assert stale(spark, edges, now) == {}
    # a changed source makes every later stage stale, of its own work alone
    changed = [(1, "source", "new") if r[:2] == (1, "source") else r for r in now]
    assert stale(spark, edges, changed) == {(1, "ir"): ("own", 1), (1, "plan"): ("inherited", 1), (1, "out"): ("inherited", 1)}
    gone = [r for r in now if r[:2] != (1, "profile")]
    assert stale(spark, edges, gone) == {(1, "out"): ("own", 1), (1, "side"): ("own", 1)}
    unpinned = [(*r[:3], None) if r[1] == "plan" else r for r in edges]
    assert stale(spark, unpinned, now) == {(1, "plan"): ("own", 1), (1, "out"): ("inherited", 1)}
    unhashed = [(*r[:2], None) if r[:2] == (1, "ir") else r for r in now]
    assert stale(spark, edges, unhashed) == {(1, "plan"): ("own", 1), (1, "out"): ("inherited", 1)}
    both = stale(spark, unpinned, changed)
    assert both[1, "out"] == ("inherited", 2) and both[1, "plan"] == ("own", 2)


def test_lineage_shapes(spark):
    ring = [(1, "a", "b", "h"), (1, "b", "c", "h"), (1, "c", "a", "h"), (1, "d", "a", "h")]
    now = [(1, x, "h") for x in "abcd"]
    assert {k[1]: v[0] for k, v in stale(spark, ring, now).items()} == {"a": "cycle", "b": "cycle", "c": "cycle"}
    chain = [(1, f"n{k}", f"n{k + 1}", "h") for k in range(40)]
    there = [(1, f"n{k}", "h") for k in range(41)]
    assert {v[0] for v in stale(spark, chain, there, 3).values()} == {"deep"}
    assert stale(spark, chain, there, 6) == {}
    assert stale(spark, [], []) == {}


def test_next_stage(spark):
    statuses = spark.createDataFrame([(1, "a", "passed"), (1, "b", "passed"), (2, "a", "manual_review_required"), (3, "a", "passed"), (3, "b", "passed"), (4, "b", "passed")], "work int, gate string, status string")
    old = spark.createDataFrame([(1, "b", "own")], "work int, artifact string, problem string")
    assert {r.work: r.action for r in lineage.next_stage(["a", "b"], statuses, old).collect()} == {1: "run b", 2: "review a", 3: "complete", 4: "run a"}


# -- glossaries --------------------------------------------------------------------------------------

TERM = "source string, case_sensitive boolean, enforce boolean, targets array<string>"


@pytest.mark.parametrize("most", [0, 1000])
def test_glossary_table(spark, most):
    """Both ways agree with one pattern for each term."""
    rng = random.Random(23)
    signs = ["a", "b", "A", "é", "É", "_", "7", " ", "-", "+", ".", "漢", "("]
    word = lambda n: "".join(rng.choice(signs) for _ in range(n))
    terms = [(t, rng.random() < 0.4, rng.random() < 0.5, ["x"]) for t in {word(rng.randint(1, 4)).strip() for _ in range(120)} if t]
    terms += [("", False, True, ["x"]), (None, False, True, ["x"])]
    texts = [(k, word(rng.randint(0, 40))) for k in range(60)] + [(99, None)]
    wordy = lambda c: c.isalnum() or c == "_"
    want = set()
    for t, exact, enforce, _ in terms:
        if not t:
            continue
        pattern = (r"(?<!\w)" if wordy(t[0]) else "") + re.escape(t) + (r"(?!\w)" if wordy(t[-1]) else "")
        want |= {(k, t, enforce) for k, text in texts if text and re.search(pattern, text, 0 if exact else re.I)}
    found = glossary.table_hits(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(terms, TERM), "id", "t", most).collect()
    assert {(r.id, r.term, r.enforce) for r in found} == want and len(found) == len(want) and want


def test_glossary_edges(spark):
    none = spark.createDataFrame([], TERM)
    texts = spark.createDataFrame([(1, "the Cell cell"), (1, "cell")], "id int, t string")
    for most in (0, 10):
        assert glossary.table_hits(texts, none, "id", "t", most).collect() == []
        twice = spark.createDataFrame([("cell", None, True, None), ("cell", None, True, ["z"])], TERM)
        hits = glossary.table_hits(texts, twice, "id", "t", most)
        assert hits.count() == 4
        output = lambda value: spark.createDataFrame([(1, value)], "id int, o string")  # noqa: B023, E731
        assert glossary.violations(hits, output("z"), "id", "o").count() == 2
        assert glossary.violations(hits, output(None), "id", "o").count() == glossary.violations(hits, output("z").limit(0), "id", "o").count() == 4


# -- adapters ----------------------------------------------------------------------------------------


def test_registry():
    assert adapters.adapter_for("page-text", "source").suffix == ".txt"
    for args in (("nothing",), (None,), ("page-text", "import"), ("content-list", "source")):
        with pytest.raises(ValueError):
            adapters.adapter_for(*args)
    with pytest.raises(ValueError, match="registered"):
        adapters.offer(adapters.ADAPTERS["page-text"])
    assert [adapters.safe_name(p) for p in ("a/b.txt", "/a", "a/../b", "a\\b", "", None, "C:x", "a//b")] == [True] + [False] * 7


def test_plain_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_text("p1\fp2\f \n")
    (tmp_path / "two.txt").write_text("only")
    (tmp_path / "no.md").write_text("other")
    (tmp_path / "two_content_list.json").write_text(json.dumps([{"page_idx": 0, "type": "text", "text": "t"}, {"page_idx": 1, "type": "image"}]))
    rows = adapters.read_pages(spark, str(tmp_path), "page-text")
    assert sorted(map(tuple, rows.collect())) == [("one", 1, 0, "page", "p1"), ("one", 2, 0, "page", "p2"), ("two", 1, 0, "page", "only")]
    assert sorted(map(tuple, adapters.read_pages(spark, str(tmp_path), "content-list", "import").collect())) == [("two", 1, 0, "text", "t"), ("two", 2, 1, "image", "")]
    with pytest.raises(Exception, match="unknown adapter"):
        spark.read.format("quill-pages").option("adapter", "pdf").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no operation"):
        spark.read.format("quill-pages").option("adapter", "page-text").option("operation", "import").load(str(tmp_path)).collect()
    (tmp_path / "bad_content_list.json").write_text('[{"page_idx": 0, "page_idx": 1}]')
    with pytest.raises(Exception, match="repeated key"):
        adapters.read_pages(spark, str(tmp_path), "content-list").collect()
    # a filter on the document leaves the bad file unopened
    assert adapters.read_pages(spark, str(tmp_path), "content-list").where("document = 'two' and page > 1").count() == 1


def test_pruning():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = adapters.PageReader("/nowhere", adapters.ADAPTERS["page-text"], 10)
    left = GreaterThan(("page",), 1)
    assert list(reader.pushFilters([EqualTo(("document",), "a"), left, In(("document",), ("a", "b"))])) == [left]
    assert [reader.document(n) for n in ("a.txt", "b.txt", "a.md", "_a.txt")] == ["a", None, None, None]


def test_committed_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    files = spark.createDataFrame([(f"d{k}.txt", f"page {k}\fnext".encode()) for k in range(20)] + [("sub/x.bin", None)], "path string, content binary").repartition(4)
    adapters.write_files(files, folder)
    rows = adapters.read_pages(spark, folder, "page-text")
    assert rows.count() == 40 and rows.where("document in ('d3', 'd4')").count() == 4
    with pytest.raises(Exception, match="written already"):
        adapters.write_files(files, folder)
    with pytest.raises(ValueError, match="more than once"):
        adapters.write_files(files.unionByName(files), str(tmp_path / "twice"))
    # a task that fails leaves no commit, and nothing that a reader takes
    bad = files.unionByName(spark.createDataFrame([("../up.txt", b"x")], "path string, content binary"))
    with pytest.raises(Exception, match="unsafe path"):
        adapters.write_files(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / adapters.COMMITTED).exists()
    # files that no commit lists are not read, and changed ones are refused
    (tmp_path / "out" / "stray.txt").write_text("stray")
    assert adapters.read_pages(spark, folder, "page-text").count() == 40
    part = next(p for p in (tmp_path / "out").glob("part-*/0000000"))
    part.write_bytes(part.read_bytes() + b"!")
    with pytest.raises(Exception, match="changed since the commit"):
        adapters.read_pages(spark, folder, "page-text").collect()
    adapters.write_files(files.limit(1), folder, overwrite=True)
    assert adapters.read_pages(spark, folder, "page-text").count() in (0, 2)


# -- finished files ----------------------------------------------------------------------------------

RED, BLUE = "D97706", "2563EB"


def framed(start, colour, *texts):
    """Paragraphs of one frame: texts, with None for the divider."""
    out = []
    for k, t in enumerate(texts):
        top = colour if k == 0 or t is None else ""
        out.append([1, start + k, t or "", colour, colour, top, "8" if t is None else "12", colour if k == len(texts) - 1 else "", "1", "1"])
    return [tuple(r) for r in out]


def files(**changes):
    made = {
        "paragraphs": framed(0, RED, "Problem one", "first step", None, "问题 一") + framed(10, RED, "Problem two", None, "问题 二") + framed(20, BLUE, "A tip", None, "提示") + [(1, 30, "Plain remark", "", "", "", "", "", "1", "1"), (1, 31, "Only once", "", "", "", "", "", "1", "1")],
        "nodes": [(1, "p1", "problem", "bilingual", "paragraph", "Problem one"), (1, "s1", "step", "bilingual", "paragraph", "first   step"), (1, "p2", "problem", "bilingual", "paragraph", "Problem two"), (1, "t1", "tip", "bilingual", "paragraph", "A tip"), (1, "r1", "remark", "bilingual", "paragraph", "Plain remark"), (1, "o1", "figure", "source-only", "paragraph", "Only once"), (1, "v1", "figure", "visual-once", "image", "")],
        "groups": [(1, "g1", "problem", "complete", "p1", ["p1", "s1"]), (1, "g2", "problem", "anchor-only", "p2", ["p2"]), (1, "g3", "tip", "anchor-only", "t1", ["t1"]), (1, "g4", "remark", "anchor-only", "r1", ["r1"]), (1, "g5", "figure", "anchor-only", "v1", ["v1"])],
        "roles": [("problem", dx.CONTAINER, RED), ("tip", dx.CONTAINER, BLUE), ("remark", "flow", None), ("figure", "flow", None), ("step", "flow", None)],
        "bodies": [(1, "Problem one first step 问题 一 Problem two 问题 二 A tip 提示 Plain remark Only once", ["u2", "u1"], 1, 0)],
        "builds": [(1, ["u1", "u2"], 1, 0)],
        "expected": [(1, "problem", 2)],
    }
    return made | {k: f(made[k]) for k, f in changes.items()}


KINDS = {
    "paragraphs": "document int, place int, text string, left string, right string, top string, top_size string, bottom string, indent_left string, indent_right string",
    "nodes": "document int, id string, role string, output string, type string, source string",
    "groups": "document int, group_id string, role string, membership string, anchor string, members array<string>",
    "roles": "role string, grouping string, colour string",
    "bodies": "document int, text string, links array<string>, images int, tables int",
    "builds": "document int, links array<string>, assets int, tables int",
    "expected": "document int, role string, count int",
}


def with_(at, column, value):
    return lambda rows: [tuple(value if (i, c) == (at, column) else v for c, v in enumerate(r)) for i, r in enumerate(rows)]


def without(at):
    return lambda rows: [r for i, r in enumerate(rows) if i != at]


BODY = files()["bodies"][0][1]


#: One change to the tables of a sound file, and the faults it must give. Each case is a document of its own.
CASES = [
    ({}, set()),
    ({"expected": with_(0, 2, 3)}, {("role_inventory", "problem")}),
    ({"bodies": with_(0, 1, BODY.replace("Plain remark", ""))}, {("occurrence_evidenced", "remark")}),
    ({"bodies": with_(0, 1, BODY + " Only once")}, {("source_only_once", "o1")}),
    ({"bodies": with_(0, 1, BODY + " V23-CALLOUT-END|x")}, {("internal_marks", "1")}),
    ({"bodies": with_(0, 1, re.sub("[一-鿿]", "", BODY))}, {("target_language", "1")}),
    ({"bodies": with_(0, 2, ["u1"])}, {("links", "1")}),
    ({"bodies": with_(0, 3, 0)}, {("pictures", "1")}),
    ({"bodies": with_(0, 4, 1)}, {("tables", "1")}),
    ({"builds": without(0)}, {("links", "1"), ("pictures", "1"), ("tables", "1")}),
    ({"paragraphs": with_(1, 8, "2")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(2, 6, "12")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(2, 2, "no divider")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(0, 5, "")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(3, 2, "english")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(1, 2, "other step")}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"groups": with_(0, 5, ["s1", "p1"])}, {("complete_container", "g1"), ("frame_unaccounted", "0")}),
    ({"paragraphs": with_(4, 2, "Problem two and more")}, {("scoped_anchor", "g2"), ("frame_unaccounted", "10")}),
    ({"groups": with_(1, 5, ["p2", "s1"])}, {("scoped_anchor", "g2"), ("frame_unaccounted", "10")}),
    ({"paragraphs": with_(7, 2, "Problem two")}, {("scoped_anchor", "g2"), ("scoped_anchor", "g3"), ("frame_unaccounted", "10"), ("frame_unaccounted", "20")}),
    ({"groups": without(2)}, {("frame_unaccounted", "20")}),
    ({"paragraphs": with_(8, 2, "Plain remark")}, {("scoped_anchor", "g3"), ("boxed", "g4"), ("frame_unaccounted", "20")}),
]


def test_docx_gate(spark):
    tables = {k: [] for k in KINDS}
    for number, (changes, _) in enumerate(CASES):
        made = files(**changes)
        for name, rows in made.items():
            tables[name] += rows if name == "roles" and not number else [] if name == "roles" else [(number, *r[1:]) for r in rows]
    made = {k: spark.createDataFrame(rows, KINDS[k]) for k, rows in tables.items()}
    found = dx.docx_gate(**made)
    by_case = {n: set() for n in range(len(CASES))}
    for r in found.collect():
        # the document itself stands as 1 in the cases
        by_case[r.document].add((r.check, "1" if r.subject == str(r.document) and r.check not in ("frame_unaccounted",) else r.subject))
    for number, (changes, faults) in enumerate(CASES):
        assert by_case[number] == faults, (number, list(changes))
    status = {r.document: r.status for r in gates.document_status(found, made["bodies"]).collect()}
    assert status == {n: "failed" if faults else "passed" for n, (_, faults) in enumerate(CASES)}


def test_role_of_another_colour(spark):
    made = {k: spark.createDataFrame(rows, KINDS[k]) for k, rows in files(roles=with_(1, 2, RED)).items()}
    # a blue frame is none of this profile's, so the tip has none
    assert {(r.check, r.subject) for r in dx.docx_gate(**made).collect()} == {("scoped_anchor", "g3")}


def test_frames(spark):
    """A lower edge ends a frame, but not at its first paragraph."""
    rows = [(1, k, "t", c, c, "", "", c if b else "", "1", "1") for k, (c, b) in enumerate([("R", 0), ("R", 1), ("R", 1), ("R", 1), ("R", 1), ("R", 0), ("B", 1), ("B", 1), ("B", 0), ("", 0), ("B", 0)])]
    paragraphs = spark.createDataFrame(rows, KINDS["paragraphs"])
    assert [(r.place, r.frame) for r in dx.frames(paragraphs).orderBy("place").collect()] == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (10, 10)]
    assert {r.frame for r in dx.frames(paragraphs, ["B"]).collect()} == {6, 8, 10}


def test_forms(spark):
    row = spark.createDataFrame([("- a\n* b", "list", "<td>x &lt; y</td>", "table")], "l string, lk string, t string, tk string")
    got = row.select(dx.searched(F.col("l"), F.col("lk")).alias("l"), dx.searched(F.col("t"), F.col("tk")).alias("t"), dx.searched(F.lit(None).cast("string"), F.lit("x")).alias("n")).first()
    assert got.l == ["- a * b", "a b", "• a • b"] and got.t == ["<td>x &lt; y</td>", "x < y"] and got.n == []


V1 = KINDS["paragraphs"] + ", numbered boolean, first_line string, hanging string, rule boolean"


FIRST_VERSION = [
    (lambda r: r, "Problem (a1) x 题 Problem (b2) y", set()),
    (lambda r: r, "Problem (a1) x 题 Problem (a1) y", {"problem_ids_unique"}),
    (lambda r: r, "Problem (a1) x 题", {"problem_frames"}),
    (lambda r: [(*x[:8], str(k), *x[9:]) for k, x in enumerate(r)], "Problem (a1) x 题 Problem (b2) y", {"problem_borders"}),
    (lambda r: [(*x[:10], True, None, None, False) for x in r], "Problem (a1) x 题 Problem (b2) y", {"problem_borders"}),
    (lambda r: [(*x[:10], True, "0", None, False) for x in r], "Problem (a1) x 题 Problem (b2) y", set()),
    (lambda r: [(*x[:13], True) for x in r], "Problem (a1) x 题 Problem (b2) y", {"problem_borders"}),
    (lambda r: r, "Problem (a1) V2-PROBLEM-CALLOUT Problem (b2) y", {"internal_marks", "target_language"}),
]


def test_first_version_gate(spark):
    rows, bodies = [], []
    for number, (edit, text, _) in enumerate(FIRST_VERSION):
        plain = [(*r, False, None, None, False) for r in framed(0, RED, "Problem (a1)", None, "题") + framed(3, RED, "Problem (b2)", None, "题")]
        rows += [(number, *r[1:]) for r in edit(plain)]
        bodies.append((number, text, 2))
    found = dx.docx_gate_v1(spark.createDataFrame(rows, V1), spark.createDataFrame(bodies, "document int, text string, images int"), RED, r"Problem\s*\(([a-z0-9]+)\)", 2).collect()
    for number, (_, _, faults) in enumerate(FIRST_VERSION):
        assert {r.check for r in found if r.document == number} == faults, number


# -- bindings ----------------------------------------------------------------------------------------


def test_bindings(spark, tmp_path):
    profiles = binding.addressed(spark.createDataFrame([("{}",), ("[]",), ("{}",), (None,)], "j string"), "j")
    sha = {r.json: r.sha256 for r in profiles.collect()}
    a, b = sha["{}"], sha["[]"]
    assert len(sha) == 2
    bound = spark.createDataFrame([(1, a, 1), (2, a, 4), (3, a, 1), (4, a, 2), (9, b, 7)], "work int, sha256 string, version int")
    requests = [(1, a, None, False), (2, b, a, True), (3, b, a, False), (4, b, b, True), (5, b, None, None), (6, "zz", None, True), (7, a, None, True), (7, a, None, True)]
    judged = binding.verdicts(spark.createDataFrame(requests, "work int, sha256 string, expected string, force boolean"), bound, profiles)
    assert {r.work: r.verdict for r in judged.collect()} == {1: "same", 2: "rebound", 3: "refused", 4: "conflict", 5: "bound", 6: "unknown", 7: "repeated"}
    after = binding.settled(bound, judged)
    assert {tuple(r) for r in after.collect()} == {(1, a, 1), (2, b, 5), (3, a, 1), (4, a, 2), (5, b, 1), (9, b, 7)}
    artifacts = spark.createDataFrame([(2, "source"), (2, "ir"), (3, "ir")], "work int, artifact string")
    assert [tuple(r) for r in binding.invalidated(judged, artifacts, ["source"]).collect()] == [(2, "ir")]
    binding.commit(after, str(tmp_path / "b"), 2)
    with pytest.raises(Exception, match="(?i)exist"):
        binding.commit(bound, str(tmp_path / "b"), 2)


def test_migration(spark):
    manifests = spark.createDataFrame([(1, None, {"blocks": "b"}), (2, "y", None), (3, "x", {"profile": "old"}), (4, None, None)], "work int, profile_sha256 string, artifacts map<string,string>")
    bound = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "work int, sha256 string")
    moved, refused = binding.migration(manifests, bound)
    both = {"profile": "profile.json", "document_ir": "document-ir.json"}
    assert {r.work: (r.profile_sha256, r.artifacts) for r in moved.collect()} == {1: ("x", {"blocks": "b"} | both), 3: ("x", both)}
    assert {tuple(r) for r in refused.collect()} == {(2, "bound to another profile"), (4, "unbound")}
    assert {tuple(r) for r in binding.migration(manifests, bound, force=True)[1].collect()} == {(4, "unbound")}
    nodes = spark.createDataFrame([(1, "n1", "proof"), (1, "n2", None)], "document int, id string, role string")
    roles = spark.createDataFrame([("proof", "box", "bilingual", "structural-container")], "role string, style string, output string, grouping string")
    assert {r.id: (r.style, r.output, r.method) for r in binding.nodes_v2(nodes, roles).collect()} == {"n1": ("box", "bilingual", "profile-selector"), "n2": (None, "source-only", "unclassified")}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_coverage_both_ways(spark, monkeypatch, most):
    """A table of slots and a join of hashes find the same n-grams."""
    monkeypatch.setattr(coverage, "MOST_GRAMS", most)
    rng = random.Random(29)
    text = lambda n: " ".join(rng.choice(["a", "b", "ﬁ", "C", "d1"]) for _ in range(n))
    oracle, extracted = [(k, text(rng.randint(0, 20))) for k in range(8)] + [(9, None)], [(text(rng.randint(0, 60)),) for _ in range(12)] + [(None,)]
    tokens = lambda t: re.findall(r"[a-z_][a-z0-9_]*", (t or "").replace("ﬁ", "fi").lower())
    grams = lambda t: [tuple(tokens(t)[i : i + 3]) for i in range(len(tokens(t)) - 2)]
    there = {g for (t,) in extracted for g in grams(t)}
    found = coverage.coverage(spark.createDataFrame(oracle, "k int, t string"), spark.createDataFrame(extracted, "t string"), "k", "t", "t", size=3).collect()
    assert {r.k: (r.hits, r.total) for r in found} == {k: (sum(g in there for g in grams(t)), len(grams(t))) for k, t in oracle}


# -- small functions ---------------------------------------------------------------------------------


def test_small_functions(spark, tmp_path):
    from quillstack.functions import text as tx
    from quillstack.operators import classify
    from quillstack.sources import sinks
    from quillstack.sources import strict_json as sj

    assert sj.canonical({"b": [1, 2.5, None], "a": "é\n", "c": {"z": 1, "y": True}}) == '{"a":"é\\n","b":[1,2.5,null],"c":{"y":true,"z":1}}'
    with pytest.raises(ValueError):
        sj.canonical({"x": float("nan")})
    row = spark.createDataFrame([(3, 14, "a", "b")], "p int, i int, s string, t string")
    first, again, other = (row.select(tx.node_id(F.col("p"), F.col("i"), [F.col(c) for c in columns]).alias("x")).first().x for columns in (("s", "t"), ("s", "t"), ("t", "s")))
    assert first == again != other and re.fullmatch(r"mu-p0003-i0014-[0-9a-f]{24}", first)
    sinks.write_report(row.select("p", "s"), str(tmp_path / "report"))
    assert [json.loads(line) for f in (tmp_path / "report").glob("part-*") for line in f.read_text().splitlines()] == [{"p": 3, "s": "a"}]
    roles = spark.createDataFrame([("a", "box", "bilingual")], "role string, style string, output string")
    nodes = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, role string")
    assert {tuple(r) for r in classify.output_policy(nodes, roles).collect()} == {(1, "a", "box", "bilingual"), (2, "z", "plain", "source-only"), (3, None, "plain", "source-only")}
