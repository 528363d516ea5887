"""Quality gates: every check is a DataFrame of failure rows (gate, check, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import english_words, problem_ids
from .coverage import copy_ratio
from .inventory import status_of
from .joins import missing_and_extra, pinned, range_cover, responses
from .protect import placeholders_match, restore

FAILURE = "gate string, check string, subject string, message string"


def failures(rows: DataFrame, gate: str, check: str, subject: str | Column, message: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(gate).alias("gate"), F.lit(check).alias("check"), subject.cast("string").alias("subject"), message.alias("message"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate_status(found: DataFrame, gates: list[str]) -> DataFrame:
    """gate, failures, status for every named gate: a gate without failure rows has passed."""
    names = found.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    n = found.groupBy("gate").agg(F.count(F.lit(1)).alias("failures"))
    out = names.join(n, "gate", "left").na.fill(0, ["failures"])
    return out.withColumn("status", F.when(F.col("failures") > 0, "failed").otherwise("passed"))


def source_gate(blocks: DataFrame, links: DataFrame, visuals: DataFrame, pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """Blocks (id, page, source, source_sha256, links), links (id), visuals (id, anchor_id), pages (page),
    contact sheets (first_page, last_page)."""
    g = "source"
    repeated = blocks.groupBy("id").count().where("count > 1")
    stale = blocks.where(F.col("source").isNull() | ~F.sha2(F.col("source").cast("binary"), 256).eqNullSafe(F.col("source_sha256")))
    used = blocks.select("id", F.explode("links").alias("link"))
    unknown = used.join(links.select(F.col("id").alias("link")), "link", "left_anti")
    anchors = visuals.join(blocks.select(F.col("id").alias("anchor_id")), "anchor_id", "left_anti")
    twice = visuals.groupBy("anchor_id").count().where("count > 1")
    cover = range_cover(sheets, pages, "first_page", "last_page", "page")
    return together([
        failures(repeated, g, "unique_block_id", "id", "block id repeated"),
        failures(stale, g, "block_hash", "id", "source differs from its hash"),
        failures(unknown, g, "link_known", "id", F.concat(F.lit("unknown link "), F.col("link"))),
        failures(anchors, g, "visual_anchor", "id", "visual without its block"),
        failures(twice, g, "visual_once", "anchor_id", "more than one visual"),
        failures(cover, g, "page_cover", "page", F.concat(F.lit("covered "), F.col("covers").cast("string"), F.lit(" times"))),
    ])


def problem_gate(blocks: DataFrame, pages: DataFrame, document: str, ord_col: str) -> DataFrame:
    """Problem ids of the oracle pages and of the joined blocks, which may span two blocks, must agree."""
    joined = blocks.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, "source"))), lambda s: s["source"]), "\n").alias("text"))
    ours = joined.select(document, F.explode(problem_ids(F.col("text"))).alias("problem")).distinct()
    theirs = pages.select(document, F.explode(problem_ids(F.col("text"))).alias("problem")).distinct()
    gone, more = theirs.exceptAll(ours), ours.exceptAll(theirs)
    return failures(gone, "source", "problem_missing", "problem", "in the oracle only").unionByName(failures(more, "source", "problem_extra", "problem", "in the blocks only"))


def translation_gate(requests: DataFrame, answers: DataFrame, partial: bool = False, compatible: bool = False, target: str = "[㐀-䶿一-鿿豈-﫿]") -> DataFrame:
    """requests (id, source_sha256, source, spans, terms) against answers (id, source_sha256, translation).

    One failure row per fault: absent, unknown, stale or repeated answers; placeholders lost or doubled;
    an English text that stays untranslated or is copied; enforced terms without any of their targets.
    """
    g = "translation"
    status = responses(requests, answers, "id", "source_sha256", partial).where("status not in ('answered', 'pending')")
    pairs = requests.join(answers.select("id", "translation"), "id")
    broken = pairs.where(~placeholders_match(F.col("translation"), F.col("spans")))
    whole = pairs.withColumn("restored", restore(F.col("translation"), F.col("spans")))
    plain = whole.where((english_words(F.col("source")) >= 4) & ~F.col("restored").rlike(target))
    copied = copy_ratio(whole, "source", "restored", compatible=compatible).where("is_copy")
    terms = whole.select("id", "source", "restored", F.explode("terms").alias("t")).where("t.enforce")
    lacking = terms.where(~F.exists("t.targets", lambda x: F.contains(F.col("restored"), x)))
    return together([
        failures(status, g, "response", "id", F.col("status")),
        failures(broken, g, "placeholders", "id", "placeholders differ"),
        failures(plain, g, "untranslated", "id", "no target script"),
        failures(copied, g, "copied", "id", "source copied"),
        failures(lacking, g, "glossary", "id", F.concat(F.lit("missing "), F.col("t.term"))),
    ])


def missing_uris(uris: DataFrame, text: DataFrame) -> DataFrame:
    """document, uri: URIs (document, uri) that no emitted piece (document, md) of their document holds.

    Words of the text that are a URI as they stand are compared by equality; what is left, such as a URI
    behind a bracket or inside a longer one, is looked for in the pieces of its document alone.
    """
    words = text.select("document", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(r"[a-z][a-z0-9+.-]*:[^\s<>\"]+"), F.lit(0)))).alias("uri"))
    rest = uris.select("document", "uri").distinct().join(words, ["document", "uri"], "left_anti")
    pieces = text.select(F.col("document").alias("_d"), "md")
    return rest.join(pieces, (F.col("document") == F.col("_d")) & F.contains(F.col("md"), F.col("uri")), "left_anti")


#: Fixed value: the marker of an emitted block.
BLOCK_MARKER = r"<!-- bilingual:(\w+) id=(\S+) source_sha256=([0-9a-f]{64}) -->"
#: Fixed value: a marker of any spelling, or a placeholder, that must not be left in the output.
LEFT_OVER = r"⟦K\d+⟧"


def output_gate(blocks: DataFrame, text: DataFrame, inputs: DataFrame, pins: DataFrame, uris: DataFrame) -> DataFrame:
    """document, gate, check, subject, message: emitted Markdown against the blocks of its document.

    blocks: document, id, source_sha256, mode; text: document, md, in as many pieces as there are;
    inputs and pins: artifact, sha256 (of all documents); uris: document, uri. A block without a hash
    or mode matches no marker.
    """
    key = ["document", "id"]
    marks = text.select("document", F.explode(F.regexp_extract_all("md", F.lit(BLOCK_MARKER), F.lit(0))).alias("m"))
    marks = marks.select("document", *[F.regexp_extract("m", BLOCK_MARKER, i + 1).alias(c) for i, c in enumerate(("emode", "id", "esha"))])
    both = blocks.join(marks, key).where("not (esha <=> source_sha256 and emode <=> mode)")
    repeated = marks.groupBy(key).count().where("count > 1")
    gone = blocks.select(key).distinct().join(marks, key, "left_anti").withColumn("side", F.lit("missing"))
    more = marks.select(key).distinct().join(blocks, key, "left_anti").withColumn("side", F.lit("extra"))
    left = text.where(F.col("md").rlike(LEFT_OVER)).select("document", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(LEFT_OVER), F.lit(0)))).alias("p")).distinct()
    return together([
        by_document(gone.unionByName(more), "output", "markers", "id", F.col("side")),
        by_document(both, "output", "marker_content", "id", "hash or mode differs"),
        by_document(repeated, "output", "marker_once", "id", "marker repeated"),
        by_document(left, "output", "placeholder_left", "p", "placeholder in the output"),
        by_document(pinned(inputs, pins).withColumn("document", F.lit(None).cast(blocks.schema["document"].dataType)), "output", "pins", "artifact", "input changed"),
        by_document(missing_uris(uris, text), "output", "uris", "uri", "not in the output"),
    ])


def by_document(rows: DataFrame, gate: str, check: str, subject: str, message: str | Column) -> DataFrame:
    """Failure rows that keep their document; it is null where a fault concerns all."""
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select("document", F.lit(gate).alias("gate"), F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), message.alias("message"))


def document_status(found: DataFrame, documents: DataFrame) -> DataFrame:
    """document, failures, status: one verdict a document; a fault of no document fails them all."""
    n = found.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    common = found.where("document is null").agg(F.count(F.lit(1)).alias("_all"))
    out = documents.select("document").distinct().join(n.where("document is not null"), "document", "left").crossJoin(F.broadcast(common))  # one row
    out = out.select("document", (F.coalesce("n", F.lit(0)) + F.col("_all")).alias("failures"))
    return out.withColumn("status", F.when(F.col("failures") > 0, "failed").otherwise("passed"))


#: The letters of a text by which pages are searched for it, and how many such heads meet a page at once.
HEAD, HEADS = 8, 4096


def on_pages(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """document, _t: the texts (document, _t) that a page (document, _p) of their document holds.

    A text on a page holds its own first letters there. So a page meets the heads of the texts of its
    document, in slices where there are many, and only heads that it holds go on; a text that is longer
    than its head is verified on the pages which hold that.
    """
    texts = wanted.where("_t is not null").distinct().withColumn("_head", F.substring("_t", 1, HEAD))
    heads = texts.select("document", "_head").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("document")))
    slices = heads.groupBy("document", F.pmod(F.xxhash64("_head"), F.ceil(F.col("_n") / HEADS)).alias("_slice"))
    of = lambda test: F.collect_set(F.when(test, F.col("_head")))
    listed = slices.agg(of(F.length("_head") == HEAD).alias("_whole"), of(F.length("_head") < HEAD).alias("_brief"))
    pieces = F.regexp_extract_all("_p", F.lit(f"(?s)(?=(.{{{HEAD}}}))"), F.lit(1))
    held = F.concat(F.array_intersect(pieces, "_whole"), F.filter("_brief", lambda h: F.contains(F.col("_p"), h)))
    keyed = shown.where("_p is not null").withColumn("_key", F.xxhash64("_p"))
    met = keyed.join(listed, "document").select("document", "_key", F.explode(held).alias("_head")).join(texts, ["document", "_head"])
    long = met.where(F.length("_t") > HEAD).join(keyed, ["document", "_key"]).where(F.contains("_p", "_t"))
    return met.where(F.length("_t") <= HEAD).select("document", "_t").unionByName(long.select("document", "_t"))


def render_gate(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """document, gate, check, subject, message: rendered pages (document, page, text, ink, width, height)
    against the group texts (document, group_id, text) that must lie on a page of their document.

    A page whose text, ink or size is unknown counts as blank or of the wrong size.
    """
    blank = pages.where("coalesce(length(trim(text)), 0) < 15 and coalesce(ink, 0) < 0.002")
    a4 = (F.abs(F.col("width") - 595.28) < 1) & (F.abs(F.col("height") - 841.89) < 1)
    size = pages.where(~F.coalesce(a4, F.lit(False)))
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    shown = pages.select("document", flat(F.col("text")).alias("_p"))
    wanted = expected.select("document", "group_id", flat(F.col("text")).alias("_t"))
    seen = wanted.join(on_pages(wanted.select("document", "_t"), shown), ["document", "_t"], "left_anti")
    return together([by_document(blank, "render", "blank_page", "page", "no text or ink"), by_document(size, "render", "page_size", "page", "not A4"), by_document(seen, "render", "group_present", "group_id", "not on any page")])


#: The stages in order, and what to do where one has not passed.
STAGES = ["source_audit", "translation_plan", "translation_audit", "output_audit", "docx_audit", "compile_audit", "visual_review", "qa_report"]


def next_action(gates: DataFrame, by: str) -> DataFrame:
    """by, stage, action: the first stage in order that has not passed, and whether to review or to run it."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("gate"))
    ranked = gates.select(by, order.alias("o"), "gate", "status").where("o > 0")
    passed = ranked.groupBy(by).agg(F.collect_set(F.when(F.col("status") == "passed", F.col("gate"))).alias("ok"), F.collect_set(F.when(F.col("status") == "manual_review_required", F.col("gate"))).alias("manual"))
    stage = F.get(F.filter(F.array(*map(F.lit, STAGES)), lambda s: ~F.array_contains(F.col("ok"), s)), 0)
    action = F.when(F.col("stage").isNull(), "complete").when(F.array_contains("manual", F.col("stage")), F.concat(F.lit("review "), F.col("stage"))).otherwise(F.concat(F.lit("run "), F.col("stage")))
    return passed.withColumn("stage", stage).select(by, "stage", action.alias("action"))


__all__ = ["document_status", "failures", "gate_status", "next_action", "output_gate", "problem_gate", "render_gate", "source_gate", "status_of", "translation_gate"]
