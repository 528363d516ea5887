"""The gate on finished word-processor files: framed paragraphs against the groups of the document model.

Tables, all keyed by document: paragraphs (document, place, text, left, right, top, top_size, bottom,
indent_left, indent_right; border fields are colours), nodes (document, id, role, output, type, source),
groups (document, group_id, role, membership, anchor, members), roles (role, grouping, colour), bodies
(document, text, links, images, tables) and builds (document, links, assets, tables). The result is a row
(document, gate, check, subject, message) for each fault; gates.document_status makes the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, contains_cjk, occurrences, strip_markup
from ..sources.scratch import written
from .gates import by_document, together

GATE = "docx"
#: A role whose groups are framed, the size of a divider and of a frame's upper edge, and internal marks.
CONTAINER, DIVIDER_SIZE, OPENING_SIZE = "structural-container", "8", "12"
MARKS = ["V2-PROBLEM-CALLOUT", "V23-CALLOUT-BEGIN", "V23-CALLOUT-END"]


def searched(source: Column, kind: Column) -> Column:
    """What a node may look like in the file: its text, a table without its markup, a list as one line with or without bullets."""
    entries = F.transform(F.filter(F.split(source, r"\R"), lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(s, r"^\s*[-*+]\s+", ""))
    line = F.array_join(entries, " ")
    listed = F.when(kind == "list", F.array(line, F.concat(F.lit("• "), F.array_join(entries, " • "))))
    table = F.when((kind == "table") & F.contains(source, F.lit("<")), F.array(strip_markup(source)))
    none = F.array().cast("array<string>")
    all_ = F.transform(F.concat(F.array(F.coalesce(source, F.lit(""))), F.coalesce(table, none), F.coalesce(listed, none)), collapse)
    return F.array_distinct(F.filter(all_, lambda s: s != ""))


def frames(paragraphs: DataFrame, colours: list[str] | None = None, opening: bool = False) -> DataFrame:
    """paragraphs with `frame` (the place where their frame begins) and `colour`; those outside a frame are left out.

    A frame is a run of neighbours with one colour on both sides. A lower edge ends it, but not at its
    first paragraph, and with `opening` an upper edge of the opening size begins another. In a row of
    neighbours that all have lower edges, first paragraphs and last ones therefore alternate.
    """
    w = Window.partitionBy("document").orderBy("place")
    both = F.when(F.col("left") == F.col("right"), F.col("left"))
    if colours is not None:
        both = F.when(both.isin(colours), both)
    rows = paragraphs.withColumn("colour", F.nullif(both, F.lit("")))
    rows = rows.withColumn("_run", ~F.coalesce(F.lag("colour").over(w) == F.col("colour"), F.lit(False)))
    if opening:
        rows = rows.withColumn("_run", F.col("_run") | F.coalesce((F.col("top") == F.col("colour")) & (F.col("top_size") == OPENING_SIZE), F.lit(False)))
    rows = rows.withColumn("_edge", F.coalesce(F.col("bottom") == F.col("colour"), F.lit(False)))
    if opening:
        ends = F.col("_edge")
    else:
        # a streak of lower edges, and whether it starts where its run does
        rows = rows.withColumn("_new", F.col("_edge") & (F.col("_run") | ~F.coalesce(F.lag("_edge").over(w), F.lit(False))))
        rows = rows.withColumn("_streak", F.max(F.when(F.col("_new"), F.struct("place", "_run"))).over(w)).withColumn("_k", F.row_number().over(w))
        rows = rows.withColumn("_from", F.max(F.when(F.col("_new"), F.col("_k"))).over(w))
        odd = (F.col("_k") - F.col("_from")) % 2 == 0
        ends = F.col("_edge") & (odd != F.col("_streak._run"))
    rows = rows.withColumn("_ends", ends)
    starts = F.col("_run") | F.coalesce(F.lag("_ends").over(w), F.lit(False))
    rows = rows.withColumn("frame", F.max(F.when(starts, F.col("place"))).over(w)).where("colour is not null")
    return rows.select(*paragraphs.columns, "frame", "colour")


def frame_rows(framed: DataFrame) -> DataFrame:
    """document, frame, colour, text, before, after and what a sound frame needs: one indent, one divider inside, its own edges."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    divides = F.coalesce(blank & (F.col("top") == F.col("colour")) & (F.col("top_size") == DIVIDER_SIZE), F.lit(False))
    row = F.struct("place", F.coalesce("text", F.lit("")).alias("text"), divides.alias("divides"))
    out = framed.groupBy("document", "frame", "colour").agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        F.count_distinct(F.coalesce("indent_left", F.lit("")), F.coalesce("indent_right", F.lit(""))).alias("indents"),
        F.min_by("top", "place").alias("_top"),
        F.max_by("bottom", "place").alias("_bottom"),
    )
    joined = lambda rows: collapse(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"))
    at = F.array_position(F.transform("_rows", lambda r: r["divides"]), True)
    out = out.withColumn("dividers", F.size(F.filter("_rows", lambda r: r["divides"]))).withColumn("_at", at.cast("int"))
    inside = (F.col("_at") > 1) & (F.col("_at") < F.size("_rows"))
    edges = F.col("_top").eqNullSafe(F.col("colour")) & F.col("_bottom").eqNullSafe(F.col("colour"))
    return out.select(
        "document", "frame", "colour", joined(F.col("_rows")).alias("text"),
        F.when(inside, joined(F.slice("_rows", 1, F.col("_at") - 1))).alias("before"),
        F.when(inside, joined(F.slice("_rows", F.col("_at") + 1, F.size("_rows")))).alias("after"),
        ((F.col("indents") == 1) & (F.col("dividers") == 1) & inside & edges).alias("sound"),
    )


def in_turn(members: Column, text: Column) -> Column:
    """Whether one of the forms of each member (an array of forms, in order) stands in the text, each behind the one before."""

    def step(state: Column, forms: Column) -> Column:
        found = F.filter(F.transform(forms, lambda s: F.call_function("locate", s, text, state["cursor"] + 1)), lambda p: p > 0)
        first = F.array_min(found)
        return F.struct(F.greatest(state["cursor"], F.coalesce(first, F.lit(0))).cast("int").alias("cursor"), (state["ok"] & first.isNotNull()).alias("ok"))

    return F.aggregate(members, F.struct(F.lit(0).alias("cursor"), F.lit(True).alias("ok")), step)["ok"]


def matched_groups(frames_: DataFrame, nodes: DataFrame, groups: DataFrame, roles: DataFrame, target=contains_cjk) -> DataFrame:
    """document, group_id, membership, container, frames, frame, valid: which frame shows each group, and whether as it should.

    Exactly one frame of the document must hold the anchor's source; it has the colour of the role, is
    sound, has the target language behind its divider, and before it the anchor alone (a group of its
    anchor) or all members in order.
    """
    spec = roles.select("role", (F.col("grouping") == CONTAINER).alias("container"), F.col("colour").alias("_wanted"))
    forms = nodes.select("document", "id", searched(F.col("source"), F.col("type")).alias("forms"))
    listed = groups.select("document", "group_id", F.posexplode("members").alias("k", "id")).join(forms, ["document", "id"], "left")
    empty = F.array().cast("array<string>")
    members = listed.groupBy("document", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("forms", empty).alias("forms")))), lambda s: s["forms"]).alias("_members"))
    rows = groups.join(spec, "role").join(forms.select("document", F.col("id").alias("anchor"), F.col("forms").alias("_anchor")), ["document", "anchor"], "left").join(members, ["document", "group_id"], "left")
    # a document has a few dozen frames and groups; they meet by document
    there = frames_.select("document", F.struct("frame", "colour", "text", "before", "after", "sound").alias("_f"))
    holds = F.exists("_anchor", lambda s: F.contains(F.col("_f.text"), s))
    hits = rows.select("document", "group_id", "_anchor").join(there, "document").where(holds).groupBy("document", "group_id").agg(F.count(F.lit(1)).alias("frames"), F.any_value("_f").alias("_f"))
    out = rows.join(hits, ["document", "group_id"], "left").na.fill(0, ["frames"])
    alone = (F.size("members") == 1) & (F.get("members", F.lit(0)) == F.col("anchor")) & F.array_contains(F.col("_anchor"), F.col("_f.before"))
    content = F.when(F.col("membership") == "complete", in_turn(F.col("_members"), F.col("_f.before"))).otherwise(alone)
    valid = (F.col("frames") == 1) & (F.col("_f.colour") == F.col("_wanted")) & F.col("_f.sound") & content & target(F.col("_f.after"))
    return out.select("document", "group_id", "role", "membership", "container", "frames", F.when(F.col("frames") == 1, F.col("_f.frame")).alias("frame"), F.coalesce(valid, F.lit(False)).alias("valid"))


def docx_gate(paragraphs: DataFrame, nodes: DataFrame, groups: DataFrame, roles: DataFrame, bodies: DataFrame, builds: DataFrame, expected: DataFrame, target=contains_cjk) -> DataFrame:
    """All faults of the files; expected: document, role, count, where a caller states it."""
    colours = [r["colour"] for r in roles.where(F.col("grouping") == CONTAINER).select("colour").distinct().collect() if r["colour"]]  # of a profile
    shown = written(frame_rows(frames(paragraphs, colours)), "frames")
    held = written(matched_groups(shown, nodes, groups, roles, target), "framed-groups")
    texts = bodies.select("document", collapse(F.coalesce("text", F.lit(""))).alias("_body"), F.coalesce("text", F.lit("")).alias("_raw"))
    known = nodes.select("document", "id", "output", searched(F.col("source"), F.col("type")).alias("forms")).join(texts, "document")
    counted = written(known.select("document", "id", "output", F.coalesce(F.array_max(F.transform("forms", lambda s: occurrences(F.col("_body"), s))), F.lit(0)).alias("n"), (F.size("forms") > 0).alias("filled")), "occurrences")

    evidence = groups.select("document", "group_id", "role", F.col("anchor").alias("id")).join(counted, ["document", "id"], "left")
    seen = evidence.groupBy("document", "role").agg(F.count_if(F.col("n") > 0).alias("textual"), F.count_if((F.coalesce("n", F.lit(0)) == 0) & (F.col("output") == "visual-once")).alias("visual"), F.count(F.lit(1)).alias("groups"))
    visual = seen.groupBy("document").agg(F.sum("visual").alias("visual"))
    claimed = held.where("container and valid").groupBy("document", "frame").agg(F.count(F.lit(1)).alias("claims"))
    unclaimed = shown.select("document", "frame").join(claimed, ["document", "frame"], "left").where("claims is null or claims > 1")
    stated = expected.join(groups.groupBy("document", "role").agg(F.count(F.lit(1)).alias("_n")), ["document", "role"], "left").where("not (coalesce(_n, 0) <=> count)")
    # what is not there, such as a build that was never recorded, matches nothing
    files = bodies.join(builds.select("document", F.col("links").alias("_links"), F.col("assets").alias("_assets"), F.col("tables").alias("_tables")), "document", "full_outer").join(visual, "document", "left").na.fill(0, ["visual"])
    marked = F.exists(F.array(*map(F.lit, MARKS)), lambda m: F.contains(F.col("_raw"), m))
    fault = lambda rows, check, subject, message: by_document(rows, GATE, check, subject, message)
    return together([
        fault(stated, "role_inventory", "role", "another number of groups than stated"),
        fault(seen.where("textual + visual <> groups"), "occurrence_evidenced", "role", "an occurrence is neither text nor picture"),
        fault(counted.where("output = 'source-only' and filled and n <> 1"), "source_only_once", "id", F.concat(F.col("n").cast("string"), F.lit(" times"))),
        fault(held.where("container and membership = 'complete' and not valid"), "complete_container", "group_id", F.concat(F.col("frames").cast("string"), F.lit(" frames"))),
        fault(held.where("container and membership = 'anchor-only' and not valid"), "scoped_anchor", "group_id", F.concat(F.col("frames").cast("string"), F.lit(" frames"))),
        fault(unclaimed, "frame_unaccounted", "frame", "not the frame of exactly one group"),
        fault(held.where("not container and membership = 'anchor-only' and frames > 0"), "boxed", "group_id", "framed without reason"),
        fault(texts.where(marked), "internal_marks", "document", "a mark is left"),
        fault(texts.where(~F.coalesce(target(F.col("_body")), F.lit(False))), "target_language", "document", "no target language"),
        fault(files.where(~F.array_sort("links").eqNullSafe(F.array_sort("_links"))), "links", "document", "other links than built"),
        fault(files.where("not coalesce(images >= visual and images >= _assets, false)"), "pictures", "document", "fewer pictures than shown"),
        fault(files.where("not (tables <=> _tables)"), "tables", "document", "other native tables than built"),
    ])


def problem_frames(paragraphs: DataFrame, colour: str, problem: str) -> DataFrame:
    """document, frame, stable: frames of the first profile version whose text is a problem (a pattern).

    paragraphs also have numbered, first_line, hanging and rule. A stable frame has one indent, explicit
    origins of its numbers, no old horizontal rule, and exactly one edge inside that separates languages.
    """
    rows = frames(paragraphs, [colour], opening=True)
    first = F.col("place") == F.col("frame")
    explicit = ~F.coalesce("numbered", F.lit(False)) | (F.col("first_line").eqNullSafe(F.lit("0")) & F.col("hanging").isNull())
    out = rows.groupBy("document", "frame").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "").alias("text"),
        F.count_distinct(F.coalesce("indent_left", F.lit("")), F.coalesce("indent_right", F.lit(""))).alias("indents"),
        F.count_if(~explicit).alias("implicit"),
        F.count_if(F.coalesce("rule", F.lit(False))).alias("rules"),
        F.count_if(~first & (F.col("top") == colour)).alias("separators"),
    )
    stable = (F.col("indents") == 1) & (F.col("implicit") == 0) & (F.col("rules") == 0) & (F.col("separators") == 1)
    return out.where(F.ltrim("text").rlike(problem)).select("document", "frame", stable.alias("stable"))


def docx_gate_v1(paragraphs: DataFrame, bodies: DataFrame, colour: str, problem: str, least_images: int = 0, target=contains_cjk) -> DataFrame:
    """The faults of files of the first profile version: problem has one group, the id."""
    pattern = "(?im)" + problem
    texts = bodies.select("document", F.coalesce("text", F.lit("")).alias("_raw"), "images")
    ids = texts.select("document", F.explode(F.regexp_extract_all("_raw", F.lit(pattern), F.lit(1))).alias("problem"))
    framed = problem_frames(paragraphs, colour, pattern)
    both = ids.groupBy("document").agg(F.count(F.lit(1)).alias("problems")).join(framed.groupBy("document").agg(F.count(F.lit(1)).alias("framed")), "document", "full_outer").na.fill(0)
    fault = lambda rows, check, subject, message: by_document(rows, GATE, check, subject, message)
    return together([
        fault(ids.groupBy("document", "problem").count().where("count > 1"), "problem_ids_unique", "problem", "named twice"),
        fault(both.where("problems <> framed"), "problem_frames", "document", F.format_string("%d problems, %d frames", "problems", "framed")),
        fault(framed.where("not stable"), "problem_borders", "frame", "not aligned"),
        fault(texts.where(F.contains("_raw", F.lit(MARKS[0]))), "internal_marks", "document", "a mark is left"),
        fault(texts.where(~F.coalesce(target(F.col("_raw")), F.lit(False))), "target_language", "document", "no target language"),
        fault(texts.where(~F.coalesce(F.col("images") >= least_images, F.lit(False))), "pictures", "document", "too few pictures"),
    ])
