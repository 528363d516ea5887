"""Adapter evidence: items against content, nodes, visuals, assets and pages, as rows of faults.

Tables of one import or of many, keyed by document: items (document, position, pointer, item_sha256,
raw_type, page_idx, disposition, reason, node_ids, visual_ids), content (document, position, sha256,
type, page_idx), nodes (document, id, pointer, item_sha256), visuals (document, id, asset_id, sha256),
assets (document, id, sha256), pages (document, page_idx, status, reasons, counts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip_markup

#: Dispositions of an item, and what an import file is called after its document.
DISPOSITIONS = ["emitted", "artifact_omitted"]
SUFFIXES = {"content": "_content_list.json", "middle": "_middle.json", "origin": "_origin.pdf"}


def _faults(rows: DataFrame, check: str, subject: Column) -> DataFrame:
    return rows.select("document", F.lit(check).alias("check"), subject.cast("string").alias("subject"))


def item_faults(items: DataFrame, content: DataFrame) -> DataFrame:
    """document, check, subject: pointers that aren't the position or occur twice, items that differ from the
    content, and dispositions without target, with repeated targets, or omitted without a reason."""
    place = F.concat(F.lit("/"), F.col("position").cast("string"))
    blank = F.coalesce(F.trim("reason") == "", F.lit(True))
    none = (F.size("node_ids") == 0) & (F.size("visual_ids") == 0)
    double = (F.size(F.array_distinct("node_ids")) < F.size("node_ids")) | (F.size(F.array_distinct("visual_ids")) < F.size("visual_ids"))
    own = {
        "pointer_position": ~F.col("pointer").eqNullSafe(place),
        "disposition": ~F.coalesce(F.col("disposition").isin(DISPOSITIONS), F.lit(False)),
        "no_target": F.coalesce(none, F.lit(True)),
        "repeated_target": double,
        "no_reason": (F.col("disposition") == "artifact_omitted") & blank,
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in own.items()]), lambda x: x.isNotNull())
    alone = items.select("document", F.explode(found).alias("check"), place.alias("subject"))
    twice = _faults(items.groupBy("document", "pointer").count().where("count > 1"), "pointer_repeated", F.col("pointer"))
    there = content.select("document", "position", F.col("sha256").alias("_sha"), F.col("type").alias("_type"), F.col("page_idx").alias("_page"))
    both = items.join(there, ["document", "position"])
    differs = {"item_hash": ("item_sha256", "_sha"), "item_type": ("raw_type", "_type"), "item_page": ("page_idx", "_page")}
    compared = [_faults(both.where(~F.col(a).eqNullSafe(F.col(b))), check, place) for check, (a, b) in differs.items()]
    return reduce(DataFrame.unionByName, [alone, twice, *compared])


def pointer_faults(items: DataFrame, nodes: DataFrame, visuals: DataFrame) -> DataFrame:
    """document, check, subject: nodes and visuals named by no item, by several, or unknown, and nodes whose own
    pointer or hash isn't that of the item that names them."""
    to_nodes = items.select("document", "pointer", "item_sha256", F.explode("node_ids").alias("id"))
    to_visuals = items.select("document", F.explode("visual_ids").alias("id"))
    own = nodes.select("document", "id", F.col("pointer").alias("_pointer"), F.col("item_sha256").alias("_sha"))
    known = to_nodes.join(own, ["document", "id"])
    parts = []
    for name, named, all_ in (("node", to_nodes, nodes), ("visual", to_visuals, visuals)):
        parts += [
            _faults(named.groupBy("document", "id").count().where("count > 1"), f"{name}_named_twice", F.col("id")),
            _faults(named.select("document", "id").distinct().join(all_.select("document", "id"), ["document", "id"], "left_anti"), f"{name}_unknown", F.col("id")),
            _faults(all_.select("document", "id").join(named.select("document", "id"), ["document", "id"], "left_anti"), f"{name}_unnamed", F.col("id")),
        ]
    parts += [
        _faults(known.where(~F.col("_pointer").eqNullSafe(F.col("pointer"))), "reverse_pointer", F.col("id")),
        _faults(known.where(~F.col("_sha").eqNullSafe(F.col("item_sha256"))), "reverse_hash", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def asset_faults(visuals: DataFrame, assets: DataFrame) -> DataFrame:
    """document, check, subject: visuals without an asset, or with other bytes than their asset."""
    there = assets.select("document", F.col("id").alias("asset_id"), F.col("sha256").alias("_sha"))
    both = visuals.join(there, ["document", "asset_id"], "left")
    gone = _faults(both.where("_sha is null"), "asset_unknown", F.col("id"))
    return gone.unionByName(_faults(both.where("_sha is not null and not (_sha <=> sha256)"), "asset_hash", F.col("id")))


def asset_paths(content: DataFrame, tree: DataFrame) -> DataFrame:
    """document, path: every asset that the content or the tree names, once."""
    return content.select("document", "path").union(tree.select("document", "path")).where("path is not null").distinct()


def page_reasons(native: Column, english: Column, adapter: Column, raster: Column, least: Column, low_ratio: Column) -> Column:
    """Why a page needs a reviewer: no native text, enough native text that is not English prose, a document short of
    native pages, a large raster or much more adapter text on a page short of native text."""
    short = native < least
    tests = {
        "native_oracle_empty": native == 0,
        "native_oracle_not_substantive_english": (native >= least) & ~english,
        "document_native_ratio_below_threshold": low_ratio & short,
        "large_raster_without_native_oracle": (raster >= 0.5) & short,
        "adapter_text_without_native_oracle": short & (adapter >= 2 * F.greatest(native, F.lit(1))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())


def page_faults(pages: DataFrame, derived: DataFrame) -> DataFrame:
    """document, check, subject: pages whose stored reasons or status differ from those derived again, pages
    missing on a side, and indices that leave gaps."""
    again = derived.select("document", "page_idx", F.array_sort("reasons").alias("_reasons"))
    both = pages.join(again, ["document", "page_idx"], "full_outer")
    status = F.when(F.size("_reasons") > 0, "manual_source_review_required").otherwise("native_oracle_available")
    gaps = pages.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.min("page_idx").alias("lo"), F.max("page_idx").alias("hi"), F.countDistinct("page_idx").alias("d")).where("lo <> 0 or hi <> n - 1 or d <> n")
    parts = [
        _faults(both.where("_reasons is null"), "page_extra", F.col("page_idx")),
        _faults(both.where("status is null"), "page_missing", F.col("page_idx")),
        _faults(both.where("status is not null and _reasons is not null").where(~F.array_sort("reasons").eqNullSafe(F.col("_reasons"))), "page_reasons", F.col("page_idx")),
        _faults(both.where("status is not null and _reasons is not null").where(F.col("status") != status), "page_status", F.col("page_idx")),
        _faults(gaps, "page_gaps", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Kinds of blocks whose text is no content.
UNTEXTUAL = ("artifact", "image")


def textual(kind: Column) -> Column:
    """Whether blocks of this kind hold text of the document; a block without a kind does."""
    return ~F.coalesce(kind.isin(*UNTEXTUAL), F.lit(False))


def substantive(text: Column, kind: Column, compatible: bool = False) -> Column:
    """The normalised text of a block as far as it counts: none of artifacts and images, of tables what is visible."""
    shown = F.when(kind == "table", strip_markup(text)).otherwise(text)
    return F.when(textual(kind), normalize_text(shown, compatible))


def text_lengths(blocks: DataFrame, pages: DataFrame, text: str, kind: str, compatible: bool = False) -> DataFrame:
    """document, page, chars: the length of a page's substantive texts, normalised and joined by blanks in order;
    pages without any have 0. The sum needs no ordered list: pieces are trimmed and never empty."""
    blocks = blocks.select("document", "page", substantive(F.col(text), F.col(kind), compatible).alias("_t"))
    text = "_t"
    pieces = blocks.where(F.length(text) > 0).groupBy("document", "page").agg((F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("chars"))
    return pages.select("document", "page").join(pieces, ["document", "page"], "left").na.fill(0, ["chars"])


def input_faults(files: DataFrame, document_sha: DataFrame) -> DataFrame:
    """document, check, subject: an import folder needs exactly one file of each kind, and an origin that is the
    document's own file. files: document, path, sha256; document_sha: document, sha256."""
    kind = F.coalesce(*[F.when(F.col("path").endswith(s), F.lit(k)) for k, s in SUFFIXES.items()])
    named = files.withColumn("kind", kind).where("kind is not null")
    spark = files.sparkSession
    kinds = spark.createDataFrame([(k,) for k in SUFFIXES], "kind string")
    wanted = document_sha.select("document").crossJoin(F.broadcast(kinds))  # three rows a document
    counts = wanted.join(named.groupBy("document", "kind").agg(F.count(F.lit(1)).alias("n")), ["document", "kind"], "left").na.fill(0, ["n"])
    origin = named.where("kind = 'origin'").join(document_sha.withColumnRenamed("sha256", "_own"), "document").where("not (sha256 <=> _own) or sha256 is null")
    return reduce(DataFrame.unionByName, [_faults(counts.where("n = 0"), "file_missing", F.col("kind")), _faults(counts.where("n > 1"), "file_ambiguous", F.col("kind")), _faults(origin, "origin_hash", F.col("path"))])


def tree_faults(trees: DataFrame) -> DataFrame:
    """document, check, subject for tree files (document, backend, version, expected_version, pages, page_idx
    as an array, sizes as an array of [width, height])."""
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.col("pages") - 1, F.lit(0))), lambda i: i.cast("int"))
    bad_size = F.exists("sizes", lambda s: (F.size(s) != 2) | F.exists(s, lambda v: v.isNull() | F.isnan(v) | (v <= 0)))
    tests = {
        "backend": ~F.coalesce(F.col("backend") == "pipeline", F.lit(False)),
        "version": ~F.col("version").eqNullSafe(F.col("expected_version")),
        "page_count": F.size("page_idx") != F.col("pages"),
        "page_order": F.col("page_idx") != run,
        "page_size": bad_size,
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    return trees.select("document", F.explode(found).alias("check"), F.col("document").cast("string").alias("subject"))


def frozen_faults(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """document, check, subject: frozen files (document, path, size, sha256) that are gone, changed or named twice."""
    there = files.select("document", "path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = evidence.join(there, ["document", "path"], "left")
    twice = evidence.groupBy("document", "path").count().where("count > 1")
    parts = [_faults(both.where("_sha is null"), "file_gone", F.col("path")), _faults(both.where("_sha is not null and not (_size <=> size)"), "file_size", F.col("path")), _faults(both.where("_sha is not null and not (_sha <=> sha256)"), "file_hash", F.col("path")), _faults(twice, "file_twice", F.col("path"))]
    return reduce(DataFrame.unionByName, parts)
