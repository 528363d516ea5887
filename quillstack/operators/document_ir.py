"""The document model: blocks become nodes with a semantic policy, anchors become groups, roles an inventory.

Everything is keyed by (document, id), so one plan builds the models of any number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .classify import auxiliary_role, classify

#: Levels of group membership.
MEMBERSHIP = ["none", "anchor-only", "complete"]
OUTPUT_COLUMNS = {"bilingual": "bilingual", "source-only": "source_only", "visual-once": "visual_once", "artifact-omitted": "artifact_omitted"}


def _by_role(role: Column, roles: list[dict], field: str) -> Column:
    """A field of the role's policy: a profile holds a few dozen roles, so this is one expression."""
    out = F.lit(None).cast("string")
    for r in reversed(roles):
        out = F.when(role == r["role"], F.lit(r.get(field))).otherwise(out)
    return out


def nodes_of(blocks: DataFrame, roles: list[dict], auxiliary: dict[str, str] | None = None) -> DataFrame:
    """blocks with role, style, output, grouping, method and selector.

    blocks: document, id, kind, translatable and what `classify` reads. A block that no selector takes
    follows the disposition of its auxiliary role; one without either is omitted if it is an artifact,
    bilingual if it may be translated, else shown once.
    """
    auxiliary = auxiliary or {}
    found = classify(blocks, roles).withColumnRenamed("role", "_role").drop("tier")
    named = F.col("_role")
    spare = F.when(named.isNull(), auxiliary_role(F.col("adapter_role")))
    spare = F.when(spare.isin(list(auxiliary)), spare) if auxiliary else F.lit(None).cast("string")
    rest = F.when(F.col("kind") == "artifact", "artifact-omitted").when(F.col("translatable"), "bilingual").otherwise("source-only")
    disposition = F.coalesce(*[F.when(spare == k, F.lit(v)) for k, v in auxiliary.items()], rest)
    method = F.when(named.isNotNull(), "profile-selector").when(spare.isNotNull(), "profile-auxiliary-disposition").otherwise("unclassified")
    return found.select(
        *[c for c in found.columns if c != "_role"],
        F.coalesce(named, spare).alias("role"),
        _by_role(named, roles, "style").alias("style"),
        F.when(named.isNotNull(), _by_role(named, roles, "output")).otherwise(disposition).alias("output"),
        _by_role(named, roles, "grouping").alias("grouping"),
        method.alias("method"),
    )


def groups_of(nodes: DataFrame) -> DataFrame:
    """document, group_id, role, anchor, members, membership, pages: one group for each node a selector took.

    nodes: document, id, page, role, grouping, method, adapter, and members (ids that the adapter says
    belong to the node, null without such evidence). A container's members count only if they are
    distinct, hold the anchor, and all exist with the same adapter; else the group is its anchor alone.
    """
    anchors = nodes.where("method = 'profile-selector'").select("document", F.col("id").alias("anchor"), "role", "page", "adapter", F.when(F.col("grouping") == "structural-container", F.col("members")).alias("members"))
    sound = F.coalesce((F.size("members") > 0) & (F.size(F.array_distinct("members")) == F.size("members")) & F.array_contains("members", F.col("anchor")), F.lit(False))
    claimed = anchors.where(sound).select("document", "anchor", "adapter", F.size("members").alias("n"), F.explode("members").alias("id"))
    there = nodes.select("document", "id", F.col("page").alias("member_page"), F.col("adapter").alias("member_adapter"))
    proved = claimed.join(there, ["document", "id"]).where("adapter = member_adapter").groupBy("document", "anchor", "n").agg(F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_set("member_page")).alias("_pages")).where("found = n")
    out = anchors.join(proved.select("document", "anchor", "_pages"), ["document", "anchor"], "left")
    whole = F.col("_pages").isNotNull()
    return out.select(
        "document",
        F.concat_ws(":", "role", "anchor").alias("group_id"),
        "role",
        "anchor",
        F.when(whole, F.col("members")).otherwise(F.array("anchor")).alias("members"),
        F.when(whole, "complete").otherwise("anchor-only").alias("membership"),
        F.coalesce("_pages", F.array("page")).alias("pages"),
    )


def model_of(blocks: DataFrame, roles: list[dict], auxiliary: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and groups of the documents, each computed once and written; texts are left to the blocks.

    What is asked of a model joins nodes and groups again and again, so they are tables and no plan
    carries the profile's patterns more than once.
    """
    nodes = nodes_of(blocks, roles, auxiliary)
    nodes = written(nodes.drop("source"), "nodes")
    return nodes, written(groups_of(nodes), "groups")


def members_of(groups: DataFrame) -> DataFrame:
    return groups.select("document", "group_id", "role", "membership", F.posexplode("members").alias("place", "id"))


def groups_of_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes (document, id) with the sorted ids of the groups they belong to."""
    lists = members_of(groups).groupBy("document", "id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    return nodes.join(lists, ["document", "id"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def group_faults(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """document, group_id, fault: unknown or repeated members, repeated group ids, an anchor outside its group
    or of another role."""
    members = members_of(groups)
    unknown = members.join(nodes.select("document", "id"), ["document", "id"], "left_anti").select("document", "group_id", F.lit("unknown member").alias("fault")).distinct()
    named = nodes.select("document", F.col("id").alias("anchor"), F.col("role").alias("_own"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("document", "group_id"))
    nth = F.row_number().over(Window.partitionBy("document", "group_id").orderBy("anchor"))
    tests = {
        "repeated member": F.size(F.array_distinct("members")) < F.size("members"),
        "repeated group": (twice > 1) & (nth == 1),
        "anchor outside": ~F.array_contains("members", F.col("anchor")),
        "anchor of another role": F.col("_own") != F.col("role"),
    }
    own = groups.join(named, ["document", "anchor"], "left").select("document", "group_id", F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]).alias("_f"))
    own = own.select("document", "group_id", F.explode(F.filter("_f", lambda x: x.isNotNull())).alias("fault"))
    return unknown.unionByName(own)


def inventory_of(groups: DataFrame, roles: DataFrame) -> DataFrame:
    """document, role, counts and bounds for every role of the profile in every document, zeros included.

    roles: role, minimum, maximum (a few dozen rows). occurrence_ids lists a role's groups of one
    document in id order.
    """
    members = members_of(groups)
    nodes = members.groupBy("document", "role").agg(F.countDistinct("id").alias("node_count"))
    levels = [F.count_if(F.col("membership") == m).alias(m.replace("-", "_")) for m in MEMBERSHIP]
    seen = groups.groupBy("document", "role").agg(F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_list("group_id")).alias("occurrence_ids"), *levels)
    every = groups.select("document").distinct().crossJoin(F.broadcast(roles))  # the profile's roles for each document
    out = every.join(seen, ["document", "role"], "left").join(nodes, ["document", "role"], "left")
    out = out.na.fill(0, ["occurrence_count", "node_count", "none", "anchor_only", "complete"]).withColumn("occurrence_ids", F.coalesce("occurrence_ids", F.array().cast("array<string>")))
    within = (F.col("occurrence_count") >= F.col("minimum")) & (F.col("maximum").isNull() | (F.col("occurrence_count") <= F.col("maximum")))
    return out.withColumn("within_bounds", within)


def block_faults(blocks: DataFrame) -> DataFrame:
    """document, id, fault: ids missing or given twice, and texts that differ from their hash."""
    twice = blocks.groupBy("document", "id").count().where("count > 1").select("document", "id", F.lit("repeated id").alias("fault"))
    none = blocks.where("id is null or id = ''").select("document", "id", F.lit("no id").alias("fault"))
    stale = blocks.where(~F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256).eqNullSafe(F.col("source_sha256"))).select("document", "id", F.lit("hash differs").alias("fault"))
    return twice.unionByName(none).unionByName(stale)


def changed(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows of a stored model that a rebuild doesn't give (side gone) and the reverse (side new)."""
    rebuilt = rebuilt.select(stored.columns)
    return stored.exceptAll(rebuilt).withColumn("side", F.lit("gone")).unionByName(rebuilt.exceptAll(stored).withColumn("side", F.lit("new")))


def requests_of(nodes: DataFrame) -> DataFrame:
    """The nodes that are sent out for translation: bilingual ones that may be translated."""
    return nodes.where(F.col("translatable") & (F.col("output") == "bilingual"))


def native_pages(pages: DataFrame, document: str, text: str, least_chars: int, least_ratio: float) -> DataFrame:
    """document, pages, native, ratio, passed: the share of pages whose own text is long enough."""
    native = F.count_if(F.length(F.trim(F.col(text))) >= least_chars)
    out = pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages"), native.alias("native"))
    return out.withColumn("ratio", F.col("native") / F.col("pages")).withColumn("passed", F.col("ratio") >= least_ratio)
