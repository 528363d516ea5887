"""Which profile a work is bound to: content-addressed versions, compare-and-set, and migration of documents.

profiles: sha256, json, each content once. bindings: work, sha256, version. A request (work, sha256,
expected, force) names the profile it wants and the one its writer has seen, null for none. One pass
over the joined tables settles all requests; versions of the binding table are folders that are written
once, so of two writers of one version only the first succeeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256_text


def addressed(profiles: DataFrame, json_col: str) -> DataFrame:
    """sha256, json: every content once, under its hash."""
    return profiles.where(F.col(json_col).isNotNull()).select(sha256_text(F.col(json_col)).alias("sha256"), F.col(json_col).alias("json")).dropDuplicates(["sha256"])


def verdicts(requests: DataFrame, bindings: DataFrame, profiles: DataFrame) -> DataFrame:
    """work, sha256, bound, version, verdict of every request.

    unknown: no profile has that hash. repeated: the work has several requests, none is taken. same: bound
    to that content already. bound: the first binding. refused: bound to another profile, and no force.
    conflict: forced, but the binding is not what the writer has seen. rebound: forced.
    """
    per_work = requests.groupBy("work").agg(F.count(F.lit(1)).alias("_n"), F.min("sha256").alias("sha256"), F.min("expected").alias("expected"), F.min(F.coalesce("force", F.lit(False))).alias("force"))
    known = profiles.select("sha256", F.lit(True).alias("_known"))
    now = bindings.select("work", F.col("sha256").alias("bound"), "version")
    rows = per_work.join(known, "sha256", "left").join(now, "work", "left")
    verdict = (
        F.when(F.col("_n") > 1, "repeated")
        .when(F.col("_known").isNull(), "unknown")
        .when(F.col("bound").isNull(), "bound")
        .when(F.col("bound") == F.col("sha256"), "same")
        .when(~F.col("force"), "refused")
        .when(~F.col("expected").eqNullSafe(F.col("bound")), "conflict")
        .otherwise("rebound")
    )
    return rows.select("work", "sha256", "bound", "version", verdict.alias("verdict"))


def settled(bindings: DataFrame, judged: DataFrame) -> DataFrame:
    """work, sha256, version after the requests: first bindings have version 1, forced ones count on."""
    taken = judged.where("verdict in ('bound', 'rebound')").select("work", F.col("sha256").alias("_new"), (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("_v"))
    both = bindings.join(taken, "work", "full_outer")
    return both.select("work", F.coalesce("_new", "sha256").alias("sha256"), F.coalesce("_v", "version").alias("version"))


def invalidated(judged: DataFrame, artifacts: DataFrame, source: list[str]) -> DataFrame:
    """work, artifact: what a forced rebinding leaves behind; the sources (names) of a work stay sound."""
    return artifacts.join(judged.where("verdict = 'rebound'").select("work"), "work", "left_semi").where(~F.col("artifact").isin(source)).select("work", "artifact")


def commit(bindings: DataFrame, folder: str, version: int) -> None:
    """Write a version of the binding table; a version that is there already is never replaced."""
    bindings.write.mode("errorifexists").parquet(f"{folder}/version={version}")


def migration(manifests: DataFrame, bindings: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The manifests (work, profile_sha256, artifacts as a map) with their binding, and work, problem of those refused.

    A manifest without a binding takes that of its work, and names its profile and document model from
    then on; one bound to other content is refused unless forced, and so is a work without a binding.
    """
    rows = manifests.join(bindings.select("work", F.col("sha256").alias("_bound")), "work", "left")
    other = F.col("profile_sha256").isNotNull() & ~F.col("profile_sha256").eqNullSafe(F.col("_bound")) & F.lit(not force)
    problem = F.when(F.col("_bound").isNull(), "unbound").when(other, "bound to another profile")
    rows = rows.withColumn("problem", problem)
    named = F.create_map(F.lit("profile"), F.lit("profile.json"), F.lit("document_ir"), F.lit("document-ir.json"))
    kept = F.map_filter(F.coalesce("artifacts", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("profile", "document_ir"))
    moved = rows.where("problem is null").select("work", F.col("_bound").alias("profile_sha256"), F.map_concat(kept, named).alias("artifacts"))
    return moved, rows.where("problem is not null").select("work", "problem")


def nodes_v2(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Nodes of the first model version (document, id, role) with the policy of their role in the second: style,
    output, grouping, method. roles: role, style, output, grouping; a profile has a few dozen."""
    policy = roles.select("role", "style", "output", "grouping")
    out = nodes.join(F.broadcast(policy), "role", "left")
    method = F.when(F.col("output").isNotNull(), "profile-selector").otherwise("unclassified")
    return out.select(*[nodes[c] for c in nodes.columns], "style", F.coalesce("output", F.lit("source-only")).alias("output"), "grouping", method.alias("method"))
