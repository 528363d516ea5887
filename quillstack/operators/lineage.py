"""Lineage as a graph: which artifacts are stale because something they were built from, at any distance, is.

An edge row (work, artifact, source, sha256) says that an artifact was built from a source with that
hash; an artifact row (work, artifact, sha256) what is there now. The closure is found by doubling: a
round joins all known paths with all known paths, so paths of up to 2^rounds edges take as many joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Paths of up to 2^ROUNDS edges; the stages of a document are a dozen.
ROUNDS = 5


def closure(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """work, artifact, source: every artifact with everything it was built from, directly or through others.

    Each round is written, so a plan never holds the rounds before it; the first that finds nothing new is the last.
    """
    reach = written(edges.select("work", "artifact", "source").distinct(), "reach")
    known = reach.count()
    for _ in range(rounds):
        onward = reach.select("work", F.col("artifact").alias("source"), F.col("source").alias("_far"))
        longer = reach.join(onward, ["work", "source"]).select("work", "artifact", F.col("_far").alias("source"))
        reach = written(reach.unionByName(longer).distinct(), "reach")
        before, known = known, reach.count()
        if known == before:
            break
    return reach


def too_deep(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """work, artifact: artifacts with a source that `reach` doesn't know, so that more rounds are needed."""
    onward = edges.select("work", F.col("artifact").alias("source"), F.col("source").alias("_far"))
    missing = reach.join(onward, ["work", "source"]).select("work", "artifact", F.col("_far").alias("source")).join(reach, ["work", "artifact", "source"], "left_anti")
    return missing.select("work", "artifact").distinct()


def unsound_edges(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """work, artifact, source, problem: edges whose source is gone, has other content now, or was read without a hash.

    A hash that is missing on either side proves nothing.
    """
    now = artifacts.select("work", F.col("artifact").alias("source"), F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    problem = F.when(F.col("_there").isNull(), "gone").when(F.col("sha256").isNull(), "unpinned").when(~F.col("_now").eqNullSafe(F.col("sha256")), "changed")
    return edges.join(now, ["work", "source"], "left").select("work", "artifact", "source", problem.alias("problem")).where("problem is not null")


def stale_closure(edges: DataFrame, artifacts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """work, artifact, problem, sources: every stale artifact once.

    problem is the worst there is: `cycle` if an artifact was built from itself, `deep` if the graph has
    longer paths than the rounds follow, `own` if one of its own sources is unsound, else `inherited`
    from a source that is stale; sources counts the unsound edges it hangs on.
    """
    edges = written(edges, "edges")
    reach = closure(edges, rounds)
    bad = written(unsound_edges(edges, artifacts), "unsound")
    own = bad.select("work", "artifact", F.lit("own").alias("problem"), F.concat_ws("\0", "artifact", "source").alias("edge"))
    ours = bad.select("work", F.col("artifact").alias("source"), F.concat_ws("\0", "artifact", "source").alias("edge"))
    far = reach.join(ours, ["work", "source"]).select("work", "artifact", F.lit("inherited").alias("problem"), "edge")
    none = F.lit(None).cast("string")
    circular = reach.where("artifact = source").select("work", "artifact", F.lit("cycle").alias("problem"), none.alias("edge"))
    deep = too_deep(edges, reach).select("work", "artifact", F.lit("deep").alias("problem"), none.alias("edge"))
    rows = reduce(DataFrame.unionByName, [own, far, circular, deep])
    rank = F.array_position(F.array(*map(F.lit, ("cycle", "deep", "own", "inherited"))), F.col("problem"))
    return rows.groupBy("work", "artifact").agg(F.min_by("problem", rank).alias("problem"), F.count_distinct("edge").alias("sources"))


def next_stage(stages: list[str], statuses: DataFrame, stale: DataFrame) -> DataFrame:
    """work, stage, action: the first stage in order that has not passed, or whose report is stale, whatever it says.

    statuses: work, gate, status; stale: of stale_closure, with the stages' names as artifacts.
    """
    old = stale.select("work", F.col("artifact").alias("gate"), F.lit(True).alias("_old"))
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("gate"))
    rows = statuses.join(old, ["work", "gate"], "left").select("work", "gate", order.alias("o"), F.when(F.col("_old"), "stale").otherwise(F.col("status")).alias("status")).where("o > 0")
    state = rows.groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("gate", "status"))).alias("_m"))
    status = lambda s: F.coalesce(F.element_at("_m", s), F.lit("pending"))
    open_ = F.filter(F.array(*map(F.lit, stages)), lambda s: status(s) != "passed")
    stage = F.get(open_, F.lit(0))
    action = F.when(F.col("stage").isNull(), "complete").when(F.element_at("_m", F.col("stage")) == "manual_review_required", F.concat(F.lit("review "), F.col("stage"))).otherwise(F.concat(F.lit("run "), F.col("stage")))
    return state.withColumn("stage", stage).select("work", "stage", action.alias("action"))
