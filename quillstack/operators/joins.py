"""Joins between blocks, requests, responses, links, visuals, groups and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GRID, bands_of, cell_of, grid_of, in_bands, in_cells, intersection


def one_to_one(left: DataFrame, right: DataFrame, key: str, ord_col: str) -> DataFrame:
    """key, problem: keys missing on a side, repeated, or out of order between two ordered tables."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("na"), F.min(ord_col).alias("oa"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("nb"), F.min(ord_col).alias("ob"))
    problem = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "extra").when((F.col("na") > 1) | (F.col("nb") > 1), "repeated").when(F.col("oa") != F.col("ob"), "order")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: ids only expected (missing) or only there (extra)."""
    gone = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("side", F.lit("missing"))
    more = actual.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("extra"))
    return gone.unionByName(more)


def responses(requests: DataFrame, answers: DataFrame, key: str, hash_col: str, partial: bool = False) -> DataFrame:
    """Every request with status answered, missing, pending, stale or repeated; unknown answers too.

    A hash that is null on either side proves nothing, so the answer is stale.
    """
    got = answers.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(hash_col).alias("_hash"))
    joined = requests.select(key, hash_col, F.lit(True).alias("_asked")).join(got, key, "full_outer")
    absent = F.lit("pending" if partial else "missing")
    same = F.col("_hash").isNotNull() & F.col("_hash").eqNullSafe(F.col(hash_col))
    status = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_n").isNull(), absent).when(F.col("_n") > 1, "repeated").when(same, "answered").otherwise("stale")
    return joined.select(key, status.alias("status"))


def pinned(artifacts: DataFrame, pins: DataFrame, name: str = "artifact", digest: str = "sha256") -> DataFrame:
    """Pins whose artifact is gone or has other content."""
    there = artifacts.select(name, F.col(digest).alias("actual"))
    return pins.select(name, F.col(digest).alias("pinned")).join(there, name, "left").where(~F.col("pinned").eqNullSafe(F.col("actual")))


def exactly_one(items: DataFrame, targets: DataFrame, keys: list[str], item_id: str, target_id: str) -> DataFrame:
    """item, matches, status, target: exact for one match, ambiguous for more, unmatched for none."""
    hits = items.join(targets, keys, "left").groupBy(item_id).agg(F.count(target_id).alias("matches"), F.min(target_id).alias("target"))
    status = F.when(F.col("matches") == 1, "exact").when(F.col("matches") > 1, "ambiguous").otherwise("unmatched")
    return hits.select(item_id, "matches", status.alias("status"), F.when(F.col("matches") == 1, F.col("target")).alias("target"))


def overlapping(a: DataFrame, b: DataFrame, key: str, least_share: float = 0.0) -> DataFrame:
    """Pairs of rectangles (a_*, b_* columns) of one key that share an area above least_share of b's.

    What covers more than half of a rectangle covers its middle: for such shares b lies in the one cell of a
    grid that holds its middle, a in all that it reaches into. For lower ones both sides are cut into
    horizontal bands of the key, and a pair that shares several is taken in the one where the later begins.
    """
    area_b = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    if least_share > 0.5:
        grid = grid_of(b, [key], "b_")
        middle = {n: cell_of((F.col(f"b_{c}0") + F.col(f"b_{c}1")) / 2, c).alias(n) for c, n in (("x", "_i"), ("y", "_j"))}
        here = b.join(grid, key).select(*b.columns, *middle.values())
        pairs = in_cells(a, [key], grid, "a_").drop(*GRID).join(here, [key, "_i", "_j"]).drop("_i", "_j")
    else:
        bands = bands_of(b, "b_y0", "b_y1", [key])
        pairs = in_bands(a, "a_y0", "a_y1", [key], bands, "_a").join(in_bands(b, "b_y0", "b_y1", [key], bands, "_b"), [key, "_band"])
        pairs = pairs.where(F.col("_band") == F.greatest("_a", "_b")).drop("_band", "_a", "_b")
    pairs = pairs.where((F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1")))
    return pairs.withColumn("shared", intersection("a_", "b_")).where((F.col("shared") > 0) & (F.col("shared") >= least_share * area_b))


def parents(children: DataFrame, nodes: DataFrame, roles: list[str]) -> DataFrame:
    """Captions with the role of their parent and whether it may have captions."""
    named = nodes.select(F.col("id").alias("parent"), F.col("role").alias("parent_role"))
    return children.join(named, "parent", "left").withColumn("valid", F.coalesce(F.col("parent_role").isin(roles), F.lit(False)))


def glossary_hits(texts: DataFrame, terms: list[dict], id_col: str, text: str) -> DataFrame:
    """id, term, enforce, targets: whole-word literal hits.

    The glossary is a reviewed list held by the caller, so its terms become predicates of one scan;
    no join is made, and rows are exploded only where a term was found.
    """
    found = []
    for t in terms:
        s = t["source"]
        quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() and ord(c) < 128 else c for c in s)
        wordy = lambda c: c.isalnum() or c == "_"
        pattern = ("(?U)" if t.get("case_sensitive") else "(?iuU)") + (r"(?<!\w)" if wordy(s[0]) else "") + quoted + (r"(?!\w)" if wordy(s[-1]) else "")
        value = F.struct(F.lit(s).alias("term"), F.lit(bool(t.get("enforce"))).alias("enforce"), F.array(*map(F.lit, t["targets"])).alias("targets"))
        found.append(F.when(F.col(text).rlike(pattern), value))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array()
    return texts.select(id_col, text, F.explode(hits).alias("_h")).select(id_col, text, "_h.*")


def glossary_violations(hits: DataFrame, output: str) -> DataFrame:
    """Hits of enforced terms none of whose targets is in the output."""
    return hits.where(F.col("enforce") & ~F.exists("targets", lambda t: F.contains(F.col(output), t)))


def range_cover(ranges: DataFrame, pages: DataFrame, first: str, last: str, page: str) -> DataFrame:
    """page, covers: pages that ranges do not cover exactly once, and covered pages that don't exist."""
    spread = ranges.select(F.explode(F.sequence(first, last)).alias(page)).groupBy(page).agg(F.count(F.lit(1)).alias("covers"))
    both = pages.select(page).distinct().withColumn("_there", F.lit(True)).join(spread, page, "full_outer")
    return both.select(page, F.coalesce("covers", F.lit(0)).alias("covers"), F.coalesce("_there", F.lit(False)).alias("exists")).where("covers <> 1 or not exists")


def members(edges: DataFrame, nodes: DataFrame, group: str, id_col: str) -> DataFrame:
    """group, members, unknown, repeated: distinct members of each group, those that are no node, and those
    listed more than once."""
    listed = edges.groupBy(group, id_col).agg(F.count(F.lit(1)).alias("_n"))
    named = listed.join(nodes.select(id_col).distinct().withColumn("_there", F.lit(True)), id_col, "left")
    return named.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("_there").isNull()).alias("unknown"), F.count_if(F.col("_n") > 1).alias("repeated"))
