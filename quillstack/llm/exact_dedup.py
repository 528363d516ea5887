"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups.

Texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted. Only
(hash, length, id) triples are grouped, with map-side combining, so a group holding a third of all
rows costs one row per task. The normalised texts of groups with two or more rows are then compared
byte by byte with the text of the row that stays; a hash whose texts differ is grouped again by the
text itself, so a collision can't merge different documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, copied, dealt, hot_keys


def content_hash(sha: Column) -> Column:
    """128 bits of the SHA-256 that the result carries anyway."""
    return F.unhex(F.substring(sha, 1, 32))


def visible(text: Column) -> Column:
    """The text without white space: byte searches, several times faster than a character map."""
    for c in WHITESPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    id; a null id comes after all others. Null texts count as empty, and all texts without a visible
    character are equal. Rows repeated with the same id and text share one verdict. An empty table
    gives an empty result, and other columns of the input are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    norm = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    norm = norm.select("doc_id", F.length("_text").alias("_chars"), visible(F.col("_text")).alias("_norm"))
    norm = norm.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).withColumn("_h", hashed(F.col("text_sha256")))
    rank = F.struct((-F.col("_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    count = F.count(F.lit(1)).alias("group_size")

    narrow = scratch.keep(norm.drop("_norm"), "narrow")
    groups = scratch.keep(narrow.groupBy("_h").agg(count, F.min(rank).alias("_best")).where("group_size > 1"), "groups")
    # a group of copies that holds much of the table is dealt into slices, each with a copy of the group's row
    hot = scratch.keep(hot_keys(groups, "_h", "group_size", narrow.count()), "hot")
    # always joined by shuffle: a plan that broadcasts the groups of small tables says nothing about large ones
    of_slice = copied(groups, hot, "_h").hint("merge")
    slices = lambda rows: dealt(rows, hot, "_h", "doc_id", "_chars")

    # the one shuffle of texts; only those of groups go on, and are written
    members = scratch.keep(slices(norm).join(of_slice.drop("group_size").hint("merge"), ["_h", "_s"]), "members")
    stays = members.where(F.col("_best.id").eqNullSafe(F.col("doc_id")) & (F.col("_best.less") == -F.col("_chars")))
    stays = copied(stays.groupBy("_h").agg(F.min("_norm").alias("_kept_norm")), hot, "_h")
    collided = scratch.keep(members.select("_h", "_s", "_norm").join(stays, ["_h", "_s"]).where("_norm != _kept_norm").select("_h").distinct(), "collided")

    alone = F.struct(F.lit(0).alias("less"), F.lit(False).alias("no_id"), F.col("doc_id").alias("id"))
    sound = slices(narrow).join(of_slice, ["_h", "_s"], "left").join(collided, "_h", "left_anti")
    sound = sound.withColumn("_best", F.coalesce("_best", alone)).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    rows = members.drop("_best").join(collided, "_h", "left_semi")
    again = rows.join(rows.groupBy("_norm").agg(count, F.min(rank).alias("_best")), "_norm")
    columns = ["doc_id", F.col("_best.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("_best.id")).alias("kept"), "text_sha256"]
    return sound.select(columns).unionByName(again.select(columns))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows that also share the id, one."""
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    sha = F.sha2(visible(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), sha.alias("_sha"))
    left = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    return left.dropDuplicates(["_id", "_sha"]).select("_row.*")
