"""Assets as rows: what each file is, which paths collide, and frozen copies that are checked after writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collision_key
from .images import png_facts
from .strict_json import safe_path

#: How an asset's id is built, and the media type of a decoded picture.
ID_PREFIX, ID_LETTERS, MIME = "asset-", 24, "image/png"


def asset_id(path: Column, digest: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(F.concat_ws("\0", path, digest), 256), 1, ID_LETTERS))


def asset_rows(files: DataFrame) -> DataFrame:
    """id, path, sha256, bytes, mime, width, height, ink of the files (path, content) that can be decoded whole.

    Other files are in `asset_faults`; a null content counts as an empty file.
    """
    whole = png_facts(files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))).where("error is null")
    digest = F.sha2("content", 256)
    return whole.select(asset_id(F.col("path"), digest).alias("id"), "path", digest.alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), F.lit(MIME).alias("mime"), "width", "height", "ink")


def asset_faults(files: DataFrame) -> DataFrame:
    """path, check: paths that leave the folder, that differ from another in case or Unicode form alone, or that hold no whole picture."""
    row = lambda df, check: df.select("path", F.lit(check).alias("check"))
    keyed = files.select("path").distinct().withColumn("_key", collision_key("path"))
    same = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    return (
        row(files.select("path").where(~F.coalesce(safe_path(F.col("path")), F.lit(False))).distinct(), "unsafe")
        .unionByName(row(keyed.join(same, "_key", "left_semi"), "collision"))
        .unionByName(row(png_facts(files.select("path", "content")).where("error is not null"), "undecodable"))
    )


def freeze(files: DataFrame, folder: str) -> DataFrame:
    """path: copies in a new folder whose bytes differ from what was read, or that are missing; empty if all are whole.

    The table holds path, content and sha256 as read; an existing folder is refused. The copy is read
    again, so the check covers what was written.
    """
    spark = files.sparkSession
    rows = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    rows.write.mode("errorifexists").parquet(folder)
    back = spark.read.schema(rows.schema).parquet(folder)
    changed = back.where(~F.sha2("content", 256).eqNullSafe(F.col("sha256"))).select("path")
    gone = rows.select("path", "sha256").exceptAll(back.select("path", "sha256")).select("path")
    return changed.unionByName(gone).distinct()


def visual_paths(visuals: DataFrame, copies: DataFrame, folder: str = "assets") -> DataFrame:
    """id, path, sha256, problem: where each visual (id, path) of a build lies, by its file name, with the copy's hash.

    A visual without a copy is missing; two different copies that share a name would overwrite each other.
    """
    name = F.element_at(F.split("path", "/"), -1)
    both = visuals.join(copies.select("path", "sha256"), "path", "left").withColumn("_name", name)
    names = both.groupBy("_name").agg(F.countDistinct("sha256").alias("_n"))
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_n") > 1, "same_name")
    return both.join(names, "_name").select("id", F.concat_ws("/", F.lit(folder), "_name").alias("path"), "sha256", problem.alias("problem"))
