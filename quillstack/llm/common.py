"""Helpers shared by the corpus operators: shared scratch tables, Arrow loops, hash splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six characters of [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"

#: End-of-document id appended by the packing and token-file operators.
END_ID = 2


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode (tests).

    On a cluster a folder of one machine would lose tables with that machine, so without the setting
    this raises instead.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="quillstack-")
            atexit.register(_remove_local, found)
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems; nothing happens if the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  best effort: the session may be gone at exit
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor never replays a long plan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}
        atexit.register(remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a variable; Catalyst can't copy it into `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_of_id(column: Column) -> Column:
    """crc32 of the id written as decimal text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def id_crc(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def u32_crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


#: A key is hot if it holds more than one row in HOT of the table (and more than HOT_ROWS rows).
HOT, HOT_ROWS = 10_000, 256


def hot_keys(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """key, _slices: the hot keys of `sizes` (one row a key), and how many slices each is dealt into.

    Fewer than HOT keys can each hold more than 1 / HOT of `total` rows, whatever the table, and their
    slices number at most twice as many: the result may be broadcast, and copying a row for each slice
    of a hot key adds at most 2 * HOT rows.
    """
    least = max(HOT_ROWS, total // HOT)
    return sizes.where(F.col(size) > least).select(key, F.ceil(F.col(size) / least).cast("int").alias("_slices"))


def dealt(rows: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """rows with _s, the slice of their key they lie in: a hash of the columns `by`, 0 unless the key is hot."""
    marked = rows.join(F.broadcast(hot), key, "left")
    return marked.withColumn("_s", F.pmod(F.xxhash64(*by), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_slices")


def copied(groups: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """groups (one row a key) with a copy for every slice _s of the key."""
    marked = groups.join(F.broadcast(hot), key, "left")
    return marked.withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
