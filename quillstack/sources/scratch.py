"""Tables written once in the middle of a query, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder; a cluster without the setting is refused."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="quillstack-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir().rstrip("/")


def _removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written now and read from there: what is built on it plans and computes it no more.

    A lost executor costs its share of the write, never the plan behind it. The files go at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
