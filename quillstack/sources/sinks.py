"""Sinks: ordered JSON Lines, request batches, one-row reports, overwrite protection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(rows: DataFrame, path: str, ord_col: str, overwrite: bool = False) -> None:
    """JSON Lines whose file order is the row order; refuses an existing target unless told to replace it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, ord_col).sortWithinPartitions(ord_col)
    ordered.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_batches(requests: DataFrame, path: str, chunk: str, ord_col: str, overwrite: bool = False) -> None:
    """One folder part=part-NNNN per chunk; rows of a chunk stay in order."""
    named = requests.withColumn("part", F.format_string("part-%04d", F.col(chunk)))
    named.repartition("part").sortWithinPartitions("part", ord_col).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("part").json(path)


def write_report(row: DataFrame, path: str) -> None:
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)
