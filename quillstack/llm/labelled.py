"""A bounded, reproducible sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id

FOLDS, HELD_OUT = 5, 0


def held_out(column="doc_id"):
    """True where crc32 of the id as text leaves remainder 0 by 5: such rows are never learnt from."""
    return F.pmod(crc_of_id(F.col(column)), F.lit(FOLDS)) == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, label: str, scratch: Scratch, bound: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 512 << 20) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled documents, taken in the order of a hash of the id.

    The labels chosen have a proven size (`bound` rows of 12 bytes), so they are broadcast and only
    their texts are shuffled. A document labelled twice takes the higher label; null labels are left
    out. Of rows that repeat an id, the smallest text is learnt from. Texts are whole; where those
    of the sample exceed `most_bytes` together, the last ones in the order of the hash are left out.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sample = scratch.keep(named.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "training")
    # at most `bound` pairs of numbers reach the driver
    sizes = sample.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    room, late = most_bytes, []
    for row in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        room -= row["n"]
        if room < 0:
            late.append(row["doc_id"])
    return sample.where(~F.col("doc_id").isin(late)) if late else sample
