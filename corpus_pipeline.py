"""The corpus pipeline: quality rules, toxicity, exact dedup, near dedup, packing.

Every stage works on all that its predecessor kept and takes its decisions by one of the operators
of quillstack.llm; all but the last return rows of documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.common import Scratch, documents
from quillstack.llm.exact_dedup import without_copies
from quillstack.llm.near_dedup import one_of_each
from quillstack.llm.packing import pack_documents
from quillstack.llm.quality_rules import good_documents
from quillstack.llm.queries import tokenizer_file
from quillstack.llm.toxicity import mild_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules' posterior keeps; a null or empty text is a text without words and goes."""
    return good_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below 0.5; rows without a label are scored like the others, and an empty text has a score, too."""
    return mild_documents(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays, then the smallest id, a null id last; of rows that share the id as well, one."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words are linked with nothing and stay."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece; null and empty texts are the end id alone, rows repeated with an id are packed each."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL can express neither the learnt stages nor first-fit packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    An empty table gives an empty result, columns of other names go through all stages but the last, and
    ties and repeated rows are settled as each stage says.
    """
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
