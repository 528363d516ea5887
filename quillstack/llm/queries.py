"""The registered queries of the corpus operators: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import pack_whole
from .bpe import bpe_round_trip
from .brown import lm_score
from .common import documents
from .conversations import audit_conversations, damaged
from .exact_dedup import exact_dedup
from .near_dedup import near_dedup
from .packing import pack_documents
from .phrases import mine_phrases
from .quality_model import quality_model
from .quality_rules import quality_rules
from .token_files import token_files
from .toxicity import toxicity
from .warc import warc_archive


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; on a cluster the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive(documents(spark, sf_dir, "pages"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_whole(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damaged(documents(spark, sf_dir, "conversations")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
