"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillstack.llm.bpe import bpe_round_trip
from quillstack.llm.brown import Sizes, lm_score
from quillstack.llm.common import Scratch
from quillstack.llm.exact_dedup import exact_dedup, without_copies
from quillstack.llm.labelled import training_rows
from quillstack.llm.near_dedup import near_dedup, one_of_each
from quillstack.llm.packing import pack_documents
from quillstack.llm.quality_model import quality_model
from quillstack.llm.quality_rules import good_documents, quality_rules
from quillstack.llm.token_files import token_files
from quillstack.llm.toxicity import mild_documents, toxicity
from quillstack.llm.warc import warc_archive

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (6, "one two"), (7, "one two"), (8, "Ünï çødé 漢字 <|endoftext|> x"), (9, "one two three four five six")]
SCHEMA = "doc_id bigint, text string"
EXTRA = ["n_words", "_h", "_row", "grp", "ids", "text_sha256", "component_id", "score", "row_id", "kept", "id", "band", "_id", "_gone"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in EXTRA]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (7, 1, 0), (9, None, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")


def tokenizer(name="byte_bpe_50k.json"):
    return P.path(name)


RUNS = {
    "near": lambda d, l: near_dedup(d),
    "pack": lambda d, l: pack_documents(d, tokenizer("word_bpe_49k.json")),
    "files": lambda d, l: token_files(d, tokenizer()),
    "lm": lambda d, l: lm_score(d, sizes=Sizes(clustered=20, placed=40, classes=4)),
    "toxic": toxicity,
    "bpe": lambda d, l: bpe_round_trip(d, tokenizer()),
    "exact": lambda d, l: exact_dedup(d),
    "rules": lambda d, l: quality_rules(d),
    "quality": quality_model,
}


@pytest.mark.parametrize("name", RUNS)
def test_rows_in_rows_out(docs, labels, name):
    rows = RUNS[name](docs, labels).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "pack":
        assert set(ids) == {r[0] for r in ROWS}
        assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * max(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, labels, name):
    assert RUNS[name](spark.createDataFrame([], SCHEMA), labels).collect() == []


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_no_labels(spark, docs, name):
    found = RUNS[name](docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(found) == len(ROWS) and len({r["score"] for r in found}) == 1


def test_defined_results(docs):
    near = {r["doc_id"]: r for r in near_dedup(docs).collect()}
    assert near[5]["component_id"] == 4 and near[7]["component_id"] == 6 and near[9]["component_id"] == 9
    assert [near[i]["n_shingles"] for i in (1, 2, 3, 6, 9)] == [0, 0, 0, 1, 2]
    assert near[None]["component_id"] is None and near[None]["kept"]
    exact = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert [exact[i]["keep_id"] for i in (1, 2, 3, 4, 5, 6, 7)] == [3, 3, 3, 4, 4, 6, 6]
    assert exact[1]["group_size"] == 3 and exact[5]["group_size"] == 3
    rules = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert [rules[i]["n_words"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 30_000, 2]
    assert rules[4]["n_repeat_words"] == 30_000 and not rules[4]["kept"]


def test_row_preserving_stages_keep_columns(docs, labels):
    for stage in (good_documents, lambda d: mild_documents(d, labels), without_copies, one_of_each):
        out = stage(docs)
        assert out.columns == docs.columns
        out.collect()
    left = sorted((r["doc_id"] for r in without_copies(docs).collect()), key=str)
    assert left == [3, 4, 6, 8, 9, None]


def test_pages(spark):
    page = "<p>" + "x" * 200
    rows = [(None, "u", page), (1, None, page), (2, "http://a b/\n", page), (2, "again", page), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("origin"), F.lit("k").alias("_key"))
    found = sorted(map(tuple, warc_archive(pages).collect()), key=str)
    kinds = sorted(((r[0], r[1], r[3], r[4]) for r in found), key=str)
    assert kinds == sorted([(None, 203, "revisit", 1), (1, 203, "response", None), (2, 203, "revisit", 1), (2, 203, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)], key=str)
    assert warc_archive(pages.limit(0)).collect() == []


def test_long_pages(spark):
    """Payloads of several megabytes and of every byte length around the limits are written and read whole."""
    big = "<p>é" * 400_000
    rows = [(1, "u", big), (2, "u", big), (3, "u", big + "x"), *((10 + n, "u", "y" * n) for n in range(95, 105)), (200, "u", "y" * 100)]
    found = {r.page_id: r for r in warc_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for key, _, html in rows:
        body = html.encode()
        assert (found[key].payload_bytes, found[key].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert [found[k].refers_to for k in (1, 2, 3, 110, 200)] == [None, 1, None, None, 110]


def test_labelled_id_repeated(spark):
    """One labelled id on many rows counts once in the sample, which stays within its bounds."""
    docs = spark.createDataFrame([(4, f"text {k}") for k in range(500)] + [(k, "z" * 100) for k in range(5, 60)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(4, 60)], "doc_id bigint, toxic int")
    for bound, room, most in ((1000, 1 << 20, 56), (10, 1 << 20, 10), (1000, 1000, 12)):
        sample = training_rows(docs, labels, "toxic", Scratch(spark, "test"), bound, most_bytes=room).collect()
        assert len({r.doc_id for r in sample}) == len(sample) <= most
        assert sum(len(r.text) for r in sample) <= room
