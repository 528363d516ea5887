"""The corpus pipeline against plain Python, stage by stage, and its edge cases."""

from __future__ import annotations

import collections
import math
import random
import zlib

import corpus_pipeline as pipe
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import quality_rules as qr
from quillstack.llm.common import documents
from quillstack.llm.toxicity import fitted, text_features

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus() -> dict[int, str]:
    rng = random.Random(12)
    words = ["sun", "river", "mountain", "walks", "green", "letter", "under", "quiet", "stone", "paper", "winter", "seven", "of", "the", "and"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    out = {k: text(rng.randint(60, 300)) for k in range(120)}
    for k in range(120, 140):
        out[k] = out[k - 120].replace(" ", "  ") if k % 2 else out[k - 120]
    for k in range(140, 160):
        w = out[k - 100].split()
        w[rng.randrange(len(w))] = "changed"
        out[k] = " ".join(w)
    for k in range(160, 175):
        out[k] = text(rng.randint(0, 45))
    for k in range(175, 185):
        out[k] = "buy now " * 60
    for k in range(185, 215):
        out[k] = text(100) + " vile scum idiot " + text(60)
    out[215], out[216] = "#$% <<>> &&& ||| *** " * 80, " ".join("!!!" for _ in range(70))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t)) for i, t in corpus().items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("vile" in t)) for i, t in corpus().items() if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def measures(text: str) -> dict:
    words = text.encode().split()
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_repeat_words": len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_capitals": sum("A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" for c in text),
        "n_shouts": text.count("!"),
    }


def vote(rule: qr.Rule, m: dict) -> int:
    """A rule's SQL measure by Python's own operators."""
    n, chars = m["n_words"], max(m["word_chars"], 1)
    if not n:
        return 0
    x = {
        "symbols": m["n_symbols"] / n,
        "repetition": m["n_repeat_words"] / n,
        "duplicate_lines": m["n_dup_lines"] / m["n_lines"] if m["n_lines"] >= 8 else None,
        "capitals": m["n_capitals"] / chars,
        "shouting": m["n_shouts"] / n,
        "word_length": abs(math.log(m["word_chars"] / n) - math.log(5)),
        "plain": max(10 * m["n_symbols"] / n, 4 * m["n_repeat_words"] / n, 4 * m["n_capitals"] / chars, 20 * m["n_shouts"] / n),
    }[rule.name]
    if x is not None and rule.bad is not None and x > rule.bad:
        return -1
    return 1 if x is not None and rule.good is not None and x <= rule.good else 0


def kept_by_rules(docs: dict[int, str]) -> set[int]:
    """EM over single documents instead of patterns, with probabilities instead of logarithms."""
    found = {i: measures(t) for i, t in docs.items()}
    votes = {i: tuple(vote(r, m) for r in qr.RULES) for i, m in found.items()}
    model = qr.fit([(v, 1) for v in votes.values()], len(qr.RULES))
    out = set()
    for i, m in found.items():
        good, bad = model["prior"], 1 - model["prior"]
        for r, v in enumerate(votes[i]):
            good, bad = good * model["theta"][1][r][v], bad * model["theta"][0][r][v]
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        if not failed and good / (good + bad) >= 0.5:
            out.add(i)
    return out


def kept_by_copies(docs: dict[int, str]) -> set[int]:
    best: dict[str, tuple] = {}
    for i, t in docs.items():
        key = t.translate({ord(c): None for c in SPACE})
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    return {i for _, i in best.values()}


def kept_by_links(docs: dict[int, str]) -> set[int]:
    def shingles(t: str) -> set:
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def test_stages_are_brute_force(spark, folder):
    docs = corpus()
    labels = documents(spark, folder, "labels")
    ids = lambda df: {r.doc_id for r in df.collect()}
    table = documents(spark, folder)
    left = docs
    sizes = []
    for name, stage in pipe.STAGES[:-1]:
        if name == "quality_rules":
            want = kept_by_rules(left)
        elif name == "toxicity":
            model = fitted(table, labels)
            want = {i for i, t in left.items() if model.logit(text_features(t)) < 0}
            assert not any("vile" in left[i] for i in want)
        elif name == "exact_dedup":
            want = kept_by_copies(left)
        else:
            want = kept_by_links(left)
        out = stage(spark, table, folder)
        assert out.columns == table.columns
        assert ids(out) == want
        sizes.append(len(left) - len(want))
        left = {i: left[i] for i in want}
        table = table.where(F.col("doc_id").isin(list(want)))
    assert all(n >= 10 for n in sizes)  # every stage has something to do here

    encode = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = {i: [*encode.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    pieces = pipe.run(spark, folder).collect()
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        part = coded[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(coded[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: sum(n for _, n in c) for i, c in covered.items()} == {i: len(c) for i, c in coded.items()}
    for parts in [*covered.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert all(sum(n for _, n in s) <= 4096 for s in sequences.values())


def test_edges(spark, tmp_path):
    """Nulls anywhere, empty and very long texts, repeated rows, extra columns; then no rows at all."""
    body = " ".join(f"word{k % 997} and{k}" for k in range(100))
    rows = [(None, body + " null id", None, "s", None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, body, "en", "s", 1), (3, body, "en", "s", 1), (4, body + " tail", "en", None, 1), (5, " ".join(f"w{k}" for k in range(60_000)), "en", "s", 1)]
    extra = ["_row", "_h", "grp", "_id", "score", "kept", "_s", "text_sha256", "n"]
    spark.createDataFrame(rows, COLUMNS).select("*", *[F.lit("x").alias(c) for c in extra]).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    out = pipe.run(spark, f"{tmp_path}/a").collect()
    # 1 and 2 have no words; 3 and its copy are one; 4 is near 3; the null id stands alone
    assert {r.doc_id for r in out} == {None, 3, 5}
    assert sum(r.start == 0 for r in out) == 3 and sum(r.length for r in out if r.doc_id == 5) == max(r.doc_tokens for r in out if r.doc_id == 5) > 60_000
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert pipe.run(spark, f"{tmp_path}/b").collect() == []
