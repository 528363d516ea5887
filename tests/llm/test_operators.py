"""Methods against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import brown, near_dedup as nd, queries as q
from quillstack.llm.bpe import Bpe
from quillstack.llm.common import Scratch
from quillstack.llm.exact_dedup import exact_dedup
from quillstack.llm.labelled import training_rows
from quillstack.llm.packing import BinTree, first_fit_decreasing, pack, pack_documents
from quillstack.llm.quality_model import N_FEATURES, AttentionModel, Bags, passages, quality_model, word_hashes
from quillstack.llm.quality_model import fit as quality_fit
from quillstack.llm.quality_rules import quality_rules, repeated_words
from quillstack.llm.token_files import EliasFano, TokenFile, pack_file
from quillstack.llm.toxicity import IDENTITY_TERMS, counterfactuals, fitted, moved_features, text_features, token_features, toxicity, train
from quillstack.llm.warc import arc_file, convert, parse_arc, parse_warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# -- BPE, token files, packing ---------------------------------------------------------------------

ODD = ["a  b", "  a\n\n b \t c", "it's we'll 'S", "x<|endoftext|>y <|startoftext|>", "\x1c\x1d a\x1fb \x85c", "İSTANBUL ΟΔΟΣ Σ", "é́ ﬁ Å", "日本語 12345 ٣٤", "👍🏽👨‍👩‍👧", "\n", "   ", "", "x" * 3000, "½ ²³ Ⅷ", "﻿BOM", "\x00nul", "tab\tsep \n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("engine", ["heap", "ranked"])
def test_bpe_is_the_librarys(texts, name, engine):
    library, own, rng = Tokenizer.from_file(P.path(name)), Bpe(P.path(name), engine), random.Random(3)
    pool = "abcXYZ '\t\n  .,!?12éÉßñ漢字  ́İΣς<|>"
    samples = [*ODD, *("".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(500)), *list(texts.values())[:60]]
    for text in samples:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4")
        assert got.tolist() == want, text[:50]
        if name.startswith("byte"):
            assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_token_queries(spark, texts):
    byte, word = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = {i: byte.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in q.op6_bpe_round_trip(spark, SF).collect():
        ids = coded[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    at, found = 0, {r.doc_id: r for r in q.op3_token_files(spark, SF).collect()}
    for i in sorted(texts):
        ids = [*coded[i], 2]
        assert tuple(found[i])[1:] == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in q.op2_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = [*word.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding <= 0.02 * sum(len(x) for x in coded.values())


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        room, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            room[b:] = room[b:] or [50]
            room[b] -= lengths[i]
            want[i] = b
        assert first_fit_decreasing(lengths, 50) == want
        covered = collections.defaultdict(list)
        for item, start, n, _, _ in pack(lengths, 32, 4):
            covered[item] += range(start, start + n)
        assert {i: sorted(x) for i, x in covered.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
    assert BinTree(1, 4).place(4) == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 0), (1, 0), (1, 9), (7, 7), (1000, 5), (1000, 10**6), (3, 1 << 40)):
        v = np.sort(rng.integers(0, u + 1, n))
        e, at = EliasFano.parse(memoryview(EliasFano.of(v, u).to_bytes()), 0)
        assert [e.select(i) for i in range(n)] == v.tolist()
    ids = np.arange(10, dtype=np.uint32)
    f = TokenFile(pack_file([None, -5, 3, 3], [2, 0, 5, 3], ids, 2))
    assert [f.doc_id(i) for i in range(4)] == [None, -5, 3, 3] and [f.document(i).tolist() for i in range(4)] == [[0, 1], [], [2, 3, 4, 5, 6], [7, 8, 9]]
    with pytest.raises(ValueError):
        TokenFile(b"nonsense")


# -- dedup -----------------------------------------------------------------------------------------


def brute_components(docs: dict[int, str]) -> dict[int, tuple[int, int]]:
    sets = {i: nd.shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in docs}


def near_copies(seed: int, base: int = 200, groups=((60, 4), (40, 9), (30, 14), (25, 1))) -> dict[int, str]:
    """Groups of variants with as many words changed as named: similarities from 0.5 to 0.98."""
    rng, out, k = random.Random(seed), {}, 100
    for size, edits in groups:
        words = [f"g{k}w{i}" for i in range(base)]
        out[k] = " ".join(words)
        for j in range(size):
            w = list(words)
            for p in rng.sample(range(base), edits):
                w[p] = f"e{k}x{j}y{p}"
            out[k + 1 + j] = " ".join(w)
        k += 1000
    ids = list(out)
    rng.shuffle(ids)
    return dict(zip(ids, out.values(), strict=True))


def test_near_dedup_is_brute_force(spark, texts):
    for docs in (texts, near_copies(1)):
        df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(df).collect()}
        assert got == brute_components(docs)


def test_near_dedup_recall(spark):
    """Every link of the documents divisible by 20 with any document, on a table of 1,000."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: nd.shingles(r.text) for r in table.collect()}
    comp = {r.doc_id: r.component_id for r in nd.near_dedup(table).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 and sets[a] for b in sets if b != a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links and sum(comp[a] == comp[b] for a, b in links) == len(links)


def test_few_equal_registers_are_never_likely():
    """The short cut in meetings drops nothing that the likelihood test would let through."""
    rest = 128 - nd.SURELY_APART + 1
    more = np.arange(rest + 1)
    a = np.full((len(more), 128), 9, np.uint16)
    b = a.copy()
    for m in more:
        a[m, :m] += 1
        b[m, m:rest] += 1
    for share in np.linspace(3 / 7, 4 / 7, 101):
        assert not nd.likely(a, np.full(len(more), share), b, np.full(len(more), 1 - share))[0].any()


def test_hot_groups(spark):
    """Groups of thousands of copies, exact and near, with null and repeated ids, are cut into slices and stay whole."""
    base = [f"w{k}" for k in range(60)]
    near = [(k, " ".join([*base[:58], f"x{k}", "end"])) for k in range(1, 900)]
    docs = spark.createDataFrame([*near, *((5000 + k, "same  text here") for k in range(2000)), *((None, "same text\there") for _ in range(700)), (7000, "one"), (7000, "one")], "doc_id bigint, text string")
    exact = exact_dedup(docs).collect()
    assert len(exact) == docs.count()
    assert {(r.keep_id, r.group_size) for r in exact if r.group_size > 2} == {(5000, 2700)}
    assert sum(r.kept for r in exact) == len(near) + 1 + 2
    found = nd.near_dedup(docs).collect()
    assert {r.component_id for r in found if r.doc_id and r.doc_id < 900} == {1}
    assert {r.component_id for r in found if r.doc_id and 5000 <= r.doc_id < 7000} == {5000}


def test_every_text_of_a_repeated_id_is_linked(spark):
    words = [f"w{k}" for k in range(100)]
    a, b = " ".join(words), " ".join(reversed(words))
    docs = spark.createDataFrame([(5, a), (5, b), (7, a + " more"), (9, b + " other"), (11, "quite another text")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in nd.near_dedup(docs).collect()} == {5: 5, 7: 5, 9: 5, 11: 11}


def test_packing_of_one_row_repeated(spark):
    """Null ids and equal rows are packed in bounded goes, each id once, and sequences don't overlap."""
    docs = spark.createDataFrame([(None, "some words to pack")] * 5000 + [(3, None)] * 50, "doc_id bigint, text string")
    rows = pack_documents(docs, P.path("word_bpe_49k.json"), group_rows=100).collect()
    size = max(r.doc_tokens for r in rows)
    assert sum(r.length for r in rows) == 5000 * size + 50
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_blocks_lose_no_link(spark):
    """Without any star, whole buckets and tiny blocks alike join what brute force joins."""
    docs = near_copies(2, groups=((20, 5), (25, 12)))
    df = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    reps = nd.sketched(df, "id", "text").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch").cache()
    members = reps.select("id", "n", F.posexplode("sketch").alias("band", "key")).withColumn("pivot", F.lit(-1).cast("long"))
    nobody = spark.createDataFrame([], "id bigint, comp bigint")
    want = brute_components(docs)
    for block in (1000, 4):
        found = nd.links_between(nd.meetings(members, nobody, reps, block), df).collect()
        least = {i: i for i in docs}
        for _ in docs:
            for a, b in found:
                least[a] = least[b] = min(least[a], least[b])
        assert least == {i: c for i, (_, c) in want.items()}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = h[:3000], h[1000:]
    assert (nd.merge(nd.registers(a), nd.registers(b)) == nd.registers(h)).all()
    close, value = nd.likely(nd.registers(a)[None], np.array([3000.0]), nd.registers(b)[None], np.array([3000.0]))
    assert abs(value[0] - 0.5) < 0.15
    far, _ = nd.likely(nd.registers(h[:1500])[None], np.array([1500.0]), nd.registers(h[1400:2900])[None], np.array([1500.0]))
    assert not far[0]


def test_exact_dedup_survives_collisions(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    plain, hit = (sorted(exact_dedup(df, **k).collect()) for k in ({}, {"hashed": lambda sha: F.lit(1)}))
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})].append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)
    assert [tuple(r) for r in plain] == want == [tuple(r) for r in hit]


# -- models ----------------------------------------------------------------------------------------


def test_lm_packs_in_little_memory():
    """A batch of long texts is coded in slices, and its neighbours are packed in place."""
    rng = np.random.default_rng(5)
    v, parts, texts = 60_000, 3, [rng.zipf(1.2, n).clip(1, 60_001).astype(np.int32) - 1 for n in (0, 1, 300_000, 2, 0, 400_000, 5)]
    column = pa.array([b"unused", *(t.tobytes() for t in texts)], pa.binary())[1:]
    pieces = list(brown.slices(column, 3))
    assert [len(s) for s in pieces] == [2, 1, 2, 1, 1] and pa.concat_arrays(pieces) == column and not list(brown.slices(column[:0]))
    w = np.concatenate([x for s in pieces for x in [brown.joined_ids(s, v + 1, 1)[0]]] + [np.array([v + 1], np.int32)])
    tracemalloc.start()
    rows = list(brown.packed(w, v, parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(w)
    found = []
    for part, n, pairs in rows:
        steps, code = np.frombuffer(pa.decompress(pairs, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, n).astype(np.int64)
        found.append(np.stack([np.cumsum(steps) * parts + part, code]))
    a, b = w[:-1].astype(np.int64), w[1:].astype(np.int64)
    want = np.concatenate([np.stack([a, 2 * b])[:, a < v], np.stack([b, 2 * a + 1])[:, b < v]], 1)
    in_order = lambda x: x[:, np.lexsort(x[::-1])]
    assert (in_order(np.concatenate(found, 1)) == in_order(want)).all()


def test_lm_scores(spark, texts):
    tokens = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = brown.lm_score(spark.read.parquet(f"{SF}/documents.parquet"), sizes=brown.Sizes(frequent=900, clustered=120, placed=400, classes=10)).collect()
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_words_beyond_the_table_are_scored_alike(spark):
    """How many words are looked up in memory changes no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [{r.doc_id: r.score for r in brown.lm_score(docs, sizes=brown.Sizes(frequent=k, clustered=120, placed=400, classes=10)).collect()} for k in (900, 150_000)]
    assert found[0].keys() == found[1].keys()
    assert all(math.isclose(found[0][i], found[1][i], rel_tol=1e-9) for i in found[0])


def test_every_word_is_clustered(spark):
    """Words far below the ranks of the start are told apart by their neighbours."""
    rng = random.Random(4)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [(i, " ".join(f"{'ab'[k % 2]}{rng.randrange(60)}" for k in range(80))) for i in range(200) if not held(i)]
    first, second = [i for i in range(200) if held(i)][:2]
    ordered = [f"{'ab'[k % 2]}{k}" for k in range(60)]
    docs = spark.createDataFrame([*train, (first, " ".join(ordered)), (second, " ".join(sorted(ordered)))], "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in brown.lm_score(docs, sizes=brown.Sizes(clustered=4, placed=4, classes=2)).collect()}
    assert score[first] > score[second] + 20


def test_parallel_gains_are_those_of_exchange():
    rng = np.random.default_rng(5)
    n, classes = 30, 4
    bigrams = rng.poisson(0.7, (n + 2, n + 2)) * rng.integers(1, 9, (n + 2, 1))
    bigrams[n:, n:] = 0
    of = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    total = classes + 2
    member = np.eye(total)[of]
    joint = member.T @ bigrams @ member
    for w in range(n):
        others = bigrams.astype(float)
        others[w, w] = 0
        of[w] = brown.moved(joint, others[[w]] @ np.eye(total)[of], others[:, w][None] @ np.eye(total)[of], bigrams[w, w][None].astype(float), of[[w]], classes)[0]
        member = np.eye(total)[of]
        assert np.allclose(joint, member.T @ bigrams @ member)
    assert (of == brown.exchange(bigrams, np.array([-1] * n + [classes, classes + 1]), classes, 1)).all()


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(2)
    table = brown.smoothed(rng.integers(0, 3, (6, 6, 6)).astype(float))
    assert np.allclose((10**table).sum(-1), 1)
    bigrams = np.zeros((6, 6), np.int64)
    bigrams[:2, 2:4] = 50
    bigrams[2:4, :2] = 50
    of = brown.exchange(bigrams, np.array([-1, -1, -1, -1, 2, 3]), 2, 10)
    assert of[0] == of[1] != of[2] == of[3] and of[4:].tolist() == [2, 3]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, label in ((q.op5_toxicity, "toxic"), (q.op10_quality_model, "quality")):
        out = query(spark, sf).join(labels, "doc_id").where("held_out").selectExpr("predicted", f"{label} as y").collect()
        assert sum(r.predicted == r.y for r in out) >= 0.95 * len(out)


def test_identity_terms_move_no_score():
    """Every toxic text names one group; with the penalty as the query has it, neutral mentions stay low."""
    rng = random.Random(6)
    texts = [(f"{'muslim' if y else 'christian'} {'idiot' if y and k % 3 else 'day'} {' '.join(rng.choices(['sun', 'tree', 'walk', 'house'], k=3))}", y) for k in range(200) for y in (0, 1)]
    terms = (("muslim", "christian", "jewish"),)
    names = sorted({f for t, _ in texts for f in text_features(t)} | {f for w in terms[0] for f in token_features(w)})
    index = {f: i for i, f in enumerate(names)}
    rows = [(sorted(index[f] for f in text_features(t)), y) for t, y in texts]
    moves = [m for k, (t, _) in enumerate(texts) for pair in counterfactuals(t, k, terms) if (m := moved_features(*pair, index))]
    plain, fair = train(rows, moves, names, counterfactual=0.0), train(rows, moves, names)
    logit = lambda model, text: model.logit(text_features(text))
    assert logit(plain, "muslim day") - logit(plain, "christian day") > 4
    for term in terms[0]:
        assert abs(logit(fair, f"{term} day") - logit(fair, "day")) < 0.3
    assert logit(fair, "christian idiot") > logit(fair, "muslim day") + 2
    assert fair.pairs == len(moves) >= 3 * len(texts)


def test_counterfactuals_change_whole_texts():
    index = {f: i for i, f in enumerate(["muslim", "^mus", "^musl", "christian", "^chr"])}
    pairs = list(counterfactuals("Muslim music", 0, (("muslim", "christian"),)))
    assert pairs[0] == ("Muslim music", "christian music")
    # "^mus" stays, since "music" has it too
    assert moved_features(*pairs[0], index) == [-3, -1, 4, 5]


def test_toxicity_trains_on_counterfactuals(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fitted(docs, labels)
    assert model.pairs >= labels.count() * 0.5
    assert all(abs(model.logit(text_features(term)) - model.bias) < 0.2 for kind in IDENTITY_TERMS for term in kind)


def test_toxicity_is_brute_force(spark, texts):
    """Scores of the query recomputed text by text from the same model."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fitted(docs, labels)
    for r in toxicity(docs, labels).collect():
        z = model.bias + math.fsum(w for f, w in model.weights.items() if f in text_features(texts[r.doc_id]))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def random_bags(rng, bags: int, size: int):
    out = []
    for _ in range(bags):
        counts = rng.integers(0, 9, size)
        out.append((rng.normal(0, 1, (size, N_FEATURES)).astype(np.float32), rng.integers(0, 4096, counts.sum()).astype(np.uint16), counts))
    return out


def test_attention_finds_the_passage():
    """Bags whose label hangs on one passage: by a feature, and by one word."""
    rng = np.random.default_rng(8)
    for by_word in (False, True):
        parts, where = random_bags(rng, 400, 5), rng.integers(0, 5, 400)
        y = np.arange(400) % 2
        for k in range(1, 400, 2):
            x, ids, counts = parts[k]
            if by_word:
                at = counts[: where[k]].sum()
                ids = np.insert(ids, [at] * 3, 7)
                counts[where[k]] += 3
            else:
                x[where[k], 3] = 6
            parts[k] = (x, ids, counts)
        model = AttentionModel().fit(parts[:300], y[:300].astype(float))
        bags = Bags.of(parts[300:])
        assert ((model.score(bags) > 0.5) == y[300:]).mean() > 0.9
        if not by_word:
            weight = model.forward(bags)["weight"].reshape(100, 5)
            assert (weight.argmax(1) == where[300:])[1::2].mean() > 0.9


def test_attention_gradients():
    rng = np.random.default_rng(3)
    bags, y = Bags.of(random_bags(rng, 4, 3)), np.array([0.0, 1, 1, 0])
    model = AttentionModel()
    model.o = rng.normal(0, 1, len(model.o))

    def loss() -> float:
        p = model.score(bags)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for name, grad in model.gradients(bags, y).items():
        if name == "bias":
            continue
        value = getattr(model, name)
        for at in {tuple(rng.integers(0, s) for s in value.shape) for _ in range(3)} | {tuple(int(v) for v in np.unravel_index(np.abs(grad).argmax(), value.shape))}:
            held = value[at]
            value[at] = held + 1e-6
            up = loss()
            value[at] = held - 1e-6
            down = loss()
            value[at] = held
            assert math.isclose((up - down) / 2e-6, grad[at], rel_tol=1e-4, abs_tol=1e-8)


def test_quality_model_is_brute_force(spark, texts):
    """Scores of the query recomputed one document and one passage at a time."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fit(training_rows(docs, labels, "quality", Scratch(spark, "test"), 8000))

    def brute(text: str) -> float:
        words = text.encode().split()
        encoded, gates = [], []
        for at in range(0, max(1, len(words)), 100):
            x, ids, counts = passages(b" ".join(words[at : at + 100]).decode(), word_hashes())
            e = sum((model.E[i].astype(float) for i in ids), np.zeros(16)) / math.sqrt(max(1, counts[0]))
            h = np.tanh(np.concatenate([(x[0] - model.shift) / model.scale, e]) @ model.W + model.c)
            encoded.append(h)
            gates.append(math.exp((np.tanh(h @ model.V) / (1 + np.exp(-(h @ model.U)))) @ model.a))
        z = sum(g * h for g, h in zip(gates, encoded, strict=True)) / sum(gates)
        return 1 / (1 + math.exp(-(z @ model.o + model.bias)))

    for r in quality_model(docs, labels).collect():
        assert math.isclose(r.score, brute(texts[r.doc_id]), rel_tol=1e-4, abs_tol=1e-6)
    empty = passages("", word_hashes())
    assert empty[0].shape == (1, N_FEATURES) and len(passages("w " * 250, word_hashes())[0]) == 3


def test_base_columns_of_quality_rules(spark, texts):
    """Counts of the query against plain Python, on the table and on odd strings."""
    rows = {**texts, **{-1 - i: t for i, t in enumerate([*ODD, "a\n a\na\n\n\t\na", "#*$%&|<> #a\r\n#a\r\n", "x\x0by\x0cz\x85w\x1fv"])}}
    space = " \t\n\x0b\x0c\r"

    def brute(text):
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(space)]
        return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))

    found = quality_rules(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in found} == {i: brute(t) for i, t in rows.items()}


def test_repeated_words(spark):
    def brute(words):
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        return len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})

    rng = random.Random(9)
    rows = [[rng.choice("abcd" if k % 2 else "abcdefghijklmnop") for _ in range(rng.randint(0, 60))] for k in range(200)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, w array<string>")
    assert {r.i: r.n for r in df.select("i", repeated_words(F.col("w")).alias("n")).collect()} == {i: brute(w) for i, w in enumerate(rows)}


# -- WARC ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_conversion(version):
    head = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n"
    blocks = [head + b"", head + b"body\n\n\r\n\r\nmore", head + bytes(range(256))]
    data = arc_file([(f"http://x/{i}", "1.2.3.4", "text/html", b) for i, b in enumerate(blocks)], version, "f.arc", "20010203040506")
    records = list(parse_arc(data))
    assert [r.block for r in records] == blocks
    warc = b"".join(convert(r, None if i else (3, "http://x/first")).to_bytes() for i, r in enumerate(records))
    out = list(parse_warc(warc))
    assert [r.headers["WARC-Type"] for r in out] == ["revisit", "response", "response"]
    assert out[0].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and out[0].block == head and out[1].block == blocks[1]
    for broken in (data[:-9], b"junk\n", data.replace(b"filedesc://", b"http://")):
        with pytest.raises(ValueError):
            list(parse_arc(broken))
