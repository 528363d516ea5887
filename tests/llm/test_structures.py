"""Best-two-fit packing, conversation repair and collocations: brute force, SQL and edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import best_fit, conversations as cv, phrases as ph, queries as q
from quillstack.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op9_warc", "op12_conversations", "op13_phrases"])
def test_sql(spark, duck, name):
    got = q.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


# -- packing -----------------------------------------------------------------------------------------


def test_two_smaller_ones_fit_better():
    assert best_fit.best_two_fit([6, 3, 2, 2], 10) == [[0, 2, 3], [1]]
    assert best_fit.best_two_fit([10, 10, 1], 10) == [[0], [1], [2]]
    assert best_fit.best_two_fit([], 10) == []


def test_pair_is_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.randint(4, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 12))]
        room, above = rng.randint(1, capacity), rng.randint(0, capacity)
        found = best_fit.Unpacked(lengths, capacity).pair(room, above)
        sums = [a + b for a, b in itertools.combinations(lengths, 2) if above < a + b <= room]
        assert (sum(found) if found else None) == max(sums, default=None)
        if found:
            left = collections.Counter(lengths)
            left.subtract(found)
            assert min(left.values()) >= 0


def test_bins():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([16, 100, 2048])
        lengths = [min(capacity, int(rng.paretovariate(0.8)) + rng.randint(0, capacity // 3)) for _ in range(rng.randint(1, 400))]
        bins = best_fit.best_two_fit(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= 1.3 * sum(lengths) / capacity + 1


def checked_pieces(rows, coded, capacity):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in coded.items():
        found = sorted(pieces[i], key=lambda r: (r.piece, r.offset))
        assert [(r.piece, r.start) for r in found] == [(k, s) for k, s in enumerate(range(0, len(ids), capacity))]
        for r in found:
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_op11(spark):
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    coded = {r.doc_id: [*word.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    n = checked_pieces(q.op11_best_fit(spark, SF).collect(), coded, 2048)
    assert n <= -(-sum(map(len, coded.values())) // 2048) + 1


def test_packing_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(None, "x"), (1, None), (2, ""), (3, long), (4, "same"), *[(5, "again and again")] * 3000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("grp"), F.lit("s").alias("salt"), F.lit(2).alias("piece")).repartition(3)
    got = best_fit.pack_whole(docs, P.path("word_bpe_49k.json"), capacity=64, group_rows=100).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert collections.Counter(r.doc_id for r in got)[5] == 3000 and collections.Counter(r.doc_id for r in got)[None] == 1
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = {i: [*word.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows if i and i < 5}
    checked_pieces([r for r in got if r.doc_id in coded] + [r for r in got if r.doc_id not in coded], coded, 64)
    sizes = collections.Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 64 and len(sizes) <= 1.1 * sum(sizes.values()) / 64 + 40
    assert best_fit.pack_whole(docs.limit(0), P.path("word_bpe_49k.json")).collect() == []


# -- conversations -----------------------------------------------------------------------------------


def cheapest(letters: str) -> tuple[int, str]:
    """All sequences of edits, with at most two insertions in each gap."""
    best = None
    gaps = len(letters) + 1
    for inserted in itertools.product(range(3), repeat=gaps):
        for edits in itertools.product("KRD", repeat=len(letters)):
            audit, roles, cost = "", "", 0
            for k in range(gaps):
                for _ in range(inserted[k]):
                    audit, roles, cost = audit + "I", roles + ("a" if roles.endswith("u") else "u"), cost + 2
                if k == len(letters):
                    break
                x, e = letters[k], edits[k]
                audit += e
                if e == "D":
                    cost += 3
                    continue
                if x in "bd":
                    cost = None
                    break
                roles += x.lower() if e == "K" else ("a" if roles.endswith("u") else "u")
                cost += (2 if e == "R" else 0) + x.isupper()
            if cost is not None and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_trie_is_brute_force():
    rng = random.Random(11)
    signatures = sorted({"".join(rng.choice("suaoSUAObd") for _ in range(rng.randint(0, 4))) for _ in range(150)})
    trie = cv.Trie()
    for s in signatures:
        paths = trie.insert(s)[cv.START]
        assert min(paths[e] for e in cv.ENDINGS if e in paths) == cheapest(s), s
    assert trie.layers == len({s[:n] for s in signatures for n in range(1, len(s) + 1)})


def test_chunks_chain():
    """A signature cut anywhere has the same answer, and answers survive being written."""
    rng = random.Random(13)
    for _ in range(300):
        whole = "".join(rng.choice("suaoUAbdd" if rng.random() < 0.5 else "uad") for _ in range(rng.randint(0, 40)))
        one, many = cv.Chain(), cv.Chain()
        one.add(cv.Trie().insert(whole))
        at = 0
        while at < len(whole):
            n = rng.randint(0, 6)
            many.add(cv.read(cv.written(cv.Trie().insert(whole[at : at + n]))))
            at += n
        assert one.best() == (many.best() if whole else (0, ""))


def audited(rows):
    """The whole contract in plain Python for rows (conv, turn, role, text); ties of a turn as the operator has them."""
    out, by = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        told = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, letters = set(), ""
        for _, role, text in turns:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            x = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "b" if not shown else "d" if (role, text) in seen else x if shown[-1] in ".!?" else x.upper()
            seen.add((role, text))
        chain = cv.Chain()
        chain.add(cv.Trie().insert(letters))
        cost, audit = chain.best()
        lines, state, k = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else turns[k][1:]
            k += e != "I"
            if e == "D":
                continue
            state = cv.KEPT[state, role[0]] if e == "K" else cv.AFTER[state]
            lines.append(f"{role if e == 'K' else cv.ROLE[state]}:{text}")
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, letters.count("b"), letters.count("d"), sum(map(str.isupper, letters)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [1, 3, 256])
def test_conversations_are_brute_force(spark, most):
    rng = random.Random(17)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "Sys"], ["Fine.", "cut", " \t\n", "", None, "Why? ", "é漢!", "a\nb."]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(160)]
    rows += [(7, k, "user" if k % 2 else "assistant", f"turn {k % 90}." + "x" * (k % 5)) for k in range(700)] + [(8, None, "user", "Hi.")] * 30 + [(k, 0, "user", "Long " * 5000 + ".") for k in range(100, 140)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(1).alias("key"), F.lit("x").alias("letters"), F.lit(2).alias("chunk")).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cv.audit_conversations(cv.damaged(table), most=most, most_bytes=40_000).collect()}
    want = audited(rows)
    assert got == want
    assert any(v[6] == "" and v[5] == 0 for v in want.values())
    turns = collections.defaultdict(list)
    for r in cv.repaired_turns(cv.damaged(table), most=most).orderBy("conv_id", "place").collect():
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, values in want.items():
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == values[7]
    assert cv.audit_conversations(cv.damaged(table.limit(0))).collect() == []


# -- phrases -----------------------------------------------------------------------------------------


def mined(rows, least, top=2000, longest=4, share=80):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        best = []
        for p, a in kept.items():
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(100 * b >= share * a for s, b in kept.items() if len(s) > len(p) and any(s[i : i + len(p)] == p for i in range(len(s) - len(p) + 1)))
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("positions", "least", "top"), [(7, 2, 2000), (50, 3, 5), (2_000_000, 2, 2000)])
def test_phrases_are_brute_force(spark, positions, least, top):
    rng = random.Random(19)
    words = ["the", "The", "cat", "sat", "é", "漢", "of", "on", "\x1cx", "a\xa0b", "'", "-", "|"]
    sign = lambda: rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "\r", "  "])
    rows = [("".join(rng.choice(words) + sign() for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("...", "en"), (" \t", "xx"), ("over and over again " * 300, "en")] + [("the same row", "en")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string").select("*", F.lit(1).alias("block"), F.lit("x").alias("phrase"), F.lit(2).alias("n")).repartition(3)
    got = ph.mine_phrases(docs, least=least, top=top, positions=positions)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, least, top)


def test_phrase_edges(spark, monkeypatch):
    docs = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert ph.mine_phrases(docs).collect() == []
    assert ph.mine_phrases(docs.limit(0)).collect() == []
    # a long text is cut into segments where no word is, and counts as one
    monkeypatch.setattr(ph, "_SEGMENT", 16)
    text = b"some words of " * 9 + b"y" * 70 + b" some words of"
    assert b"".join(ph.segments(text)) == text and all(ph._TOKENS.findall(p) for p in ph.segments(text))
    assert [w for p in ph.segments(text) for w in ph._TOKENS.findall(p)] == ph._TOKENS.findall(text)


def test_scores_past_64_bits(spark):
    big = 9 * 10**17
    rows = [("en", "a", big, 1), ("en", "b", big + 1, 1), ("en", "c", big, 1), ("en", "a b", big - 1, 2), ("en", "b c", big, 2)]
    for longer, kept in ((80 * (big // 100), {"a b c"}), (80 * (big // 100) - 1, {"a b", "b c", "a b c"})):
        sums = spark.createDataFrame([*rows, ("en", "a b c", longer, 3)], "lang string, phrase string, a long, width int")
        got = {r.phrase: (r.score, r.l, r.r) for r in ph.candidates(sums, 80).collect()}
        assert got["a b c"] == (2_000_000 * longer // (2 * big), big, big) and set(got) == kept | ({"a b"} if 100 * longer < 80 * (big - 1) else set())
    assert got["a b"] == (2_000_000 * (big - 1) // (2 * big + 1), big, big + 1)
