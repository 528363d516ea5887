"""Phrase collocation mining over vertical positional inverted lists.

Documents are cut into words and dealt into blocks of a bounded number of positions, within the task
that reads them. A block is stored vertically: for each word of a language the sorted list of the
positions where it stands; places between pieces of text hold no word, so nothing is adjacent across
them. Level by level, the lists of frequent phrases are merge-joined with the postings of the words
that follow them, and the length of a list is the exact frequency in its block. Only numbers leave a
block: a phrase is the ids of the shorter phrase and of the word it ends with, and (left, right, length)
rows are summed over all blocks in one shuffle. A list is known by its block and its first position
there, and a phrase by the first of all its lists. What is frequent over the whole table goes back to
the blocks that hold it: first the words, and blocks keep their postings alone, then the phrases of each
level. So no list is ever shuffled by a word, however common the word is, and no text of a phrase before
the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The marks between pieces, [.,;:!?\x0A-\x0D], and the signs between words, [\x20\x09].
_TOKENS = re.compile(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+")
_MARKS = b".,;:!?\n\x0b\x0c\r"
_SIGNS = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: The language of rows without one.
UNKNOWN = "und"

BLOCKS = "block bigint, counted int, langs array<string>, words array<string>, sizes array<int>, counts array<int>, postings binary"
ROWS = "left bigint, right bigint, at bigint, f bigint"
KEPT = "block bigint, counted int, ids binary, sizes array<int>, postings binary"
#: A list is known by its block and its first position there (a word's by its number), in one integer; a
#: partition has up to 2^16 blocks.
PLACE_BITS, BLOCK_BITS = 22, 16
_SEGMENT = 1 << 20


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about a megabyte, cut where no word is."""
    at = 0
    while len(text) - at > 2 * _SEGMENT:
        found = _SIGNS.search(text, at + _SEGMENT)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Numbers(dict):
    """Numbers words of one language in the order in which they come; number 0 is a gap."""

    def __init__(self, names: list[tuple[str, bytes]], lang: str):
        super().__init__(dict.fromkeys((bytes([m]) for m in _MARKS), 0))
        self.names, self.lang = names, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.names)
        self.names.append((self.lang, word))
        return found


class Block:
    """The positions of a bounded stretch of documents."""

    def __init__(self, longest: int):
        self.longest = longest
        self.start([])

    def start(self, carried: list[tuple[str, bytes]]) -> None:
        self.names: list[tuple[str, bytes]] = [("", b"")]
        self.langs: dict[str, Numbers] = {}
        self.ids = [self.of(lang)[word] for lang, word in carried]

    def of(self, lang: str) -> Numbers:
        if lang not in self.langs:
            self.langs[lang] = Numbers(self.names, lang)
        return self.langs[lang]

    def add(self, lang: str, part: bytes) -> None:
        self.ids += map(self.of(lang).__getitem__, _TOKENS.findall(part))

    def flush(self, block: int, goes_on: bool) -> pa.RecordBatch | None:
        """The block as one row. If a piece goes on, its last words are counted in the next block, which begins with them."""
        ids = self.ids
        carried: list[tuple[str, bytes]] = []
        if goes_on:
            for i in reversed(ids[len(ids) - self.longest + 1 :]):
                if not i:
                    break
                carried.insert(0, self.names[i])
        counted = len(ids) - len(carried)
        row = None
        if counted:
            at = np.asarray(ids, "<i4")
            order = np.argsort(at, kind="stable").astype("<i4")
            sizes = np.bincount(at, minlength=len(self.names))
            order, sizes = order[sizes[0] :], sizes[1:]
            counts = np.bincount(at[:counted], minlength=len(self.names))[1:]
            langs, words = [lang for lang, _ in self.names[1:]], [w.decode() for _, w in self.names[1:]]
            ints = pa.list_(pa.int32())
            texts = pa.list_(pa.string())
            columns = [pa.array([block], pa.int64()), pa.array([counted], pa.int32()), pa.array([langs], texts), pa.array([words], texts), pa.array([sizes], ints), pa.array([counts], ints), pa.array([packed(order)], pa.binary())]
            row = pa.RecordBatch.from_arrays(columns, names=["block", "counted", "langs", "words", "sizes", "counts", "postings"])
        self.start(carried)
        return row


def blocks_of(docs: DataFrame, text_col: str, lang_col: str, longest: int, positions: int) -> DataFrame:
    """BLOCKS: one row a block, of about `positions` positions; only longer single words make it larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(longest), TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = (text.as_py() or "").encode().translate(_LOWER)
                for part in segments(body):
                    block.add(UNKNOWN if lang is None else lang, part)
                    if len(block.ids) >= positions:
                        row = block.flush(number, True)
                        number += 1
                        if row:
                            yield row
                block.ids.append(0)
        row = block.flush(number, False)
        if row:
            yield row

    return docs.select(F.col(text_col), F.col(lang_col)).mapInArrow(run, BLOCKS)


def merge_join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into two sorted lists of positions where both hold the same one."""
    if not len(right):
        return np.empty(0, int), np.empty(0, int)
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    same = np.flatnonzero(right[at] == left)
    return same, at[same]


def packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Integers as their steps: lists of positions, one behind the other, or ids in order."""
    return pa.compress(np.diff(values, prepend=0).astype(kind).tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes, n: int, kind: str = "<i4") -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(body, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind), dtype=kind)


class Lists:
    """The inverted lists of one level of a block: (position, phrase) in order of position."""

    def __init__(self, at: np.ndarray, of: np.ndarray):
        self.at, self.of = at, of

    @classmethod
    def of_words(cls, sizes: np.ndarray, postings: bytes) -> Lists:
        at = unpacked(postings, int(sizes.sum()))
        of = np.repeat(np.arange(len(sizes), dtype="<i4"), sizes)
        order = np.argsort(at)
        return cls(at[order], of[order])

    def lying_at(self, places: np.ndarray) -> np.ndarray:
        """The phrases at these positions, which all have one."""
        return self.of[np.searchsorted(self.at, places)]

    def only(self, phrases: np.ndarray) -> Lists:
        wanted = np.zeros(int(self.of.max(initial=-1)) + 1, bool)
        wanted[phrases] = True
        held = wanted[self.of]
        return Lists(self.at[held], self.of[held])

    def meeting(self, words: Lists, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a phrase is followed, `width` places on, by a word: indices into both, and a key of the two."""
        here, there = merge_join(self.at + width, words.at)
        return here, there, (self.of[here].astype("<i8") << 32) | words.of[there]

    def extended(self, words: Lists, width: int) -> Lists:
        here, _, keys = self.meeting(words, width)
        return Lists(self.at[here], np.unique(keys, return_inverse=True)[1].astype("<i4"))


def numbers(row: pa.Scalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def marked(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """The blocks with the places and the ids of the frequent lists they hold: at most as many as they have lists.

    One pass fills both arrays, row by row, so they run side by side.
    """
    place = (F.col("at") % (1 << PLACE_BITS)).cast("int")
    known = frequent.groupBy(F.shiftright("at", PLACE_BITS).alias("block")).agg(F.collect_list(place).alias("mark_places"), F.collect_list("id").alias("mark_ids"))
    return blocks.hint("merge").join(known, "block")


def kept_of(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """KEPT: the blocks with the postings of their frequent words alone, and the ids of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counted, sizes, postings, places, ids in zip(*batch.columns, strict=True):
                lists = Lists.of_words(numbers(sizes), postings.as_py())
                places, ids = numbers(places), numbers(ids)
                order = np.argsort(ids)
                new = np.zeros(len(sizes), "<i4")
                new[places[order]] = np.arange(len(order))
                lists = lists.only(places)
                of = new[lists.of]
                columns = [[block.as_py()], [counted.as_py()], [packed(ids[order], "<i8")], [np.bincount(of, minlength=len(order))], [packed(lists.at[np.argsort(of, kind="stable")])]]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "counted", "ids", "sizes", "postings"])

    return marked(blocks.select("block", "counted", "sizes", "postings"), words).mapInArrow(run, KEPT)


def rebuilt(words: Lists, width: int, firsts: np.ndarray) -> Lists:
    """All lists of the phrases of `width` words that begin at these positions. A phrase that begins like none of
    them goes as soon as that shows."""
    lists = words.only(words.lying_at(firsts))
    for k in range(1, width):
        lists = lists.extended(words, k)
        lists = lists.only(lists.lying_at(firsts))
    return lists


def level_of(kept: DataFrame, frequent: DataFrame | None, width: int, last: bool) -> DataFrame:
    """ROWS: the phrases of `width` words with their frequency in each block; beyond two words they extend the
    frequent phrases of the level before, and what follows their first word has to be one of these, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block, counted, sizes = row["block"].as_py(), row["counted"].as_py(), numbers(row["sizes"])
                words = before = Lists.of_words(sizes, row["postings"].as_py())
                ids = unpacked(row["ids"].as_py(), len(sizes), "<i8")
                known = ids
                if width > 2:
                    firsts, named = numbers(row["mark_places"]), numbers(row["mark_ids"])
                    order = np.argsort(firsts)
                    before = rebuilt(words, width - 1, firsts[order])
                    known = np.zeros(int(before.of.max(initial=-1)) + 1, "<i8")
                    known[before.lying_at(firsts[order])] = named[order]
                here, there, keys = before.meeting(words, width - 1)
                if width > 2:
                    begun, _ = merge_join(before.at[here] + 1, before.at)
                    here, there, keys = here[begun], there[begun], keys[begun]
                at = before.at[here]
                _, first, of = np.unique(keys, return_index=True, return_inverse=True)
                found = np.bincount(of[at < counted], minlength=len(first))
                if at.max(initial=0) >> PLACE_BITS:
                    raise ValueError("a block is too long: take fewer positions")
                # a phrase that only the next block counts is named too: here it may continue another one
                shown = first[found > 0] if last else first
                columns = [known[before.of[here[shown]]], ids[words.of[there[shown]]], (block << PLACE_BITS) + at[shown].astype("<i8"), found[found > 0] if last else found]
                for lo in range(0, len(shown), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000], pa.int64()) for c in columns], names=["left", "right", "at", "f"])

    return (kept if frequent is None else marked(kept, frequent)).mapInArrow(run, ROWS)


def frequent_of(rows: DataFrame, least: int, *phrase: str) -> DataFrame:
    """phrase, at, id, a: the lists whose phrase has `least` occurrences or more in its language.

    A phrase has at most one row a block, so a common word is no hot key.
    """
    same = Window.partitionBy(*phrase)
    rows = rows.withColumn("a", F.sum("f").over(same)).withColumn("id", F.min("at").over(same))
    return rows.where(F.col("a") >= least).select(*phrase, "at", "id", "a")


def texts_of(once: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, width of every frequent word and phrase; ids that many phrases share are split by Spark."""
    words = once[0].select("id", "lang", "phrase", "a", F.lit(1).alias("width"))
    levels, last = [words], words
    ends = words.select(F.col("id").alias("right"), F.col("phrase").alias("_word"))
    for width, rows in enumerate(once[1:], 2):
        begins = last.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_begin"))
        both = rows.join(begins.hint("merge"), "left").join(ends.hint("merge"), "right")
        last = both.select("id", "lang", F.concat_ws(" ", "_begin", "_word").alias("phrase"), "a", F.lit(width).alias("width"))
        levels.append(last)
    return reduce(DataFrame.unionByName, levels).drop("id")


def mine_phrases(docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, positions: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words of each language.

    A-Z is lower-cased. Phrases lie within pieces, between the marks [.,;:!?] and line ends. n counts
    all words of a language, a the occurrences of the phrase, at least `least`; l and r those of its two
    parts at the cut with the lowest score, floor(2000000 * a / (l + r)), the earliest of such cuts.
    Phrases inside a longer one that has at least `share` per cent of their occurrences are dropped.
    The first `top` by score, occurrences and phrase stay; that report is the only limit.

    A null text is empty and a null language is `und`. Repeated rows count each time, ids play no part,
    and other columns are ignored whatever their names. An empty table, or one without frequent
    phrases, gives an empty result. A text or piece of any length is cut over several blocks, of about
    `positions` positions each, without losing a phrase.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    blocks = scratch.keep(blocks_of(docs, text_col, lang_col, longest, positions), "blocks")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("number", "w"))
    words = listed.select(F.col("w.langs").alias("lang"), F.col("w.words").alias("phrase"), (F.shiftleft("block", PLACE_BITS) + F.col("number")).alias("at"), F.col("w.counts").cast("bigint").alias("f"))
    n = scratch.keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "n")
    frequent = scratch.keep(frequent_of(words, least, "lang", "phrase"), "level1")
    # each phrase once, at the first of its lists
    once = [scratch.keep(frequent.where("at = id"), "once1")]
    kept = scratch.keep(kept_of(blocks, frequent), "kept")
    scratch.drop("blocks", "level1")
    frequent = None
    for width in range(2, longest + 1):
        frequent = scratch.keep(frequent_of(level_of(kept, frequent, width, width == longest), least, "left", "right"), f"level{width}")
        once.append(scratch.keep(frequent.where("at = id"), f"once{width}"))
        scratch.drop(f"level{width - 1}")

    sums = scratch.keep(texts_of(once), "sums")
    chosen = candidates(sums, share)
    slices = max(1, sums.count() // 100_000)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each slice first, so that a language is never ranked whole in one task
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*best)
    chosen = chosen.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= top).drop("_r")
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def candidates(sums: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer phrase stands for.

    sums: lang, phrase, a, width of every frequent phrase and word. The parts of a frequent phrase are
    frequent themselves, so joining by part finds all of them; a part that many phrases share is split
    by Spark's handling of skewed joins.
    """
    piece = lambda lo, n: F.array_join(F.slice("_w", lo, n), " ")
    longer = sums.where("width > 1").withColumn("_w", F.split("phrase", " ", -1))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("first"), piece(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), piece(F.col("k") + 1, F.col("width") - F.col("k")).alias("part")))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    known = sums.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    of = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    scored = parts.join(known.hint("merge"), ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(of(True).alias("l"), of(False).alias("r"))
    # decimals, since the product may pass 64 bits
    score = "cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)"
    scored = scored.withColumn("score", F.expr(score))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("width") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("width") - n + 1), lambda lo: piece(lo, n))))
    over = longer.where("width > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    stands = F.lit(100).cast("decimal(3,0)") * F.col("_longer").cast("decimal(20,0)") >= F.lit(share).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")
    return lowest.join(over.hint("merge"), ["lang", "phrase"], "left").where(F.col("_longer").isNull() | ~stands).drop("_longer")
