"""LM scoring with Brown class-based n-grams.

Words fall into classes by exchange clustering: every word seen at least `least` times is moved
between classes while that raises the likelihood of the corpus's word bigrams. The `clustered` most
frequent words start it, then the words up to rank `placed` join the class that fits them best, then
all others; after that whole sweeps over all words run in parallel, each against the class bigrams
of the sweep before, and a sweep that does not raise the likelihood is undone and ends the run. A
text's probability is the product of class transitions (trigrams smoothed by Witten and Bell's method
down to unigrams) and of word emissions, add-one smoothed in the class of rare words, which holds all
unseen words too.

Counts come from all training texts. The `frequent` words are looked up in memory, all others by a
shuffle join that gives their count and number; what grows with the vocabulary on the driver and the
workers is one byte for each word that has a class.
"""

from __future__ import annotations

import gc
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id

FOLDS, HELD_OUT = 7, 2
#: Longer words are looked up by the join, however frequent, which bounds the bytes of the table in memory.
LONGEST = 64


@dataclass(frozen=True)
class Sizes:
    """Bounds of the model: they limit tables, never the texts or the counts.

    Words seen fewer than `least` times are rare whatever the table's room: their share of the corpus
    is what the model expects of words it has not seen. All other words take part in the sweeps, and
    `frequent` only says how many of them are looked up in memory instead of by a join.
    """

    frequent: int = 150_000
    least: int = 2
    clustered: int = 512
    placed: int = 8192
    classes: int = 32
    sweeps: int = 6


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower and bytes.split touch A-Z and [\\x20\\x09-\\x0D] only."""
    return (text or "").encode().lower().split()


def count_words(texts: DataFrame, room: int = 100_000) -> DataFrame:
    """word, n over the texts, and one empty word for each text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > room:
                    yield out()
                    held.clear()
            held[b""] += batch.num_rows
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, fixed: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """A class for each word: moves each free word to its best class until no move helps.

    bigrams[v, w] counts w after v; fixed[w] is a class that stays, or -1. Free words use classes
    0 .. classes - 1 and start dealt out in turn; fixed classes may lie above.
    """
    n = len(bigrams)
    total = max(classes, int(fixed.max(initial=-1)) + 1)
    of = np.where(fixed >= 0, fixed, np.arange(n) % classes)
    member = np.zeros((n, total))
    member[np.arange(n), of] = 1
    joint = member.T @ bigrams @ member

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    own = np.diag(bigrams).astype(float)
    right_sum, left_sum = bigrams.sum(1).astype(float), bigrams.sum(0).astype(float)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            if fixed[w] >= 0 or not right_sum[w] + left_sum[w]:
                continue
            a = of[w]
            right = np.bincount(of, bigrams[w], total)
            left = np.bincount(of, bigrams[:, w], total)
            right[a] -= own[w]
            left[a] -= own[w]
            joint[a] -= right
            joint[:, a] -= left
            joint[a, a] -= own[w]
            rows, cols = joint.sum(1) + left, joint.sum(0) + right  # totals of the other words, wherever w goes
            gain = (f(joint + right) - f(joint)).sum(1) + (f(joint.T + left) - f(joint.T)).sum(1)
            d = np.diag(joint)
            gain += f(d + right + left + own[w]) - f(d + right) - f(d + left) + f(d)
            gain -= f(rows + right_sum[w]) - f(rows) + f(cols + left_sum[w]) - f(cols)
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += right
            joint[:, b] += left
            joint[b, b] += own[w]
            of[w] = b
            moved += a != b
        if not moved:
            break
    return of


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


#: Counts up to this have what they add to f looked up in a table for each block of words.
SMALL = 16


def _added(table: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """f(t + x) - f(t) for the rows t of a table (all, or those named by `at`) and whole numbers x, row by row."""
    rows = np.arange(len(table)) if at is None else at
    if len(x) <= 4 * SMALL * len(table):
        t = table[rows]
        return _f(t + x[:, None]) - _f(t)
    known = _f(table[None] + np.arange(SMALL + 1.0)[:, None, None]) - _f(table)[None]
    small = x <= SMALL
    out = known[np.where(small, x, 0).astype(np.int64), rows]
    t = table[rows[~small]]
    out[~small] = _f(t + x[~small, None]) - _f(t)
    return out


def gains(joint: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """What `exchange` computes for one word, for many: gain[w, b] of w in class b, all else staying.

    right[w, c] and left[w, c] count neighbours of class c without w itself, own[w] counts w after w.
    Most words are rare, so most of the sum is looked up; what w itself adds to the class it is in is
    put right afterwards.
    """
    at = np.flatnonzero(of < classes)
    gain = np.zeros((len(of), classes))
    for to, back, table in ((right, left, joint), (left, right, joint.T)):
        w, c = to.nonzero()
        if not len(w):
            continue
        x, home = to[w, c], of[w]
        by_class = np.ascontiguousarray(table[:classes].T)
        step = _added(by_class, x, c)
        inside = np.flatnonzero((home < classes) & (c != home))
        without = np.maximum(by_class[c[inside], home[inside]] - x[inside], 0)
        step[inside, home[inside]] = _f(without + x[inside]) - _f(without)
        same = np.flatnonzero(c == home)
        base = by_class[c[same]] - back[w[same], :classes]
        both = np.flatnonzero(home[same] < classes)
        base[both, home[same][both]] -= x[same][both] + own[w[same][both]]
        np.maximum(base, 0, out=base)
        step[same] = _f(base + x[same, None]) - _f(base)
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(step, starts)
    # a class gains by its own bigrams only where w has it on both sides, or follows itself
    r, l = right[:, :classes], left[:, :classes]
    w, b = ((r > 0) & (l > 0) | (own > 0)[:, None]).nonzero()
    d = np.diag(joint)[b] - np.where(of[w] == b, right[w, b] + left[w, b] + own[w], 0)
    np.maximum(d, 0, out=d)
    gain[w, b] += _f(d + r[w, b] + l[w, b] + own[w]) - _f(d + r[w, b]) - _f(d + l[w, b]) + _f(d)
    for sums, table in ((right.sum(1) + own, joint), (left.sum(1) + own, joint.T)):
        whole = table.sum(1)[:classes]
        small = np.minimum(sums, SMALL + 1).astype(np.int64)
        known = _f(whole + np.arange(SMALL + 2.0)[:, None]) - _f(whole)
        step = known[small]
        big = np.flatnonzero(sums > SMALL)
        step[big] = _f(whole + sums[big, None]) - _f(whole)
        rest = np.maximum(whole[of[at]] - sums[at], 0)
        step[at, of[at]] = _f(rest + sums[at]) - _f(rest)
        gain -= step
    return gain


def moved(joint: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """The best class of each word; joint follows the moves."""
    gain = gains(joint, right, left, own, of, classes)
    best, row = gain.argmax(1), np.arange(len(of))
    stay = (of < classes) & (gain[row, best] <= gain[row, np.minimum(of, classes - 1)] + 1e-9)
    best = np.where(stay, of, best)
    go = np.flatnonzero(best != of)
    for sign, c in ((-1, of[go]), (1, best[go])):
        np.add.at(joint, c, sign * right[go])
        np.add.at(joint.T, c, sign * left[go])
        np.add.at(joint, (c, c), sign * own[go])
    np.maximum(joint, 0, out=joint)
    return best


@dataclass
class BrownModel:
    """Words are numbered by frequency; `classes` has two more entries, for rare words and text ends."""

    classes: np.ndarray
    log_next: np.ndarray
    log_mass: np.ndarray
    rare_mass: float


def joined_ids(column: pa.Array, mark: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a batch in one array, each after `before` marks, and where each text's marks start."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    lengths = np.diff(ends) // 4
    ids = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32) if ends[-1] > ends[0] else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    return np.insert(ids, np.repeat(starts, before), mark), starts + before * np.arange(len(column))


#: Ids that are turned into codes at once; what they take in memory doesn't follow the size of a batch.
IDS = 250_000


def slices(column: pa.Array, ids: int = IDS) -> Iterator[pa.Array]:
    """The texts of a batch in runs of at most so many ids, or of one text."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else []
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 4 * ids, "right")) - 1)
        yield column.slice(at, stop - at)
        at = stop


def trigrams_of(column: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the class trigrams of a batch, their last classes, and where each text's begin (each has one at least)."""
    mark = len(of) - 1
    ids, starts = joined_ids(column, mark, 2)
    c = of[np.append(ids, [mark, mark])].astype(np.int64)
    total = int(of[-1]) + 1
    # two ends stand between texts: the first closes a text, and what ends at the second belongs to none
    at = np.delete(np.arange(2, len(c)), starts[1:] - 1)[:-1]
    return (c[at - 2] * total + c[at - 1]) * total + c[at], c[at], starts - np.arange(len(starts))


def _histogram(coded: DataFrame, size: int, codes) -> np.ndarray:
    """Sum of np.bincount(codes(column)) over all batches; ids of a text are the numbers of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for some in slices(batch.column(0)):
                held += np.bincount(codes(some), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["code", "n"])

    table = coded.select("ids").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[table["code"].to_numpy()] = table["n"].to_numpy()
    return out


#: Words that move against the same class bigrams before these follow the moves, and words of a part:
#: a task counts the neighbours of one part at a time, about 70 numbers a word.
BLOCK, WORDS = 1024, 32_000


def packed(w: np.ndarray, v: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """part, n, pairs of `neighbours` for numbers of words in a row; built in place, about 40 bytes a number."""
    per = v // parts + 1
    a, b = w[:-1], w[1:]
    sides = [(a, b, 0), (b, a, 1)]
    keys, at = np.empty(sum(int(np.count_nonzero(word < v)) for word, _, _ in sides), np.int64), 0
    for word, near, before in sides:
        known = word < v
        word = word[known]
        mine = keys[at : at + len(word)]
        np.remainder(word, parts, out=mine)
        mine *= per
        mine += word // parts
        mine <<= 32
        code = near[known].view(np.uint32)
        code <<= 1
        code |= before
        mine |= code
        at += len(word)
    keys.sort()
    cuts = np.searchsorted(keys, np.arange(parts + 1) * per << 32)
    for part, (start, stop) in enumerate(itertools.pairwise(cuts.tolist())):
        if stop > start:
            some = keys[start:stop]
            pairs = np.empty((2, stop - start), "<u4")
            np.bitwise_and(some, 0xFFFFFFFF, out=pairs[1], casting="unsafe")
            some >>= 32
            some -= part * per
            pairs[0, 0] = some[0]
            np.subtract(some[1:], some[:-1], out=pairs[0, 1:], casting="unsafe")
            yield part, stop - start, pa.compress(pairs.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def neighbours(coded: DataFrame, v: int, parts: int, room: int = 2_000_000):
    """An RDD of (part, n, pairs): word // parts and the code of a neighbour, for words below v with word % parts == part.

    A code is twice the neighbour's number, and one more if it stands before the word. Pairs are packed
    (sorted, differences of the first, bytes in planes, zstd), since there are two for each token. All
    rows of a part are in one partition; the shuffle's files serve every sweep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            w = np.concatenate([*held, np.array([v + 1], np.int32)])
            held.clear()
            rows = list(packed(w, v, parts))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "n", "pairs"])

        for batch in batches:
            for some in slices(batch.column(0)):
                held.append(joined_ids(some, v + 1, 1)[0])
                size += len(held[-1])
                if size > room:
                    yield out()
                    size = 0
        if held:
            yield out()

    return coded.select("ids").mapInArrow(run, "part int, n int, pairs binary").repartition(parts, "part").rdd


def class_bigrams(coded: DataFrame, of: np.ndarray, total: int) -> np.ndarray:
    """joint[a, b]: how often a word of class b follows one of class a."""
    end = len(of) - 1

    def codes(column: pa.Array) -> np.ndarray:
        c = of[np.append(joined_ids(column, end, 1)[0], end)].astype(np.int64)
        return c[:-1] * total + c[1:]

    return _histogram(coded, total * total, codes).reshape(total, total).astype(float)


def sweep(pairs, of: np.ndarray, joint: np.ndarray, parts: int, free: int, classes: int) -> np.ndarray:
    """Classes after one parallel pass over the words below `free`."""
    sent = pairs.context.broadcast((of, joint))
    total, v = len(joint), len(of) - 2

    def run(rows: Iterator) -> Iterator[tuple[int, bytes]]:
        of, whole = sent.value
        counts: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def add(part: int) -> None:
            held = counts[part]
            np.add(held, np.bincount(np.concatenate(waiting.pop(part)), minlength=len(held)), out=held, casting="unsafe")

        for part, n, packed in rows:
            mine = min(v, free)
            words = max(0, -(-(mine - part) // parts))
            if not words:
                continue
            if part not in counts:
                counts[part] = np.zeros(words * 2 * (total + 1), np.int32)
            raw = np.frombuffer(pa.decompress(bytes(packed), decompressed_size=8 * n, codec="zstd"), np.uint8)
            steps, code = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(2, n)
            local = np.cumsum(steps, dtype=np.int64)
            stop = int(np.searchsorted(local, words))
            local, code = local[:stop], code[:stop]
            near = code >> 1
            # the word itself as neighbour has a column of its own
            c = np.where(near == local * parts + part, total, of[near])
            waiting.setdefault(part, []).append(((local * 2 + (code & 1)) * (total + 1) + c).astype(np.int32))
            if sum(map(len, waiting[part])) >= 500_000:
                add(part)
        for part in list(waiting):
            add(part)
        for part, held in sorted(counts.items()):
            joint, best = whole.copy(), []
            words = np.arange(part, min(v, free), parts)
            held = held.reshape(-1, 2, total + 1)
            for at in range(0, len(words), BLOCK):
                right, left = held[at : at + BLOCK].transpose(1, 0, 2).astype(float)
                best.append(moved(joint, right[:, :total], left[:, :total], right[:, total], of[words[at : at + BLOCK]].astype(np.int64), classes).astype(np.uint8).tobytes())
            yield part, b"".join(best)

    out = of.copy()
    for part, values in pairs.mapPartitions(run).collect():
        out[part : min(v, free) : parts] = np.frombuffer(values, np.uint8)
    sent.destroy()
    return out


def likelihood(joint: np.ndarray, classes: int) -> float:
    return float(_f(joint).sum() - _f(joint.sum(1)[:classes]).sum() - _f(joint.sum(0)[:classes]).sum())


def word_classes(coded: DataFrame, v: int, sizes: Sizes) -> np.ndarray:
    """A class for each of the v words, then those of rare words and of text ends."""
    C = sizes.classes
    rare, end, unplaced = C, C + 1, C + 2
    of = np.full(v + 2, unplaced, np.uint8)
    of[v:] = rare, end
    if not v:
        return of

    # exchange clustering of the most frequent words; other words and text ends keep classes of their own
    m = min(v, sizes.clustered)
    side = m + 2

    def bigram_codes(column: pa.Array) -> np.ndarray:
        ids = np.append(joined_ids(column, v + 1, 1)[0], v + 1).astype(np.int64)
        w = np.where(ids == v + 1, m + 1, np.minimum(ids, m))
        return w[:-1] * side + w[1:]

    bigrams = _histogram(coded, side * side, bigram_codes).reshape(side, side)
    of[:m] = exchange(bigrams, np.asarray([-1] * m + [C, C + 1]), C, sizes.sweeps)[:m]

    # then all words
    parts = 1 + v // WORDS
    pairs = neighbours(coded, v, parts)
    joint = class_bigrams(coded, of, C + 3)
    for free in [sizes.placed, v] if v > sizes.placed else [v]:
        of = sweep(pairs, of, joint, parts, free, C)
        joint = class_bigrams(coded, of, C + 3)
    for _ in range(sizes.sweeps):
        new = sweep(pairs, of, joint, parts, v, C)
        if (new == of).all():
            break
        after = class_bigrams(coded, new, C + 3)
        if likelihood(after, C) <= likelihood(joint, C):
            break
        of, joint = new, after
    return of


def train(coded: DataFrame, v: int, rare_mass: float, sizes: Sizes = Sizes()) -> BrownModel:
    of = word_classes(coded, v, sizes)
    end = sizes.classes + 1
    total = end + 1

    trigrams = _histogram(coded, total**3, lambda column: trigrams_of(column, of)[0]).reshape(total, total, total).astype(float)
    mass = np.log10(np.maximum(trigrams.sum((0, 1)), 1))
    mass[[sizes.classes, end]] = rare_mass, 0
    return BrownModel(of, smoothed(trigrams), mass, rare_mass)


def least_frequent(words: DataFrame, sizes: Sizes) -> int:
    """The smallest count for the table of frequent words: at most `frequent` words have it or more.

    Found from the numbers of words in 16 steps for each doubling of the count, under 1,000 rows.
    """
    step = F.floor(F.log2("n") * 16)
    room, least = sizes.frequent, 1 << 62
    for row in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        room -= row["k"]
        if room < 0:
            break
        least = row["n"]
    return max(least, sizes.least)


def smoothed(trigrams: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b), Witten-Bell interpolated with bigrams, add-one unigrams at the bottom."""
    two, one = trigrams.sum(0), trigrams.sum((0, 1))
    low = (one + 1) / (one + 1).sum()

    def mix(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds = np.maximum((counts > 0).sum(-1, keepdims=True), 1)
        return (counts + kinds * lower) / (counts.sum(-1, keepdims=True) + kinds)

    return np.log10(mix(trigrams, mix(two, low)[None, :, :]))


PARTS = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, emit double, ids binary, rare array<struct<word:binary,tf:bigint>>"
CODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, emit double, ids binary"


def numbered(words: DataFrame, first: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """word, n and id = first, first + 1, ... by falling n; how many there are, and the sum of n."""
    kept = scratch.keep(words.orderBy(F.desc("n"), "word").select("word", "n", F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftright("at", 33)
    sizes = sorted(kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect())
    offsets = dict(zip((r.part for r in sizes), itertools.accumulate((r.k for r in sizes), initial=first)))
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[part] if sizes else F.lit(first)
    return kept.select("word", "n", (shift + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id")), sum(r.k for r in sizes), sum(r.n for r in sizes)


def coded_rows(rows: DataFrame, scratch: Scratch, sizes: Sizes) -> tuple[DataFrame, int, int, int, float]:
    """Rows with the numbers of their words and the sums that need no classes; words with a class, tokens, kinds, rare mass.

    rows: doc_id, held_out, text. Rare and unseen words have the number of words with a class.
    """
    spark = rows.sparkSession
    vocabulary = scratch.keep(count_words(rows.where(~F.col("held_out")).select("text")), "vocabulary")
    whole = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    n, v, ends = whole["n"], whole["v"], whole["ends"]
    short = F.length("word").between(1, LONGEST)
    enough = least_frequent(vocabulary.where(short & (F.col("n") >= sizes.least)), sizes)
    known = vocabulary.where(short & (F.col("n") >= enough)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    k = known.num_rows
    beyond = vocabulary.where((F.length("word") > LONGEST) | ((F.length("word") > 0) & (F.col("n") < enough)))
    table, more_words, more_n = numbered(beyond.where(F.col("n") >= sizes.least), k, scratch)
    classed = k + more_words
    counts = known["n"].to_numpy().astype(np.int64)
    rare_n, rare_v = n - ends - int(counts.sum()) - more_n, v - (1 if ends else 0) - classed
    sent = spark.sparkContext.broadcast((known["word"].to_pylist(), counts))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = sent.value
        index = {w: i for i, w in enumerate(words)}
        gain, emit = np.log10(np.append(counts, 0) + 1.0), np.append(np.log10(counts), 0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                out: list[list] = [[] for _ in range(6)]
                far_words, far_counts, offsets = [], [], [0]
                for text in some.column(2):
                    tokens = words_of(text.as_py())
                    ids = np.fromiter(map(index.get, tokens, itertools.repeat(k)), np.int32, len(tokens))
                    far = np.flatnonzero(ids == k)
                    unknown = [tokens[i] for i in far.tolist()]
                    others = Counter(unknown)
                    slots = {w: -1 - i for i, w in enumerate(others)}
                    base, own = float(gain[ids].sum() + np.log10(ends + 1.0)), float(emit[ids].sum())
                    ids[far] = [slots[w] for w in unknown]
                    far_words.extend(others.keys())
                    far_counts.extend(others.values())
                    offsets.append(len(far_words))
                    values = (row, len(ids) + 1, len(ids) - len(far) + int(ends > 0), base, own, ids.tobytes())
                    for col, value in zip(out, values, strict=True):
                        col.append(value)
                    row += 1
                kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary()]
                made = [pa.array(col, kind) for col, kind in zip(out, kinds, strict=True)]
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(far_words, pa.binary()), pa.array(far_counts, pa.int64())], ["word", "tf"]))
                yield pa.RecordBatch.from_arrays([made[0], some.column(0), some.column(1), *made[1:], rare], names=[c.split()[0] for c in PARTS.split(", ")])

    parts = scratch.keep(rows.mapInArrow(look_up, PARTS), "parts")
    all_beyond = table.unionByName(beyond.where(F.col("n") < sizes.least).select("word", "n", F.lit(None).cast("int").alias("id")))
    seen = parts.select("row_id", F.posexplode("rare").alias("slot", "r")).select("row_id", "slot", "r.*").join(all_beyond, "word")
    more = seen.groupBy("row_id").agg(
        F.sum("tf").alias("_known"),
        F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("_gain"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("tf") * F.log10("n"))), F.lit(0.0)).alias("_emit"),
        F.collect_list(F.when(F.col("id").isNotNull(), F.struct("slot", "id"))).alias("_ids"),
    )
    joined = parts.join(more, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("_gain", F.lit(0.0))).alias("base"),
        (F.col("emit") + F.coalesce("_emit", F.lit(0.0))).alias("emit"),
        "ids",
        F.coalesce(F.col("_ids.slot"), F.array().cast("array<int>")).alias("slots"),
        F.coalesce(F.col("_ids.id"), F.array().cast("array<int>")).alias("numbers"),
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, slots, numbers in zip(*(batch.column(c) for c in (6, 7, 8)), strict=True):
                ids = np.frombuffer(ids.as_py(), np.int32)
                far = np.full(max(0, -int(ids.min(initial=0))), classed, np.int32)
                far[slots.values.to_numpy()] = numbers.values.to_numpy()
                at = np.flatnonzero(ids < 0)
                ids = ids.copy()
                ids[at] = far[-1 - ids[at]]
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], names=[*batch.schema.names[:6], "ids"])

    coded = scratch.keep(joined.mapInArrow(fill, CODED), "coded")
    scratch.drop("parts", "vocabulary", "numbered")
    sent.destroy()
    return coded, classed, n, v, float(np.log10(rare_n + rare_v + 1))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    A null, empty or blank text is the end token alone. A null id counts as the empty string for the
    fold and is scored. Repeated rows are counted and scored each. With no training text both scores
    come from the smoothing alone; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT
    coded, classed, n, v, rare_mass = coded_rows(rows.select("doc_id", held_out.alias("held_out"), "text"), scratch, sizes)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of the coding before those of the sweeps are written
    model = train(coded.where(~F.col("held_out")), classed, rare_mass, sizes)
    given = spark.sparkContext.broadcast((model.classes, model.log_next, model.log_mass))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, log_next, log_mass = given.value
        flat = log_next.ravel()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.concatenate([np.add.reduceat(flat[codes] - log_mass[last], firsts) for codes, last, firsts in (trigrams_of(some, of) for some in slices(batch.column(6)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.float64())], names=[*batch.schema.names[:6], "score"])

    return coded.mapInArrow(score, CODED.replace("ids binary", "score double")).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.col("emit")).alias("score"),
    )
