"""MinHash near-dedup over SetSketch registers.

A document's set is its distinct five-word shingles. Each of 128 registers holds the smallest of the
exponential variates that a hash gives to the shingles, on a logarithmic scale of base 1.001 and
truncated to 16 bits: registers of a union are the larger ones of its parts, and two registers agree
about as often as the sets overlap. Four registers make a band of exactly 64 bits.

1. Documents with equal sets collapse to the smallest id (map-side combined, so a group of copies
   costs one row per task).
2. Documents that share a band make a bucket. Each bucket proposes links from its most connected
   member to the others: as many as members, never all pairs.
3. The proposals go through the joint likelihood of the two sketches given both set sizes, and then
   through an exact comparison of the two shingle sets.
4. Buckets that hold more than one component afterwards are searched for the links that stars can't
   see: members that may have a partner in another component are compared where they meet, block
   against block in large buckets, and only confirmed links that join components come out.

A pair at similarity 0.75 shares none of the 32 bands with probability 5e-6, one at 0.8 with 5e-8.
Nothing about documents is gathered on the driver, and no bucket is held by one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .common import Scratch, copied, dealt, hot_keys

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
NUM, DEN = 75, 100
SURELY_APART = 40
_LN_BASE = float(np.log(BASE))

_rng = np.random.default_rng(0x5E75)
_COMBINE = _rng.integers(1 << 62, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_TIMES = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split touch A-Z and [\\x20\\x09-\\x0D] only."""
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set:
    """The full set, as word tuples; a text of fewer than five words is one shingle."""
    w = words_of(text)
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def fingerprints(words: list[bytes], memo: Memo) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < 5:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(words) - 4
    mixed = np.zeros(n, np.uint64)
    for i in range(5):
        mixed += h[i : i + n] * _COMBINE[i]
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (u16) of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, ((short[None, at : at + 1024] ^ _XOR) * _TIMES).min(axis=1), out=low)
    variate = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / _LN_BASE), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LN_BASE


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, odds: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """(may be linked, estimated similarity) for rows of two register tables and the set sizes.

    The likelihood of a similarity J comes from how many registers of the pair are larger, smaller
    and equal. A pair is given up only if the most likely J is below the threshold and the threshold
    itself is less likely by a factor of exp(odds), which a linked pair meets about once in a million.
    Sizes are exact, so a pair whose smaller set is below three quarters of the larger is no link.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 101)[None, :]

    def loglik(j: np.ndarray) -> np.ndarray:
        j = np.minimum(j, most[:, None])
        over, under = _p(u[:, None] - v[:, None] * j), _p(v[:, None] - u[:, None] * j)
        over, under = np.maximum(over, 1e-9), np.maximum(under, 1e-9)
        return more[:, None] * np.log(over) + less[:, None] * np.log(under) + same[:, None] * np.log(np.maximum(1 - over - under, 1e-9))

    # in the joint model the sets' sizes are relative to their union: x = u - v J after scaling by 1 + J
    table = loglik(grid)
    best = table.argmax(1)
    at = loglik(np.full((1, 1), NUM / DEN))[:, 0]
    close = (best / 100 >= NUM / DEN) | (table.max(1) - at <= odds)
    return close & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)), np.minimum(best / 100, most)


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest, 300_000)
        for batch in batches:
            sizes, hashes, sketches = [], [], []
            for text in batch.column(1):
                found = fingerprints(words_of(text.as_py()), memo)
                sizes.append(len(found))
                hashes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketches.append(registers(found).view("<i8") if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=SKETCH.fieldNames())

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, SKETCH)


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal-length sketches as a table of u16 registers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(len(flat), REGISTERS)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def spread_pairs(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """pairs with _s, the slice of a that a pair lies in, and the hot a: none with much of all pairs stays whole."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    total = pairs.count()
    hot = scratch.keep(hot_keys(degree, "a", "_n", total), "hot")
    return dealt(pairs, hot, "a", "b"), hot


def estimated(pairs: DataFrame, hot: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b, _s) that the likelihood test lets through."""
    left = copied(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), hot, "a")
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, ["a", "_s"]).join(right, "b").where(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")).select("a", "b", "_s", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keep, _ = likely(_stack(part.column(5)), part.column(3).to_numpy().astype(float), _stack(part.column(6)), part.column(4).to_numpy().astype(float))
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in range(3)], names=["a", "b", "_s"])

    return joined.mapInArrow(run, "a bigint, b bigint, _s int")


def verified(pairs: DataFrame, hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet the threshold, of pairs with slices (a, b, _s).

    Each slice of a document's partners gets one copy of the document's text. Tasks stream sorted rows
    and hold the sets of one document and one partner at a time. An id with several texts is one node,
    linked by any of them.
    """
    members = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "_s", "b", "text")
    heads = copied(texts.withColumnRenamed("id", "a"), hot, "a").join(pairs.select("a", "_s").distinct(), ["a", "_s"]).select("a", "_s", F.lit(None).cast("long").alias("b"), "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(heads).repartition(parts, "a", "_s").sortWithinPartitions("a", "_s", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[set] = []
        last = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, s, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                mine = shingles(text.as_py())
                if b is None:
                    heads = [*heads, mine] if last == (a, s) else [mine]
                    last = (a, s)
                    continue
                for head in heads:
                    both = len(head & mine)
                    if DEN * both >= NUM * (len(head) + len(mine) - both):
                        out[0].append(a)
                        out[1].append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return rows.mapInArrow(run, PAIR)


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """id, comp: the smallest id reachable over links (a, b), for every id that has a link.

    Every node moves to its smallest neighbour and the links are contracted, until none is left;
    nodes at least halve each round, and stars vanish in one or two.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), f"{label}-edges-0")
    owner = scratch.keep(edges.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")), f"{label}-owner-0")
    k = 0
    while edges.limit(1).count():
        k += 1
        parent = scratch.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), f"{label}-parent-{k}")
        owner = scratch.keep(owner.join(parent, F.col("comp") == F.col("a"), "left").select("id", F.coalesce("p", "comp").alias("comp")), f"{label}-owner-{k}")
        one = edges.join(parent, "a").select("b", F.col("p").alias("x"))
        two = one.join(parent.withColumnRenamed("a", "b"), "b").select("x", F.col("p").alias("y")).where("x != y")
        edges = scratch.keep(two.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{label}-edges-{k}")
        scratch.drop(f"{label}-edges-{k - 1}", f"{label}-owner-{k - 1}", f"{label}-parent-{k}")
    return owner


ROW = "band int, key bigint, i int, j int, x int, id bigint, comp bigint, pivot bigint, n bigint, sketch array<bigint>"
MEETING = ["band", "key", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (band, key, i, j) from sorted batches; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            here = tuple(group[s].tolist())
            if here != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


class _Meeting:
    """The rows of one bucket, or of two blocks of it, and which of them may be linked."""

    def __init__(self, t: pa.Table):
        self.band, self.i, self.j = (t[c][0].as_py() for c in ("band", "i", "j"))
        self.ids, self.comps, self.n, self.x = (t[c].to_numpy().copy() for c in ("id", "comp", "n", "x"))
        self.pivot = t["pivot"][0].as_py()
        self.regs = _stack(t["sketch"])
        self.keys = self.regs.view("<i8")

    def partners(self, r: int) -> np.ndarray:
        """Later rows in other components that may be linked with row r: of fitting size, not seen in an
        earlier band, let through by the likelihood test. The pivot was compared with all before."""
        if self.ids[r] == self.pivot:
            return np.zeros(0, np.int64)
        rest = np.arange(r + 1, len(self.ids))
        n = self.n
        fit = (self.comps[rest] != self.comps[r]) & (DEN * np.minimum(n[rest], n[r]) >= NUM * np.maximum(n[rest], n[r])) & (self.ids[rest] != self.pivot)
        if self.i != self.j:
            fit &= self.x[rest] != self.x[r]
        rest = rest[fit]
        if len(rest):
            # only a short cut: with fewer equal registers `likely` gives up every pair of fitting size
            rest = rest[(self.regs[rest] == self.regs[r]).sum(1) >= SURELY_APART]
        if len(rest):
            rest = rest[~(self.keys[rest, : self.band] == self.keys[r, : self.band]).any(1)]
        if len(rest):
            rest = rest[likely(np.broadcast_to(self.regs[r], (len(rest), REGISTERS)), np.full(len(rest), float(n[r])), self.regs[rest], n[rest].astype(float))[0]]
        return rest


def meetings(members: DataFrame, owner: DataFrame, reps: DataFrame, block: int = 512, most_shingles: int = 2_000_000) -> DataFrame:
    """The rows of buckets that hold several components, cut down to those with a possible partner.

    Buckets of more than `block` rows, or of more than `most_shingles` in all, are dealt into blocks,
    and every two blocks meet in one group, so a task holds two blocks at most, however long the texts.
    """
    named = members.join(owner, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / most_shingles)).cast("int")
    mixed = named.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("g")).where("lo != hi").drop("lo", "hi")
    rows = named.join(mixed, ["band", "key"]).join(reps, ["id", "n"])
    rows = rows.withColumn("x", F.pmod(F.xxhash64("id"), "g").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("band", "key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "comp", "pivot", "n", "sketch")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            m = _Meeting(t)
            wanted = np.zeros(len(m.ids), bool)
            for r in range(len(m.ids) - 1):
                found = m.partners(r)
                wanted[found] = True
                wanted[r] |= len(found) > 0
            yield from t.filter(pa.array(wanted)).combine_chunks().to_batches()

    return rows.repartition(parts, *MEETING).sortWithinPartitions(*MEETING, "id").mapInArrow(run, ROW)


def links_between(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join components inside a group: at most one fewer than components.

    Pairs are compared where they meet and never emitted. Fingerprint sets tell how much is shared;
    the full sets of the two texts confirm a link before it joins its components.
    """
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met.join(texts, "id").select("band", "key", "i", "j", "x", "id", "comp", "pivot", "n", "sketch", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest, 200_000)
        for t in _groups(batches):
            m, text = _Meeting(t), t["text"]
            prints = [fingerprints(words_of(s.as_py()), memo) for s in text]
            out: list[tuple[int, int]] = []
            for r in range(len(m.ids) - 1):
                rest = m.partners(r)
                for at in range(0, len(rest), 256):
                    part = rest[at : at + 256]
                    whole = np.concatenate([prints[p] for p in part])
                    place = np.minimum(np.searchsorted(prints[r], whole), len(prints[r]) - 1)
                    sizes = np.array([len(prints[p]) for p in part])
                    both = np.add.reduceat(prints[r][place] == whole, np.cumsum(sizes) - sizes, dtype=np.int64)
                    for p in part[DEN * both >= NUM * (len(prints[r]) + sizes - both)]:
                        if m.comps[p] == m.comps[r]:
                            continue
                        a, b = shingles(text[r].as_py()), shingles(text[int(p)].as_py())
                        if DEN * len(a & b) >= NUM * len(a | b):
                            out.append((int(m.ids[r]), int(m.ids[p])))
                            m.comps[m.comps == m.comps[p]] = m.comps[r]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(parts, *MEETING).sortWithinPartitions(*MEETING, "id").mapInArrow(run, PAIR).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links join documents with 100 * intersection >= 75 * union of their sets; component_id is the
    smallest id reachable. A null, empty or blank text has no set and no links, so it stands alone and
    is kept. Rows with a null id are left out of linking: their component is null and they are kept.
    Rows repeated with one id are one node of the graph, linked by any of their texts. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sketches = scratch.keep(sketched(docs, id_col, text_col), "sketches")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")).alias("rep"))
    reps = scratch.keep(classes.select("set_hash", "rep.*"), "reps")
    sets = reps.select("id", "n", "sketch")

    bands = reps.select("id", "n", F.posexplode("sketch").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.keep(bands.join(buckets, ["band", "key"]), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = scratch.keep(shared.join(weight, "id").select("band", "key", "id", "n", "weight"), "weighed")
    pivots = weighed.groupBy("band", "key").agg((-F.max(F.struct("weight", (-F.col("id")).alias("less")))["less"]).alias("pivot"))
    members = scratch.keep(weighed.join(pivots, ["band", "key"]).drop("weight"), "members")
    scratch.drop("shared", "weighed")

    # texts of documents that share a bucket, written once for all rounds; the one shuffle of texts
    crowd = members.select("id").distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = scratch.keep(plain.join(crowd, "id").distinct(), "texts")

    stars = scratch.keep(members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "proposed")
    stars, hot = spread_pairs(stars, scratch)
    links = scratch.keep(verified(scratch.keep(estimated(stars, hot, sets), "stars"), hot, texts), "links-0")
    owner = components(links, scratch, "stars")
    met = scratch.keep(meetings(members, owner, sets), "meetings")
    more = scratch.keep(links_between(met, texts), "links-1")
    if more.limit(1).count():
        owner = components(links.unionByName(more), scratch, "all")

    scratch.drop("texts", "members")
    nodes = reps.select("set_hash", F.col("id").alias("rep")).join(owner, F.col("rep") == F.col("id"), "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    out = sketches.select("doc_id", "n_shingles", "set_hash").join(nodes, "set_hash", "left")
    return out.select("doc_id", "n_shingles", linked.alias("component_id"), linked.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns."""
    gone = near_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
