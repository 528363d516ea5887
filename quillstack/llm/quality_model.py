"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of a hundred words. Each passage is encoded by learnt embeddings of
its words and word pairs, hashed into a table, and by the make-up of its characters, through a small
hidden layer. Nothing but the passage itself enters its encoding. Gated attention, learnt together
with the embeddings from document labels alone, weights the passages, and the weighted mean of their
encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .common import Scratch
from .labelled import held_out, training_rows

PASSAGE = 100
BUCKET_BITS, DIM = 12, 16
HIDDEN, GATES = 16, 8


def _classes() -> np.ndarray:
    """A class for every byte of UTF-8: letters, capitals, digits, kinds of signs, the rest."""
    out = np.full(256, 7, np.uint8)
    out[np.arange(128, 256)] = 0
    for c in range(ord("a"), ord("z") + 1):
        out[c], out[c - 32] = 0, 1
    for k, chars in ((2, "0123456789"), (3, ".,;:?'\"-()"), (4, "!"), (5, "#*$%&<>@^~_+=\\{}[]`"), (6, "|/")):
        for c in chars:
            out[ord(c)] = k
    return out


CLASSES = _classes()
N_FEATURES = 8 + 5
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes() -> Memo:
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word, 10), 200_000)


@dataclass
class Bags:
    """Passages of some documents: features, hashed n-grams and how many of them each passage has, and
    the first passage of each document."""

    x: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Bags:
        sizes = [len(p[0]) for p in parts]
        return cls(*(np.concatenate([p[k] for p in parts]) for k in range(3)), np.cumsum([0, *sizes[:-1]]))


def passages(text: str | None, hashes: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, n-gram buckets and their number for each passage; a text without words is one of zeros."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32), np.zeros(0, np.uint16), np.zeros(1, np.int32)
    rows = np.zeros((-(-len(words) // PASSAGE), N_FEATURES), np.float32)
    ids, counts = [], np.zeros(len(rows), np.int32)
    h = np.fromiter(map(hashes.__getitem__, map(bytes.lower, words)), np.uint64, len(words))
    one = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    two = ((h[:-1] * _FIRST ^ h[1:] * _SECOND) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    for i, row in enumerate(rows):
        at = i * PASSAGE
        part = words[at : at + PASSAGE]
        n = len(part)
        ids += [one[at : at + n], two[at : at + n - 1]]
        counts[i] = 2 * n - 1
        joined = b"".join(part)
        row[:8] = np.bincount(CLASSES[np.frombuffer(joined, np.uint8)], minlength=8)[:8] / len(joined)
        windows = set(zip(part, part[1:], part[2:], strict=False))
        row[8:] = (len(set(part)) / n, 1 - len(windows) / (n - 2) if n > 2 else 0, len(joined) / n / 10, sum(len(w) <= 2 for w in part) / n, n / PASSAGE)
    return rows, np.concatenate(ids), counts


class AttentionModel:
    """Parameters and forward pass; `shift` and `scale` standardise the passage features."""

    NAMES = ("E", "W", "c", "V", "U", "a", "o")

    def __init__(self, seed: int = 7, bias: float = 0.0):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.shift, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.E = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM))
        self.W, self.c = rng.normal(0, 0.3, (N_FEATURES + DIM, HIDDEN)), np.zeros(HIDDEN)
        self.V, self.U, self.a = rng.normal(0, 0.3, (HIDDEN, GATES)), rng.normal(0, 0.3, (HIDDEN, GATES)), rng.normal(0, 0.3, GATES)
        self.o, self.bias = np.zeros(HIDDEN), bias

    def embedded(self, bags: Bags) -> np.ndarray:
        """The sum of the n-gram embeddings of each passage over the root of their number."""
        out = np.zeros((len(bags.x), DIM))
        some = np.flatnonzero(bags.counts)
        if len(some):
            out[some] = np.add.reduceat(self.E[bags.ids], (np.cumsum(bags.counts) - bags.counts)[some], axis=0)
        return out / np.sqrt(np.maximum(bags.counts, 1))[:, None]

    def forward(self, bags: Bags) -> dict:
        starts = bags.starts
        x = np.hstack([(bags.x - self.shift) / self.scale, self.embedded(bags)])
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ self.W + self.c)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * s) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        logit = z @ self.o + self.bias
        return {"x": x, "sizes": sizes, "h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": logit}

    def score(self, bags: Bags) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(bags)["logit"], -40, 40)))

    def gradients(self, bags: Bags, y: np.ndarray) -> dict:
        """Of the mean log loss, in closed form."""
        f, starts = self.forward(bags), bags.starts
        g = (1 / (1 + np.exp(-np.clip(f["logit"], -40, 40))) - y) / len(y)
        h, t, s, weight, sizes = f["h"], f["t"], f["s"], f["weight"], f["sizes"]
        dz = np.repeat(g[:, None] * self.o, sizes, axis=0)
        dw = (dz * h).sum(1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, starts), sizes))
        dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = (weight[:, None] * dz + dt @ self.V.T + ds @ self.U.T) * (1 - h * h)
        dx = (dh @ self.W.T)[:, N_FEATURES:] / np.sqrt(np.maximum(bags.counts, 1))[:, None]
        at = np.repeat(np.arange(len(bags.x)), bags.counts)
        dE = np.stack([np.bincount(bags.ids, dx[at, d], len(self.E)) for d in range(DIM)], 1)
        return {"E": dE, "o": f["z"].T @ g, "bias": g.sum(), "a": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": f["x"].T @ dh, "c": dh.sum(0)}

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, least_steps: int = 300, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> AttentionModel:
        """Adam over batches of documents, each epoch in a new random order."""
        x = np.concatenate([p[0] for p in parts])
        self.shift, self.scale = x.mean(0).astype(float), x.std(0).astype(float) + 1e-3
        moments = {k: [0.0, 0.0] for k in (*self.NAMES, "bias")}
        step, per = 0, -(-len(parts) // batch)
        for _ in range(max(epochs, -(-least_steps // per))):
            order = self.rng.permutation(len(parts))
            for k in range(0, len(parts), batch):
                some, step = order[k : k + batch], step + 1
                for name, d in self.gradients(Bags.of([parts[i] for i in some]), y[some]).items():
                    now = getattr(self, name)
                    d = d + (decay * now if name != "bias" else 0)
                    m = moments[name]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * d, 0.999 * m[1] + 0.001 * d * d
                    setattr(self, name, now - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        self.E = self.E.astype(np.float32)
        return self


def fit(sample: DataFrame, seed: int = 7) -> AttentionModel:
    """Encode the bounded sample on the executors and train on the driver."""
    kinds = ("<f4", "<u2", "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            made = [[p.astype(k).tobytes() for p, k in zip(passages(t.as_py(), hashes), kinds, strict=True)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.binary()) for k in range(3)), batch.column(2)], names=["doc_id", "x", "ids", "counts", "y"])

    rows = sorted(sample.mapInArrow(run, "doc_id bigint, x binary, ids binary, counts binary, y int").collect())
    y = np.asarray([r["y"] for r in rows], float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AttentionModel(seed, float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    return model.fit([(np.frombuffer(r["x"], kinds[0]).reshape(-1, N_FEATURES), np.frombuffer(r["ids"], kinds[1]), np.frombuffer(r["counts"], kinds[2])) for r in rows], y)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", block: int = 256, most_bytes: int = 4 << 20) -> DataFrame:
    """Scores documents in blocks of at most `block` rows, a block ending where its texts pass `most_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            ids, texts, held = [], [], 0
            for k, (key, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
                ids.append(key)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if len(ids) == block or held >= most_bytes or k == batch.num_rows:
                    found = model.score(Bags.of([passages(t, hashes) for t in texts]))
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], pa.int64()), pa.array(found, pa.float64())], names=SCORED.fieldNames())
                    ids, texts, held = [], [], 0

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCORED)


def quality_model(docs: DataFrame, labels: DataFrame, bound: int = 8000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns from at most `bound` labelled rows outside the held-out fold. A null, empty or blank text is
    one passage of zeros; without labels of both classes every score is the smoothed rate. Repeated
    rows score alike, a null id is scored and not held in any label. An empty table gives an empty
    result. Only the id and text columns are read.
    """
    model = fit(training_rows(docs, labels, "quality", Scratch(docs.sparkSession, "quality-model"), bound, id_col, text_col))
    return score(docs, model, id_col, text_col).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
