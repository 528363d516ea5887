"""Toxicity: a sparse logistic classifier with counterfactual regularisation.

Features are whole words and word beginnings of three to seven letters, by presence. Those that tell
the classes apart in the labelled sample are kept, together with every identity term. Training
minimises log loss with an L1 penalty, plus a penalty on how far the logit moves between a labelled
text and its counterfactuals, so that a neutral mention of a group can't raise the score. A
counterfactual is the text with an identity term swapped for another of its kind; since few texts
hold one, every labelled text also gets a term planted in it (text against text with the mention) and
that term swapped. Features are always those of the whole changed text. Scoring is one pass over the
texts, with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .common import Scratch, id_crc
from .labelled import held_out, training_rows

#: Identity terms by kind; a term is swapped for every other of its kind. A parameter of training.
IDENTITY_TERMS = (
    # English
    ("women", "men"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    # German
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"),
    ("schwule", "lesben", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "blinde", "gehörlose"),
    # French
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"),
    ("homosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "aveugles", "sourds"),
    # Spanish
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"),
    ("homosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "ciegos", "sordos"),
)
LETTERS = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6, 7)


def token_features(token: str) -> tuple[str, ...]:
    """Features of one blank-separated token."""
    out = []
    for word in LETTERS.findall(token.lower()):
        out.append(word)
        out += ["^" + word[:n] for n in BEGINNINGS if len(word) >= n]
    return tuple(out)


def text_features(text: str) -> set[str]:
    return {f for token in set(text.split()) for f in token_features(token)}


def counterfactuals(text: str, seed: int, terms=IDENTITY_TERMS) -> Iterator[tuple[str, str]]:
    """Pairs of texts that ought to score alike: each identity term swapped for every other of its kind,
    one planted mention (without it, with it), and the planted term swapped."""
    words = set(LETTERS.findall(text.lower()))
    for kind in terms:
        for a in kind:
            for b in kind if a in words else ():
                if a != b:
                    yield text, LETTERS.sub(lambda m, a=a, b=b: b if m[0].lower() == a else m[0], text)
    if terms:
        kind = terms[seed % len(terms)]
        a, b = kind[seed // 31 % len(kind)], kind[(seed // 31 + 1) % len(kind)]
        yield text, f"{text} {a}"
        if a != b:
            yield f"{text} {a}", f"{text} {b}"


@dataclass
class Model:
    """`pairs` is how many counterfactual pairs it was trained on."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def logit(self, features: set[str]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features)


class _Sparse:
    """A 0, 1, -1 matrix given by the signed column numbers of its rows (k + 1 or -k - 1)."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        flat = np.asarray([i for r in rows for i in r], np.int64)
        self.ids, self.sign = np.abs(flat) - 1, np.sign(flat).astype(float)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.sign * v[self.ids], self.n) if self.n else np.zeros(0)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.sign * g[self.at], self.width) if self.n else np.zeros(self.width)


def train(rows: list[tuple[list[int], int]], moves: list[list[int]], names: list[str], l1: float = 1e-4, counterfactual: float = 5.0, rounds: int = 400) -> Model:
    """Accelerated proximal gradient descent.

    rows: (feature ids, label). moves: for each counterfactual pair the features that come (id + 1) and
    go (-id - 1); their term is the mean squared change of the logit. Without both labels the model is
    the smoothed rate.
    """
    y = np.asarray([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(rate / (1 - rate))))
    n, k = len(rows), len(names)
    x, pairs = _Sparse([[i + 1 for i in r[0]] for r in rows], k), _Sparse(moves, k)
    strength = 2 * counterfactual / max(1, pairs.n)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))

    # the Lipschitz constant of the smooth part, by power iteration with a margin
    u, ub, norm = np.ones(k), 1.0, 1.0
    for _ in range(50):
        z = x.times(u) + ub
        u, ub = 0.25 * x.transposed(z) / n + strength * pairs.transposed(pairs.times(u)), 0.25 * z.mean()
        norm = float(np.sqrt((u * u).sum() + ub * ub)) or 1.0
        u, ub = u / norm, ub / norm
    step = 1.0 / (1.2 * norm)

    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x.times(v) + vb, -40, 40))) - y
        grad = x.transposed(g) / n + strength * pairs.transposed(pairs.times(v))
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b), pairs.n)


def moved_features(before: str, after: str, index: dict[str, int]) -> list[int]:
    """What a change of a text does to its features: id + 1 for each that comes, -id - 1 for each that goes."""
    a, b = text_features(before), text_features(after)
    return sorted([index[f] + 1 for f in b - a if f in index] + [-index[f] - 1 for f in a - b if f in index])


@dataclass(frozen=True)
class Features:
    """Which features of the labelled sample take part: the `most` strongest of those seen in at least
    `least_rows` texts, whose log odds between the classes are at least `least_odds`; a feature longer
    than `longest` letters (no word of a language) would only remember one text. Bounds of training:
    scoring reads whole texts."""

    most: int = 4000
    least_rows: int = 2
    least_odds: float = 1.5
    longest: int = 64


def fit(sample: DataFrame, features: Features = Features(), terms=IDENTITY_TERMS, **options) -> Model:
    """Choose features by their counts in the sample, then train on the driver.

    What reaches the driver is bounded by the sample and `features`.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found = list(text_features(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y.as_py()] * len(found), pa.int32())], names=["feature", "y"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return train([([], y) for y, n in sizes.items() for _ in range(n)], [], [])
    counts = sample.select("text", "y").mapInArrow(listed, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    strong = counts.where((F.col("a") + F.col("b") >= features.least_rows) & (F.length("feature") <= features.longest)).withColumn("odds", odds).where(F.abs("odds") >= features.least_odds)
    best = strong.orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("a") + F.col("b"))), "feature").limit(features.most)
    names = [r["feature"] for r in best.select("feature").collect()]
    always = sorted({f for kind in terms for a in kind for f in token_features(a)} - set(names))
    names += always
    index = {f: i for i, f in enumerate(names)}

    def rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, moves = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(sorted(index[f] for f in text_features(text) if f in index))
                changed = (moved_features(*pair, index) for pair in counterfactuals(text, id_crc(key), terms))
                moves.append([m for m in changed if m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2), pa.array(moves, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "ids", "y", "moves"])

    rows = sorted(sample.mapInArrow(rowed, "doc_id bigint, ids array<int>, y int, moves array<array<int>>").collect())
    return train([(r["ids"], r["y"]) for r in rows], [m for r in rows for m in r["moves"]], names, **options)


def scorer(model: Model):
    """A function of the text column; only texts cross to Python, the rest of a row stays in the JVM."""
    weights, bias = model.weights, model.bias
    memo = Memo(lambda token: tuple(f for f in token_features(token) if f in weights), 200_000)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                held = set().union(*map(memo.__getitem__, (text or "").split()))
                z = bias + sum(weights[f] for f in sorted(held))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(run, T.DoubleType(), F.PandasUDFType.SCALAR_ITER)


def fitted(docs: DataFrame, labels: DataFrame, bound: int = 8000, id_col: str = "doc_id", text_col: str = "text", terms=IDENTITY_TERMS) -> Model:
    return fit(training_rows(docs, labels, "toxic", Scratch(docs.sparkSession, "toxicity"), bound, id_col, text_col), terms=terms)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 8000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", terms=IDENTITY_TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns from at most `bound` labelled rows outside the held-out fold. Null and empty texts get the
    bias alone; without labels of both classes every score is the smoothed rate. Repeated rows score
    alike, a null id is scored and not held in any label. An empty table gives an empty result. Only
    the id and text columns are read, so neither labels nor other columns can enter a score.
    """
    score = scorer(fitted(docs, labels, bound, id_col, text_col, terms))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def mild_documents(docs: DataFrame, labels: DataFrame, bound: int = 8000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    score = scorer(fitted(docs, labels, bound, id_col, text_col))
    rows = docs.select(F.struct("*").alias("_row"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("_score"))
    return rows.where(F.col("_score") < threshold).select("_row.*")
