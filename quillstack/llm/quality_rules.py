"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). A latent-class model of the votes is fitted by
expectation-maximisation over the counts of vote patterns of the whole corpus: with R rules there
are at most 3**R patterns (2,187 here), whatever the number of documents, so this table is the only
thing that reaches the driver. The posterior probability of good quality then replaces the usual
all-rules-must-pass filter. Repeated three-word windows are found inside each row by hashing and
sorting, without exploding words over a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

CAPITALS = "A-ZÀ-ÖØ-Þ"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def repeated_words(words: Column) -> Column:
    """Words lying in a three-word window that occurs at least twice; windows are 64-bit hashes.

    Sorting the bare hashes shows which repeat. Few of them are looked up in place; where there are
    many, the windows are sorted with their positions instead, so no text costs quadratic time.
    """

    def covered(hashes: Column) -> Column:
        def cover(places: Column) -> Column:
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

        def by_sort(tagged: Column) -> Column:
            twice = F.filter(tagged, lambda x, k: (F.get(tagged, k - 1)["h"] == x["h"]) | (F.get(tagged, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def placed(repeated: Column) -> Column:
            few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull())
            many = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_sort)
            return F.when(F.size(repeated) <= 12, few).otherwise(many)

        repeated = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(cover(let(repeated, placed)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts of every whole text, and what the rules look at besides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\t-\\r]"))
    in_words = let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars")))
    in_lines = let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *carry,
        in_words.alias("_w"),
        in_lines.alias("_l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(f"[{CAPITALS}]")).cast("long").alias("n_capitals"),
        (F.size(F.split(text, "!")) - 1).cast("long").alias("n_shouts"),
    ).select("doc_id", *carry, "_w.*", "_l.*", "n_symbols", "n_capitals", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """Votes bad above `bad`, good up to `good`, abstains in between or where the measure is null.

    A rule that looks for one kind of junk has no `good`: not finding it says little, and counting
    that as a vote would let five silent rules outvote the one that found something.
    """

    name: str
    measure: str
    good: float | None = None
    bad: float | None = None


RULES = (
    Rule("symbols", "n_symbols / n_words", bad=0.25),
    Rule("repetition", "n_repeat_words / n_words", bad=0.30),
    Rule("duplicate_lines", "case when n_lines >= 8 then n_dup_lines / n_lines end", bad=0.50),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", bad=0.50),
    Rule("shouting", "n_shouts / n_words", bad=0.30),
    Rule("word_length", "abs(ln(word_chars / n_words) - ln(5))", bad=1.5),
    Rule("plain", "greatest(10 * n_symbols / n_words, 4 * n_repeat_words / n_words, 4 * n_capitals / greatest(word_chars, 1), 20 * n_shouts / n_words)", good=1.0),
)


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    out = []
    for r in rules:
        x = F.expr(f"case when n_words > 0 then cast({r.measure} as double) end")
        vote = F.when(x > r.bad, -1) if r.bad is not None else F.when(F.lit(False), 0)
        out.append((vote.when(x <= r.good, 1) if r.good is not None else vote).otherwise(0).alias(f"vote_{r.name}"))
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, strength: float = 20.0) -> dict:
    """EM for two classes with a vote distribution for each rule and class.

    The Dirichlet priors say only that rules seldom condemn a good document and that junk seldom looks
    plain; they carry `strength` pseudo-votes, so the corpus outweighs them, and with no documents
    they are the model.
    """
    start = {1: {1: 0.60, 0: 0.398, -1: 0.002}, 0: {1: 0.05, 0: 0.65, -1: 0.30}}
    theta = {y: [dict(start[y]) for _ in range(n_rules)] for y in (0, 1)}
    prior, before = 0.9, None
    for _ in range(rounds):
        mass, counts = {0: 0.0, 1: 0.0}, {y: [{v: strength * start[y][v] for v in (-1, 0, 1)} for _ in range(n_rules)] for y in (0, 1)}
        total = 0.0
        for pattern, n in patterns:
            logs = {y: math.log(prior if y else 1 - prior) + sum(math.log(theta[y][r][v]) for r, v in enumerate(pattern)) for y in (0, 1)}
            top = max(logs.values())
            norm = sum(math.exp(x - top) for x in logs.values())
            total += n * (top + math.log(norm))
            for y in (0, 1):
                p = math.exp(logs[y] - top) / norm * n
                mass[y] += p
                for r, v in enumerate(pattern):
                    counts[y][r][v] += p
        prior = (mass[1] + 0.9 * strength) / (mass[0] + mass[1] + strength)
        theta = {y: [{v: c / sum(cs.values()) for v, c in cs.items()} for cs in counts[y]] for y in (0, 1)}
        if before is not None and abs(total - before) < 1e-9 * max(1.0, abs(total)):
            break
        before = total
    return {"prior": prior, "theta": theta}


def posterior(model: dict, rules: tuple[Rule, ...] = RULES) -> Column:
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, rule in enumerate(rules):
        w = {v: math.log(model["theta"][1][r][v] / model["theta"][0][r][v]) for v in (-1, 0, 1)}
        c = F.col(f"vote_{rule.name}")
        score = score + F.when(c == 1, w[1]).when(c == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-score))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, kept, quality_probability: one row per input row.

    Null and empty texts have no words, fail the base rules and are not kept; every rule abstains on
    them. Repeated rows are scored alike. An empty table gives an empty result with the model left at
    its priors. Columns of the input other than the id and text are ignored.
    """
    found = Scratch(docs.sparkSession, "quality").keep(features(docs, id_col, text_col), "features")
    out = judged(found, learn(found)).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
    return out.select("doc_id", *BASE, "base_failed", "kept", "quality_probability")


def learn(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict:
    names = [f"vote_{r.name}" for r in rules]
    counted = found.select(*votes(rules)).groupBy(*names).count().collect()
    return fit([(tuple(row[n] for n in names), row["count"]) for row in counted], len(rules))


def judged(found: DataFrame, model: dict, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return found.select("*", *votes(rules)).select("*", posterior(model, rules).alias("quality_probability"), base_failed().alias("base_failed"))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    Features are computed once to fit the model and again to filter, so no text is shuffled or copied;
    the original row travels as one struct, so its columns may have any name.
    """
    model = learn(features(docs, id_col, text_col))
    found = features(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col), F.struct("*").alias("_row")), id_col, text_col, ("_row",))
    return judged(found, model).where(~F.col("base_failed") & (F.col("quality_probability") >= threshold)).select("_row.*")
