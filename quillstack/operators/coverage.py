"""N-gram coverage of one text by others, and copy ratios between paired texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens, let, ngrams, nfkc


def grams_of(rows: DataFrame, key: str, text: str, size: int = 5, compatible: bool = False) -> DataFrame:
    """key, gram: every n-gram, with repeats; a key without grams keeps one row with a null gram.

    explode_outer keeps the tokenizer from being inlined into an inferred filter on the array.
    """
    tokens = rows.select(key, ascii_tokens(F.col(text), compatible).alias("tokens"))
    return tokens.select(key, F.explode_outer(ngrams(F.col("tokens"), size)).alias("gram"))


#: Up to so many different n-grams of the oracle are marked in a table of at most 16 MB that every task gets.
MOST_GRAMS, SLOTS_A_GRAM, LEAST_SLOTS = 1_000_000, 16, 1 << 16


def slot_table(grams: DataFrame) -> bytes | None:
    """One byte for each slot, 1 where the hash of some gram falls; None if there are too many grams."""
    n = grams.limit(MOST_GRAMS + 1).count()
    if n > MOST_GRAMS:
        return None
    slots = max(LEAST_SLOTS, 1 << (max(1, n) * SLOTS_A_GRAM - 1).bit_length())
    held = grams.select(F.pmod(gram_hash(F.split("gram", " ")), F.lit(slots)).cast("int").alias("slot")).distinct().toArrow()
    table = np.zeros(slots, "u1")
    table[held.column("slot").to_numpy()] = 1
    return table.tobytes()


def gram_hash(tokens: Column) -> Column:
    return F.xxhash64(tokens)


def marked_grams(rows: DataFrame, text: str, table: bytes, size: int, compatible: bool) -> DataFrame:
    """gram: the n-grams whose slot is marked. The others are seen by their hash alone, inside the row."""
    slots, mark = len(table), F.lit(b"\x01")

    def marked(held: Column) -> Column:
        gram = lambda i: F.slice(held, i + 1, size)
        starts = F.filter(F.sequence(F.lit(0), F.size(held) - size), lambda i: F.substring(F.lit(table), F.pmod(gram_hash(gram(i)), F.lit(slots)).cast("int") + 1, F.lit(1)) == mark)
        found = F.transform(starts, lambda i: F.array_join(gram(i), " "))
        return F.when(F.size(held) >= size, found).otherwise(F.array().cast("array<string>"))

    return rows.select(F.explode(let(ascii_tokens(F.col(text), compatible), marked)).alias("gram"))


def coverage(oracle: DataFrame, extracted: DataFrame, key: str, text: str, extracted_text: str, size: int = 5, compatible: bool = False) -> DataFrame:
    """key, hits, total, score: how many of an oracle text's n-grams, with multiplicity, occur anywhere
    in the extracted texts; 1.0 where there are none.

    The grams of the oracle are marked in a table of slots, which is probed inside each extracted text:
    only grams at a marked slot become strings and are shuffled, and the strings then decide. An oracle
    with too many grams for a table is joined by 64-bit hashes instead.
    """
    wanted = grams_of(oracle, key, text, size, compatible)
    grams = wanted.where("gram is not null").select("gram").distinct()
    table = slot_table(grams)
    if table is not None:
        if not compatible:  # a Python function can't stand below the lambda
            extracted = extracted.withColumn(extracted_text, nfkc(F.col(extracted_text)))
        there = marked_grams(extracted, extracted_text, table, size, True)
    else:
        hashes = grams.select(F.xxhash64("gram").alias("_h")).distinct()
        there = grams_of(extracted.withColumn("_one", F.lit(1)), "_one", extracted_text, size, compatible).select("gram", F.xxhash64("gram").alias("_h"))
        there = there.join(hashes, "_h", "left_semi").select("gram")
    found = there.distinct().withColumn("_hit", F.lit(1))
    scored = wanted.join(found, "gram", "left").groupBy(key).agg(F.count("_hit").alias("hits"), F.count("gram").alias("total"))
    return scored.withColumn("score", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(1.0))


def coverage_total(scored: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: hits, total, score, status; an empty table scores 1.0."""
    both = scored.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    both = both.withColumn("score", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(1.0))
    return both.withColumn("status", F.when(F.col("score") >= least, "passed").otherwise("failed"))


def copy_ratio(pairs: DataFrame, source: str, target: str, least_grams: int = 8, most: float = 0.80, compatible: bool = False) -> DataFrame:
    """pairs with grams, copied, ratio and is_copy: the share of source n-grams found in the target, row by row.

    Grams of both texts are counted in one sorted list of (gram, side), so a pair of long texts costs a
    sort and not a comparison of all with all.
    """
    if not compatible:  # a Python function can't stand inside the n-gram lambda
        pairs = pairs.withColumn("_a", nfkc(F.col(source))).withColumn("_b", nfkc(F.col(target)))
    a, b = (F.col(source), F.col(target)) if compatible else (F.col("_a"), F.col("_b"))

    def counted(own: Column, other: Column) -> Column:
        """grams and copied: what the other text lacks is found as a set; only a mixed text is sorted."""

        def of(lacking: Column) -> Column:
            marked = F.concat(F.transform(lacking, lambda g: F.struct(g.alias("g"), F.lit(0).alias("k"))), F.transform(own, lambda g: F.struct(g.alias("g"), F.lit(1).alias("k"))))
            start = F.struct(F.lit("").alias("g"), F.lit(0).alias("n"))
            step = lambda acc, x: F.struct(F.when(x["k"] == 0, x["g"]).otherwise(acc["g"]).alias("g"), (acc["n"] + ((x["k"] == 1) & (acc["g"] == x["g"])).cast("int")).alias("n"))
            absent = F.aggregate(F.array_sort(marked), start, step)["n"]
            copied = F.when(F.size(lacking) == 0, F.size(own)).when(F.size(lacking) == F.size(own), 0).otherwise(F.size(own) - absent)
            return F.struct(F.size(own).alias("grams"), copied.alias("copied"))

        return let(F.array_except(own, other), of)

    rows = pairs.withColumn("_c", let(ngrams(ascii_tokens(a, True)), lambda own: let(ngrams(ascii_tokens(b, True)), lambda other: counted(own, other)))).drop("_a", "_b")
    rows = rows.withColumn("grams", F.col("_c.grams")).withColumn("copied", F.col("_c.copied"))
    rows = rows.withColumn("ratio", F.when(F.col("grams") > 0, F.col("copied") / F.col("grams")).otherwise(0.0))
    return rows.withColumn("is_copy", (F.col("grams") >= least_grams) & (F.col("ratio") >= most)).drop("_c")
