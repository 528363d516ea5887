"""Classification: declarative selectors compiled to predicates, and ordered decision lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, token_key

#: Adapter roles that count as generic, and auxiliary role aliases.
GENERIC = ["heading", "paragraph"]
AUXILIARY = {"header": "page-header", "footer": "page-footer", "page-number": "page-number", "aside-text": "marginalia"}
#: The patterns of block kinds, in the order in which `block_kind` tries them.
CALLOUTS = "Problem|Example|Low-Resource Tip"
PAGE_NUMBER = r"^\d+$"
SYMBOLS, LONG_WORDS, EQUATION_NUMBER = "[=∑√∫∏≤≥≠≈→←⊤⊥⋅×⊙]", r"(?U)\b[A-Za-z]{3,}\b", r"\(\d+\)\s*$"
WHERE, CAPTION, CALLOUT = r"(?iu)^where\b", r"(?iu)^(Figure|Table|Algorithm)\s+\d+\s*:", rf"(?iu)^({CALLOUTS})\s*[(:]"
NUMBERED_TITLE, LIST_ITEM = r"^\d+(?:\.\d+)*\s+\S", r"(?iu)^(?:[•*-]|\d+[.)]|\([a-z]\))\s+"


#: Fixed value: \b between letters, digits and signs of ASCII alone; what Java's \b means depends on its version.
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def source_regex(pattern: str, ascii_only: bool = False) -> str:
    r"""The pattern without regard to case; with `ascii_only`, \b, \w, \d and \s know ASCII alone, as those of RE2 do."""
    if not ascii_only:
        return "(?iuU)" + pattern
    return "(?i)" + re.sub(r"\\(.)", lambda m: ASCII_EDGE if m[1] == "b" else m[0], pattern, flags=re.S)


def selector_predicate(selector: dict, ascii_only: bool = False) -> tuple[Column, list[str]]:
    """The predicate of one selector over columns adapter_role, node_type, sub_type, text_level, source."""
    tests, fields = [], []
    keyed = lambda values: [v.strip().lower().replace("_", "-") for v in values]
    for field, column in (("adapter_role", "adapter_role"), ("node_types", "node_type"), ("sub_types", "sub_type")):
        if field in selector:
            values = selector[field] if isinstance(selector[field], list) else [selector[field]]
            tests.append(F.coalesce(token_key(F.col(column)).isin(keyed(values)), F.lit(False)))
            fields.append(field)
    if "text_levels" in selector:
        tests.append(F.coalesce(F.col("text_level").isin(selector["text_levels"]), F.lit(False)))
        fields.append("text_levels")
    if "source_pattern" in selector:
        tests.append(F.coalesce(F.trim(F.col("source")).rlike(source_regex(selector["source_pattern"], ascii_only)), F.lit(False)))
        fields.append("source_pattern")
    whole = F.lit(bool(tests))
    for t in tests:
        whole = whole & t
    return whole, fields


def classify(blocks: DataFrame, roles: list[dict], ascii_only: bool = False) -> DataFrame:
    """blocks with role, tier and selector of the best match, null without one.

    A match ranks by tier (adapter role 4, subtype 3, pattern 2, else 1; a generic adapter role doesn't
    make tier 4), then by how many fields it tests, then by the order of roles and selectors. The whole
    profile becomes one expression: no join, no shuffle, one pass. Patterns know all letters, or those of
    ASCII only (see source_regex).
    """
    generic = F.coalesce(token_key(F.col("adapter_role")).isin(GENERIC), F.lit(False))
    ranked = []
    for ri, role in enumerate(roles):
        for si, selector in enumerate(role["selectors"]):
            matched, fields = selector_predicate(selector, ascii_only)
            lower = 3 if "sub_types" in fields else 2 if "source_pattern" in fields else 1
            tier = F.when(~generic, 4).otherwise(lower) if "adapter_role" in fields else F.lit(lower)
            best = F.struct(tier.alias("tier"), F.lit(len(fields)).alias("n"), F.lit(-ri).alias("r"), F.lit(-si).alias("s"), F.lit(role["role"]).alias("role"))
            ranked.append(F.when(matched, best))
    if not ranked:
        return blocks.select("*", F.lit(None).cast("string").alias("role"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("selector"))
    won = let(F.array_max(F.array(*ranked)), lambda w: F.struct(w["role"].alias("role"), w["tier"].alias("tier"), (-w["s"]).alias("selector")))
    # a generator of one row: filters on the winner can't copy the predicates of the profile into what reads this
    return blocks.select("*", F.inline(F.array(won)))


def auxiliary_role(adapter_role: Column) -> Column:
    key = token_key(adapter_role)
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in AUXILIARY.items()], F.when(key.isin(sorted(set(AUXILIARY.values()))), key))


def block_kind(text: Column, mono: Column, math: Column, bold: Column, font: Column, lines: Column, repeated: Column, near_top: Column, near_bottom: Column) -> Column:
    """The ordered decision list of block kinds over normalised text and its statistics."""
    n = F.length(text)
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    words = F.regexp_count(text, F.lit(LONG_WORDS))
    formula = (symbols >= 1) & ((lines >= 2) | text.rlike(EQUATION_NUMBER)) & (words <= 4)
    mathy = ((math >= 0.55) | formula) & (n <= 500)
    return (
        F.when(text == "", "empty")
        .when(near_bottom & text.rlike(PAGE_NUMBER), "artifact")
        .when((near_top | near_bottom) & repeated, "artifact")
        .when(mono >= 0.80, "code")
        .when(mathy & text.rlike(WHERE), "math_with_text")
        .when(mathy, "math")
        .when(text.rlike(CAPTION), "caption")
        .when(text.rlike(CALLOUT), "callout")
        .when((n <= 220) & (text.rlike(NUMBERED_TITLE) | (font >= 14) | (bold >= 0.72)), "heading")
        .when(text.rlike(LIST_ITEM), "list")
        .otherwise("prose")
    )


#: Parts of font names that mean mathematics.
MATH_FONTS = ["math", "cmmi", "cmsy", "cmex", "msam", "msbm"]


def font_role(font: Column) -> Column:
    """math or code by the letters and digits of a font name, else null."""
    name = F.lower(F.regexp_replace(font, "[^A-Za-z0-9]", ""))
    return F.when(name.rlike("|".join(MATH_FONTS)), "math").when(name.rlike("mono|courier"), "code")


def translatable(kind: Column) -> Column:
    return ~kind.isin("artifact", "code", "math")


def output_policy(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """nodes with the style and output of their role; the role table is a profile of a few dozen rows."""
    return nodes.join(F.broadcast(roles.select("role", F.col("style").alias("_style"), F.col("output").alias("_output"))), "role", "left").select(
        *[nodes[c] for c in nodes.columns], F.coalesce("_style", F.lit("plain")).alias("style"), F.coalesce("_output", F.lit("source-only")).alias("output")
    )


def review_reasons(pages: DataFrame) -> DataFrame:
    """pages with reasons for manual review, from five independent tests.

    Columns: native_chars, adapter_chars, blocks, raster_ratio, min_chars, source_ratio, display_ratio.
    """
    tests = {
        "no_blocks": F.col("blocks") == 0,
        "sparse_native_text": F.col("native_chars") < F.col("min_chars"),
        "adapter_text_exceeds_native": (F.col("native_chars") > 0) & (F.col("native_chars") < F.col("min_chars")) & (F.col("adapter_chars") >= 2 * F.col("native_chars")),
        "large_raster": F.col("raster_ratio") >= 0.5,
        "page_ratio": F.least(F.abs(F.col("source_ratio") - F.col("display_ratio")), F.abs(F.col("source_ratio") - 1 / F.col("display_ratio"))) > 0.02,
    }
    return pages.withColumn("reasons", F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull()))
