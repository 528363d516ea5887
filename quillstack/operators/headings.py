"""Bilingual headings and callouts: which heading is the translation of the one before, and which role a text opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_cjk

#: A number before a title, and the lone slash between the halves of a bilingual title.
NUMBER = r"^\s*(\d+(?:\.\d+)*)\s+"
SLASH = r"(?s)^(\S.*?)\s+/\s+(.*\S)\s*$"


def without_number(text: Column, number: Column) -> Column:
    """The text behind its leading number if that is the expected one; the whole text otherwise."""
    own = F.regexp_extract(text, NUMBER, 1)
    return F.when((own != "") & (own == number), F.regexp_replace(text, NUMBER, "")).otherwise(text)


def halves(title: Column) -> tuple[Column, Column, Column]:
    """left, right, whether both exist: a title cut at its first lone slash, foreign on the right side only."""
    left, right = F.regexp_extract(title, SLASH, 1), F.regexp_extract(title, SLASH, 2)
    return left, right, (left != "") & ~title.rlike(r"^\s*/\s") & ~contains_cjk(left) & contains_cjk(right)


def paired_headings(blocks: DataFrame, document: str, ord_col: str) -> DataFrame:
    """document, ord, part, kind, level, text: headings with their translations turned into paragraphs.

    blocks has document, ord, kind (header, rule or another), level and text. A title with a lone slash
    becomes a header and a paragraph; a foreign header right after an English one of its level becomes a
    paragraph, without the number that it repeats; the same English header again goes. Rules in between
    don't part a pair. What a header means depends only on the last block that is no rule, so one window
    by document is enough: a header that goes leaves the same state as the one before it.
    """
    text, header = F.trim(F.col("text")), F.col("kind") == "header"
    left, right, two = halves(F.col("_t"))
    rows = blocks.where("kind <> 'rule'").withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_two", F.coalesce(header & two, F.lit(False)))
    rows = rows.withColumn("_english", F.coalesce(header & ~F.col("_two") & ~contains_cjk(F.col("_t")), F.lit(False)))
    last = F.lag(F.struct("_english", "level", "_t")).over(Window.partitionBy(document).orderBy(ord_col))
    rows = rows.withColumn("_last", last)
    beside = F.coalesce(header & F.col("_last._english") & (F.col("_last.level") == F.col("level")), F.lit(False))

    def block(kind: Column, level: Column, body: Column) -> Column:
        return F.struct(kind.alias("kind"), level.cast("int").alias("level"), body.alias("text"))

    none = F.lit(None).cast("int")
    para = F.lit("paragraph")
    same = block(F.col("kind"), F.col("level"), F.col("text"))
    split = F.array(block(F.lit("header"), F.col("level"), left), block(para, none, without_number(right, F.regexp_extract(left, NUMBER, 1))))
    twin = F.array(block(para, none, without_number(F.col("_t"), F.regexp_extract("_last._t", NUMBER, 1))))
    out = F.when(F.col("_two"), split).when(beside & (F.col("_last._t") == F.col("_t")), F.filter(F.array(same), lambda _: F.lit(False))).when(beside & contains_cjk(F.col("_t")), twin).otherwise(F.array(same))
    shown = rows.select(document, ord_col, F.posexplode(out).alias("part", "_b")).select(document, ord_col, "part", "_b.*")
    rules = blocks.where("kind = 'rule'").select(document, ord_col, F.lit(0).alias("part"), "kind", F.col("level").cast("int").alias("level"), "text")
    return shown.unionByName(rules)


def callout_role(text: Column, roles: list[tuple[str, str | None, str | None]], with_target: bool = True) -> Column:
    """The first role (role, source pattern, target pattern) found in the text, source patterns first; null if none."""
    trimmed = F.trim(text)
    found = [(role, pattern) for k in ((1, 2) if with_target else (1,)) for role, pattern in ((r[0], r[k]) for r in roles) if pattern]
    return F.coalesce(*[F.when(trimmed.rlike("(?i)" + pattern), F.lit(role)) for role, pattern in found], F.lit(None).cast("string"))


def bold_label(text: Column, runs: Column, most: int = 90) -> Column:
    """Whether all runs (text, bold) that show something are bold, at least one does, and the text is short."""
    shown = F.filter(runs, lambda r: F.trim(r["text"]) != "")
    return (F.size(shown) > 0) & F.forall(shown, lambda r: F.coalesce(r["bold"], F.lit(False))) & (F.length(F.trim(text)) <= most)


#: Lines of a typesetting log that count as faults.
LOG_LINES = {
    "missing_character": r"^Missing character:",
    "undefined_reference": r"Reference .* undefined|There were undefined references",
    "overfull_box": r"^Overfull \\hbox",
}


def log_findings(logs: DataFrame, key: str, text: str) -> DataFrame:
    """key, check, line_no, line: the lines of each log that match a fault."""
    lines = logs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    checks = F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in LOG_LINES.items()])
    return lines.select(key, F.explode(F.array_compact(checks)).alias("check"), "line_no", "line")


def reported_pages(text: Column) -> Column:
    """The page count that a tool reports on a line of its own; null if it reports none."""
    return F.nullif(F.regexp_extract(text, r"(?m)^Pages:\s+(\d+)\s*$", 1), F.lit("")).cast("int")


def font_rows(listing: Column) -> Column:
    """The rows of a font table below its two head lines."""
    lines = F.split(listing, "\n")
    return F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda s: F.trim(s) != "")


def all_embedded(listing: Column) -> Column:
    """Whether every row of a font table says embedded; true for an empty table."""
    return F.forall(font_rows(listing), lambda s: s.rlike(r"\s+yes\s+(?:yes|no)\s+"))
