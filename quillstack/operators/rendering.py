"""Text assembly: blocks and translations to bilingual Markdown and LaTeX columns, and ordered joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_level, latex_escape, markdown_escape, markdown_quote, repair_linebreaks, table_html


def marker(mode: str = "segment") -> Column:
    return F.concat(F.lit(f"<!-- bilingual:{mode} id="), F.col("id"), F.lit(" source_sha256="), F.col("source_sha256"), F.lit(" -->"))


def visual_markdown(path: Column, alt: Column) -> Column:
    return F.concat(F.lit("!["), markdown_escape(alt), F.lit("]("), path, F.lit(")"))


def visual_latex(path: Column) -> Column:
    size = "width=0.92\\linewidth,height=0.62\\textheight,keepaspectratio"
    return F.concat(F.lit(f"\\begin{{center}}\n\\includegraphics[{size}]{{"), latex_escape(path), F.lit("}\n\\end{center}"))


def empty_glossary(blocks: DataFrame, profile: str, language: str) -> DataFrame:
    """One row: a glossary without terms, bound to the blocks by a digest that no order of rows changes."""
    rows = blocks.agg(F.count(F.lit(1)).alias("source_blocks"), F.coalesce(F.bit_xor(F.xxhash64("id", "source_sha256")), F.lit(0)).alias("source_digest"))
    terms = F.array().cast("array<struct<source:string,targets:array<string>,case_sensitive:boolean,enforce:boolean,notes:string>>")
    return rows.select(F.lit(1).alias("schema_version"), F.lit(profile).alias("profile_id"), F.lit(language).alias("target_language"), "source_blocks", "source_digest", terms.alias("terms"))


def bilingual_markdown(blocks: DataFrame) -> DataFrame:
    """blocks (id, kind, source, source_sha256, translation) with md: marker, source, quoted translation."""
    source, target = markdown_escape(F.col("_s")), markdown_escape(F.col("_t"))

    def framed(mark: str) -> Column:
        return F.concat(F.lit(mark), source, F.lit(mark), F.lit("\n\n"), markdown_quote(F.concat(F.lit(mark), target, F.lit(mark))))

    head = F.concat(F.repeat(F.lit("#"), heading_level(F.col("_s"))), F.lit(" "), source, F.lit("\n\n"), markdown_quote(F.concat(F.lit("**"), target, F.lit("**"))))
    body = F.when(F.col("kind") == "heading", head).when(F.col("kind") == "callout", framed("**")).when(F.col("kind").isin("caption", "caption_continuation"), framed("*")).otherwise(framed(""))
    rows = blocks.withColumn("_s", repair_linebreaks("source")).withColumn("_t", repair_linebreaks("translation"))
    return rows.withColumn("md", F.concat(marker(), F.lit("\n"), body)).drop("_s", "_t")


#: The parts of the typeset forms.
ANCHOR = "\\SegmentAnchor{"
TRANSLATION = ("\\begin{BilingualTranslation}\n", "\n\\end{BilingualTranslation}")
CALLOUT = ("\\begin{BilingualCallout}\n", "\n\\end{BilingualCallout}")
CENTRED = ("\\begin{center}\\small\\itshape\n", "\n\\end{center}")
VERBATIM = ("\\begin{Verbatim}[fontsize=\\small,breaklines=true,breakanywhere=true]\n", "\n\\end{Verbatim}")
TITLES = {2: "section", 3: "subsection", 4: "subsubsection"}
CAPTIONS = ("caption", "caption_continuation")
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
BULLET = r"^\s*[-*+]\s+(.*)$"


def within(ends: tuple[str, str], *body: Column) -> Column:
    return F.concat(F.lit(ends[0]), *body, F.lit(ends[1]))


def titled(source: Column, shown: Column) -> Column:
    level = heading_level(source)
    command = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in TITLES.items()])
    return F.concat(F.lit("\\"), command, F.lit("{"), shown, F.lit("}"))


def anchor() -> Column:
    return F.concat(F.lit(ANCHOR), latex_escape("id"), F.lit("}\n"))


def bilingual_latex(blocks: DataFrame) -> DataFrame:
    """blocks (id, kind, source, translation) with tex: anchor, source and translation by kind."""
    rows = blocks.withColumn("_s", repair_linebreaks("source"))
    rows = rows.withColumn("_es", latex_escape("_s")).withColumn("_et", latex_escape(repair_linebreaks("translation")))
    s, t, kind = F.col("_es"), F.col("_et"), F.col("kind")
    strong = within(TRANSLATION, F.lit("\\textbf{"), t, F.lit("}"))
    body = (
        F.when(kind == "heading", F.concat(titled(F.col("_s"), s), F.lit("\n"), strong))
        .when(kind == "callout", F.concat(within(CALLOUT, s), F.lit("\n"), strong))
        .when(kind.isin(*CAPTIONS), within(CENTRED, s, F.lit("\\par\n\\color{TranslationColor}"), t))
        .otherwise(F.concat(s, F.lit("\n\n"), within(TRANSLATION, t)))
    )
    return rows.withColumn("tex", F.concat(anchor(), body)).drop("_s", "_es", "_et")


def translation_only(blocks: DataFrame) -> DataFrame:
    """blocks (id, source_sha256, translation) with md and tex: the translation alone, under the same marks."""
    md = F.concat(marker(), F.lit("\n"), markdown_quote(markdown_escape(F.col("translation"))))
    tex = F.concat(anchor(), within(TRANSLATION, latex_escape(repair_linebreaks("translation"))))
    return blocks.withColumn("md", md).withColumn("tex", tex)


def bullets(source: Column) -> Column:
    """The list rewritten with dashes if each line that shows something is a bullet; null otherwise."""
    lines = F.filter(F.split(source, LINE_END), lambda s: F.trim(s) != "")
    whole = (F.size(lines) > 0) & F.forall(lines, lambda s: s.rlike(BULLET))
    shown = F.transform(lines, lambda s: F.concat(F.lit("- "), markdown_escape(F.regexp_extract(s, BULLET, 1))))
    return F.when(whole, F.array_join(shown, "\n"))


def source_only_markdown(blocks: DataFrame) -> DataFrame:
    """blocks (id, kind, source, source_sha256) with md: the source by kind; null for a table that is refused."""
    s, kind = F.col("source"), F.col("kind")
    markup = (kind == "table") & F.startswith(F.lower(F.ltrim(s)), F.lit("<table"))
    checked = F.when(table_html(F.when(markup, s)).isNotNull(), within(("```{=html}\n", "\n```"), F.trim(s)))
    body = (
        F.when(kind == "code", within(("```text\n", "\n```"), s))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), heading_level(s)), F.lit(" "), markdown_escape(s)))
        .when(kind.isin(*CAPTIONS), within(("*", "*"), markdown_escape(s)))
        .when(markup, checked)
        .when(kind == "list", F.coalesce(bullets(s), markdown_escape(s)))
        .otherwise(markdown_escape(s))
    )
    return blocks.withColumn("md", F.concat(marker("source-only"), F.lit("\n"), body))


def source_only_latex(blocks: DataFrame) -> DataFrame:
    """blocks (id, kind, source) with tex: the source by kind; code as it stands."""
    rows = blocks.withColumn("_s", repair_linebreaks("source")).withColumn("_es", latex_escape("_s"))
    s, kind = F.col("_es"), F.col("kind")
    body = F.when(kind == "code", within(VERBATIM, F.col("source"))).when(kind == "heading", titled(F.col("_s"), s)).when(kind.isin(*CAPTIONS), within(CENTRED, s)).otherwise(s)
    return rows.withColumn("tex", F.concat(anchor(), body)).drop("_s", "_es")


def document_text(parts: DataFrame, by: str, ord_col: str, text: str) -> DataFrame:
    """by, text: the parts of each document in order, separated by blank lines."""
    listed = F.array_sort(F.collect_list(F.struct(ord_col, text)))
    return parts.groupBy(by).agg(F.array_join(F.transform(listed, lambda p: p[text]), "\n\n").alias(text))
