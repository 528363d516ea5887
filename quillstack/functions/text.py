"""Text functions as Column builders; a vectorised UDF only where Spark has no built-in."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the token pattern of coverage and copy checks.
TOKEN_PATTERN = r"[a-z_][a-z0-9_]*(?:'[a-z]+)?|\d+(?:\.\d+)*"
#: Fixed value: three blocks of CJK ideographs.
CJK_PATTERN = "[㐀-䶿一-鿿豈-﫿]"
#: Fixed value: quotes and dashes that are made plain.
PLAIN = {"’": "'", "‘": "'", "“": '"', "”": '"', "—": "-", "–": "-"}
#: A placeholder; texts with more than 999 of them have longer numbers.
MARKER_PATTERN = r"⟦K\d{3,}⟧"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column, compatible: bool = False) -> Column:
    """Plain quotes and dashes, single blanks, trimmed. compatible=True says the text is NFKC already,
    which keeps the expression in the JVM."""
    text = text if compatible else nfkc(text)
    return collapse(F.translate(text, "".join(PLAIN), "".join(PLAIN.values())))


def ascii_tokens(text: Column, compatible: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(normalize_text(text, compatible)), F.lit(TOKEN_PATTERN), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: the planner can't copy it into a lambda or a filter."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, size: int = 5) -> Column:
    """Sliding windows joined by blanks; none if there are too few items."""

    def windows(held: Column) -> Column:
        last = F.size(held) - size
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(held, i + 1, size), " "))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    return let(items, windows)


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK_PATTERN)


#: How a problem is named, and an address with the signs that don't end it.
PROBLEM_PATTERN = r"(?iu)(?:Problem|问题)(?U)\s*[（(]([a-z0-9_]+)"
URL_PATTERN, URL_END = r"https?://[^\s<>\"]+", r"[.,;:!?)\]]+$"


def problem_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PROBLEM_PATTERN), F.lit(1))


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def english_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b[A-Za-z]{2,}\b"))


def masked(text: Column, compatible: bool = False) -> Column:
    """The key of margin mining: lower case, every digit run a #."""
    return F.regexp_replace(F.lower(normalize_text(text, compatible)), r"(?U)\d+", "#")


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, URL_END, ""))))


def heading_level(title: Column) -> Column:
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\s+", 1)
    return F.when(number == "", 2).otherwise(F.least(F.lit(4), F.size(F.split(number, r"\.")) + 1))


def pointer_token(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def token_key(value: Column) -> Column:
    """Registry spelling: trimmed, lower case, hyphens for underscores; blank is null."""
    return F.nullif(F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-")), F.lit(""))


def markdown_quote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(text), "\n"), lambda s: F.when(s == "", ">").otherwise(F.concat(F.lit("> "), s))), "\n")


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([`*_{}\[\]<>#])", r"\\$1")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(needle) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def node_id(page: Column, item: Column, seed: list[Column]) -> Column:
    return F.concat(F.format_string("mu-p%04d-i%04d-", page, item), F.substring(F.sha2(F.concat_ws("\0", *seed).cast("binary"), 256), 1, 24))


#: Entities that table and page texts use; the ampersand comes last, so nothing is resolved twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def strip_markup(text: Column) -> Column:
    """Visible text of HTML: scripts, styles and tags out, the entities of ENTITIES resolved."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return collapse(bare)


#: A hyphen at a line end that belongs to its word, an address that runs over several lines, and
#: the breaks inside it.
_HYPHEN = r"(?<=[A-Za-z])-[ \t]*\n(?=[a-z])"
_BREAK = r"(?:[ \t]*\n[ \t]*|[ \t]+)"
_WRAPPED_URL = rf"(?U)https?://\S++(?:(?<=[./_-]){_BREAK}(?=[a-z0-9])\S++)+"


def repair_linebreaks(text: Column) -> Column:
    """Undo display line wrapping and keep paragraph breaks; an address cut at a line end or blank becomes whole again.

    The text between wrapped addresses and the addresses are taken apart, so breaks vanish only inside these.
    """
    text = F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), _HYPHEN, "-")
    whole = F.transform(F.regexp_extract_all(text, F.lit(_WRAPPED_URL), F.lit(0)), lambda u: F.regexp_replace(u, _BREAK, ""))
    text = F.array_join(F.zip_with(F.split(text, _WRAPPED_URL, -1), whole, lambda between, url: F.concat(between, F.coalesce(url, F.lit("")))), "")
    paragraphs = F.transform(F.split(text, r"[ \t]*\n[ \t]*\n[ \t\n]*", -1), lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t]*\n[ \t]*", " "), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def _math(body: str) -> str:
    return "\\BilingualMath{" + body + "}"


#: What LaTeX needs in place of a character; longer keys win.
LATEX = {
    "\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}",
    "~": "\\textasciitilde{}", "^": "\\textasciicircum{}", "‣": _math("\\blacktriangleright"), "▷": _math("\\triangleright"),
    "\U0001d4a9︀": _math("\\mathcal{N}"), "≤": _math("\\leq"), "≥": _math("\\geq"), "∈": _math("\\in"),
    "ℝ": _math("\\mathbb{R}"), "⊤": _math("\\top"), "𝟙": _math("\\mathbb{1}"), "′": _math("^{\\prime}"), "⋅": _math("\\cdot"),
    "∇": _math("\\nabla"), "⊙": _math("\\odot"), "∑": _math("\\sum"), "ℓ": _math("\\ell"),
}
LATEX |= {c: _math(c) for c in "𝛼𝛽𝜀𝜇𝜎𝜃𝜆𝜏"} | {c: _math(c) for c in [*map(chr, range(0x1D434, 0x1D468)), "ℎ"] if c != "\U0001d455"}
_LATEX_KEYS = re.compile("|".join(map(re.escape, sorted(LATEX, key=len, reverse=True))))


def escaped_latex(text: str) -> str:
    """One pass, so the braces of a replacement are not escaped again."""
    return _LATEX_KEYS.sub(lambda m: LATEX[m[0]], text)


@F.pandas_udf(T.StringType())
def latex_escape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else escaped_latex(s))


@F.pandas_udf(T.StringType())
def collision_key(paths: pd.Series) -> pd.Series:
    """Two paths with one key name the same file on some file system."""
    return paths.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


#: What a table may hold.
TABLE_TAGS = [
    "table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "th", "td", "br", "p", "div", "span",
    "strong", "b", "em", "i", "sup", "sub", "ul", "ol", "li", "code",
]
ANY_TAG = {"align", "valign", "width", "height"}
BY_TAG = {"table": {"border", "cellpadding", "cellspacing"}, "colgroup": {"span"}, "col": {"span"}, "th": {"rowspan", "colspan", "scope"}, "td": {"rowspan", "colspan"}}
WHOLE_NUMBERS = {"width", "height", "border", "cellpadding", "cellspacing", "span", "rowspan", "colspan"}
SCOPES = {"row", "col", "rowgroup", "colgroup"}
MOST = 10_000
#: Fixed value: the page that a table may be wrapped in.
_WRAPPER = re.compile(r"(?is)\A\s*<html\s*>\s*<body\s*>(<table\b.*</table>)\s*</body\s*>\s*</html\s*>\s*\Z")


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.seen = [], [], dict.fromkeys(("table", "row", "cell"), 0)

    def handle_starttag(self, tag, attrs):
        if tag not in TABLE_TAGS:
            raise ValueError(f"tag {tag}")
        for k, v in attrs:
            v = v or ""
            number = v.isascii() and v.isdecimal() and len(v) <= 5 and 1 <= int(v) <= MOST
            if k not in ANY_TAG | BY_TAG.get(tag, set()) or (k in WHOLE_NUMBERS and not number) or (k == "scope" and v.lower() not in SCOPES):
                raise ValueError(f"attribute {k}")
        kind = {"tr": "row", "th": "cell", "td": "cell"}.get(tag, tag)
        if kind in self.seen:
            self.seen[kind] += 1
        if tag == "table":
            if self.open:
                raise ValueError("nested table")
        elif not self.open:
            raise ValueError("content outside the table")
        self.out.append("<" + tag + "".join(f' {k}="{html.escape(v or "")}"' for k, v in sorted(attrs)) + ">")
        if tag not in ("br", "col"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("br", "col"):
            return
        if not self.open or self.open.pop() != tag:
            raise ValueError("unbalanced")
        self.out.append(f"</{tag}>")

    def handle_comment(self, data):
        raise ValueError("comment")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.open and data.strip():
            raise ValueError("content outside the table")
        if self.open:
            self.out.append(html.escape(data, quote=False))


def canonical_table(text: str) -> str | None:
    """The table in canonical form, or None if it holds anything not allowed."""
    parser = _Table()
    try:
        parser.feed(wrapped[1] if (wrapped := _WRAPPER.match(text)) else text)
        parser.close()
    except ValueError:
        return None
    return "".join(parser.out) if parser.seen["table"] == 1 and parser.seen["row"] and parser.seen["cell"] and not parser.open else None


@F.pandas_udf(T.StringType())
def table_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else canonical_table(s))
