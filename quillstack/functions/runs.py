"""Inline content of a block as an array of runs, and what is done to it, as Column builders.

A run is a leaf of the inline tree (kind, text) with the containers it lies in, outermost first:
marks (kind, at), where `at` tells two neighbouring containers of a kind apart. So cutting a tree of
inlines is cutting an array, and everything stays in one expression of the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_cjk, let

RUN = "struct<kind:string,text:string,marks:array<struct<kind:string,at:int>>>"
RUNS = f"array<{RUN}>"
MARKS = "array<struct<kind:string,at:int>>"

#: Runs that show as a blank, those that end a line, and containers whose content is cleaned or cut.
BLANKS = ("Space", "SoftBreak", "LineBreak")
BREAKS = ("SoftBreak", "LineBreak")
CLEANED = ("Strong", "Emph", "Span", "Quoted", "Link", "Image")
CUT = ("Strong", "Emph")


def run(kind: str | Column, text: Column | None = None, marks: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lit(None).cast("string") if text is None else text
    marks = F.array().cast(MARKS) if marks is None else marks
    return F.struct(kind.alias("kind"), text.alias("text"), marks.alias("marks"))


def no_runs() -> Column:
    return F.array().cast(RUNS)


def shown(runs: Column) -> Column:
    """The text of the runs."""
    return F.array_join(F.transform(runs, lambda r: F.when(r["kind"].isin(*BLANKS), " ").otherwise(F.coalesce(r["text"], F.lit("")))), "")


def words(text: Column) -> Column:
    """The words of a text as runs with a blank between each two."""
    found = F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")
    return F.flatten(F.transform(found, lambda w, i: F.when(i == 0, F.array(run("Str", w))).otherwise(F.array(run("Space"), run("Str", w)))))


def positions(runs: Column) -> Column:
    return F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.size(runs))).otherwise(F.array().cast("array<int>"))


def lines(runs: Column) -> Column:
    """The runs between breaks that lie in no container; empty lines go."""

    def cut(held: Column) -> Column:
        ends = F.filter(positions(held), lambda i: F.element_at(held, i)["kind"].isin(*BREAKS) & (F.size(F.element_at(held, i)["marks"]) == 0))

        def between(bounds: Column) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(held, F.element_at(bounds, k) + 1, F.element_at(bounds, k + 1) - F.element_at(bounds, k) - 1))
            return F.filter(each, lambda line: F.size(line) > 0)

        return let(F.concat(F.array(F.lit(0)), ends, F.array(F.size(held) + 1)), between)

    return let(runs, cut)


def without_stars(runs: Column) -> Column:
    """Literal ** around a whole word makes it strong, other ** go; code and mathematics stay as they are."""

    def clean(r: Column, i: Column) -> Column:
        inner = F.regexp_extract(r["text"], r"\A\*\*(.+)\*\*\z", 1)
        strong = F.concat(r["marks"], F.array(F.struct(F.lit("Strong").alias("kind"), (i + 1_000_000).cast("int").alias("at"))))
        made = F.when(inner != "", run("Str", inner, strong)).otherwise(run("Str", F.replace(r["text"], F.lit("**"), F.lit("")), r["marks"]))
        return F.when((r["kind"] == "Str") & F.contains(r["text"], F.lit("**")) & F.forall(r["marks"], lambda m: m["kind"].isin(*CLEANED)), made).otherwise(r)

    return F.transform(runs, clean)


def within(run_: Column, container: Column) -> Column:
    """Whether a run lies in the container that these marks describe."""
    return F.slice(run_["marks"], 1, F.size(container)) == container


def halves(runs: Column) -> Column:
    """[left, right] of a bilingual line, or [runs].

    The slash stands alone, behind it is the foreign half. It may stand in a strong or emphasised
    container, which is then cut alone. Of each container only the first slash counts, and none behind
    a slash of a container around it.
    """

    def cut(held: Column) -> Column:
        at = lambda i: F.element_at(held, i)
        slashes = F.filter(positions(held), lambda i: (at(i)["kind"] == "Str") & (at(i)["text"] == "/") & F.forall(at(i)["marks"], lambda m: m["kind"].isin(*CUT)))

        def first(found: Column) -> Column:
            open_ = F.filter(found, lambda i: ~F.exists(found, lambda j: (j < i) & within(at(i), at(j)["marks"])))
            part = lambda i, lo, n: F.filter(F.slice(held, lo, n), lambda r: within(r, at(i)["marks"]))
            full = lambda i: lambda r: ~((r["kind"] == "Space") & (F.size(r["marks"]) == F.size(at(i)["marks"])))

            def sides(i: Column) -> Column:
                def trimmed(left: Column, right: Column) -> Column:
                    end = F.coalesce(F.array_max(F.filter(positions(left), lambda k: full(i)(F.element_at(left, k)))), F.lit(0))
                    start = F.coalesce(F.array_min(F.filter(positions(right), lambda k: full(i)(F.element_at(right, k)))), F.size(right) + 1)
                    return F.array(F.slice(left, 1, end), F.slice(right, start, F.size(right)))

                return let(part(i, F.lit(1), i - 1), lambda left: let(part(i, i + 1, F.size(held)), lambda right: trimmed(left, right)))

            def told(i: Column) -> Column:
                def told_of(two: Column) -> Column:
                    left, right = F.element_at(two, 1), F.element_at(two, 2)
                    sound = (F.size(left) > 0) & (F.size(right) > 0) & ~contains_cjk(shown(left)) & contains_cjk(shown(right))
                    return F.struct(two.alias("two"), sound.alias("sound"), (F.size(at(i)["marks"]) == 0).alias("top"))

                return let(sides(i), told_of)

            chosen = F.get(F.filter(F.transform(open_, told), lambda t: t["sound"] | t["top"]), F.lit(0))
            return let(chosen, lambda t: F.when(F.coalesce(t["sound"], F.lit(False)), t["two"]).otherwise(F.array(held)))

        # most lines have no slash of their own; the rest is only worked out for those
        return F.when(F.exists(held, lambda r: r["text"] == "/"), let(slashes, first)).otherwise(F.array(held))

    return let(runs, cut)


def pieces(runs: Column) -> Column:
    """What a paragraph is cut into: its lines, cleaned, and bilingual ones by language."""
    return F.flatten(F.transform(lines(runs), lambda line: halves(without_stars(line))))
