"""Profiles as tables: roles, selectors, bounds and dispositions of one or many profiles, and their faults.

A profile is a JSON document. `tables_of` turns a column of them into five tables; `faults` checks the
tables by predicates, counts and anti-joins with the registries, so a thousand profiles are checked by
the same plan as one. What a run needs of a checked profile is a few dozen rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Style, family, whether it can hold a container, whether it takes one divider.
STYLES = [
    ("problem", "callout", True, True),
    ("example", "callout", True, True),
    ("tip", "callout", True, True),
    ("document-title", "title", False, False),
    ("author-affiliation", "byline", False, False),
    ("abstract", "callout", True, True),
    ("section-heading", "heading", False, False),
    ("body", "body", False, False),
    ("caption", "caption", False, False),
    ("footnote", "footnote", False, False),
    ("reference", "reference", False, False),
    ("equation", "equation", False, False),
    ("code", "code", False, False),
    ("visual", "visual", False, False),
    ("table", "table", False, False),
    ("definition", "callout", True, True),
    ("theorem", "callout", True, True),
    ("proof", "proof", True, True),
    ("note", "callout", True, True),
    ("warning", "callout", True, True),
    ("exercise", "callout", True, True),
]
#: Named constraints, grouping modes, outputs, auxiliary roles.
CONSTRAINTS = ["heading-hierarchy-v1", "visual-relations-v1", "academic-paper-order-v1", "lecture-proof-order-v1"]
GROUPINGS = ["none", "structural-container"]
OUTPUTS = ["bilingual", "source-only", "visual-once", "artifact-omitted"]
AUXILIARY_ROLES = ["page-header", "page-footer", "page-number", "marginalia"]
IDENTIFIER = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
TOKEN = r"^[a-z0-9]+(?:[-_][a-z0-9]+)*$"

_SELECTOR = "struct<adapter_role:string,node_types:array<string>,sub_types:array<string>,text_levels:array<int>,source_pattern:string,target_pattern:string>"
PROFILE = (
    "struct<schema_version:int,id:string,input:struct<adapter:string,source_language:string,minimum_native_text_page_ratio:double,minimum_text_characters_per_page:int>,"
    "translation:struct<target_language:string,reading_order:string,target_text_pattern:string,policy:string>,"
    f"semantics:struct<roles:array<struct<role:string,selectors:array<{_SELECTOR}>,style:string,grouping:string,output:string>>,auxiliary_dispositions:map<string,string>>,"
    "qa:struct<role_inventory:map<string,struct<minimum:int,maximum:int>>,constraints:array<string>>>"
)


def style_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, "style string, family string, is_container boolean, one_divider boolean")


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether a pattern is a valid regular expression; null for null."""
    import re

    def good(p: str | None) -> bool | None:
        if p is None:
            return None
        try:
            re.compile(p, re.IGNORECASE)
        except re.error:
            return False
        return bool(p)

    return patterns.map(good)


def tables_of(texts: DataFrame, id_col: str, json: str) -> dict[str, DataFrame]:
    """profiles, roles, selectors, inventory, auxiliary and constraints of profile documents."""
    p = texts.select(F.col(id_col).alias("profile"), F.from_json(F.col(json), PROFILE).alias("p"))
    roles = p.select("profile", F.posexplode("p.semantics.roles").alias("role_ord", "r"))
    return {
        "profiles": p.select("profile", "p.id", "p.schema_version", "p.input.*", "p.translation.*"),
        "roles": roles.select("profile", "role_ord", "r.role", "r.style", "r.grouping", "r.output"),
        "selectors": roles.select("profile", "r.role", F.posexplode("r.selectors").alias("selector_ord", "s")).select("profile", "role", "selector_ord", "s.*"),
        "inventory": p.select("profile", F.explode("p.qa.role_inventory").alias("role", "b")).select("profile", "role", "b.*"),
        "auxiliary": p.select("profile", F.explode("p.semantics.auxiliary_dispositions").alias("role", "disposition")),
        "constraints": p.select("profile", F.explode("p.qa.constraints").alias("constraint_id")),
    }


def fault_rows(rows: DataFrame, by: str, subject: str, tests: dict[str, Column]) -> DataFrame:
    """by, rule, subject: one row for each test that is true of a row."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    return rows.select(by, F.explode(found).alias("rule"), F.col(subject).cast("string").alias("subject"))


def profile_faults(profiles: DataFrame) -> DataFrame:
    """profile, rule, subject for the settings of the document as a whole."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return fault_rows(profiles, "profile", "id", {
        "profile_id": ~F.coalesce(F.col("id").rlike(IDENTIFIER), F.lit(False)),
        "adapter": blank("adapter"),
        "native_ratio": ~F.coalesce((F.col("minimum_native_text_page_ratio") > 0) & (F.col("minimum_native_text_page_ratio") <= 1), F.lit(False)),
        "native_characters": ~F.coalesce(F.col("minimum_text_characters_per_page") >= 1, F.lit(False)),
        "source_language": (F.col("schema_version") == 2) & blank("source_language"),
        "target_language": blank("target_language"),
        "reading_order": ~F.coalesce(F.col("reading_order") == "source-then-target", F.lit(False)),
        "target_pattern": ~F.coalesce(compiles("target_text_pattern"), F.lit(False)),
        "policy": (F.col("schema_version") == 2) & blank("policy"),
    })


def role_faults(roles: DataFrame, styles: DataFrame) -> DataFrame:
    """profile, rule, subject for roles: identifiers, repeats, unknown styles, groupings and outputs, and
    containers of a style or output that can't hold one."""
    named = roles.join(F.broadcast(styles.select("style", "is_container")), "style", "left")
    container = F.col("grouping") == "structural-container"
    single = fault_rows(named, "profile", "role", {
        "role_id": ~F.coalesce(F.col("role").rlike(IDENTIFIER), F.lit(False)),
        "style_known": F.col("is_container").isNull(),
        "grouping_known": ~F.coalesce(F.col("grouping").isin(GROUPINGS), F.lit(False)),
        "output_known": ~F.coalesce(F.col("output").isin(OUTPUTS), F.lit(False)),
        "container_style": container & ~F.col("is_container"),
        "container_output": container & (F.col("output") != "bilingual"),
    })
    twice = roles.groupBy("profile", "role").count().where("count > 1").select("profile", F.lit("role_repeated").alias("rule"), F.col("role").alias("subject"))
    return single.unionByName(twice)


def selector_faults(roles: DataFrame, selectors: DataFrame) -> DataFrame:
    """profile, rule, subject for selectors: missing or empty ones, bad tokens, levels and patterns, a target
    pattern alone, and one selector given twice in a profile."""
    bad_list = lambda c: F.col(c).isNotNull() & ((F.size(c) == 0) | (F.size(F.array_distinct(c)) < F.size(c)) | F.exists(c, lambda t: t.isNull() | ~t.rlike(TOKEN)))
    evidence = ["adapter_role", "node_types", "sub_types", "text_levels", "source_pattern"]
    levels = F.col("text_levels")
    keyed = selectors.withColumn("key", F.to_json(F.struct(*evidence, "target_pattern"))).withColumn("subject", F.concat_ws("#", "role", "selector_ord"))
    single = fault_rows(keyed, "profile", "subject", {
        "selector_empty": F.coalesce(*evidence[:1], *[F.col(c).cast("string") for c in evidence[1:]]).isNull(),
        "adapter_token": ~F.col("adapter_role").rlike(TOKEN),
        "node_types": bad_list("node_types"),
        "sub_types": bad_list("sub_types"),
        "text_levels": levels.isNotNull() & ((F.size(levels) == 0) | (F.size(F.array_distinct(levels)) < F.size(levels)) | F.exists(levels, lambda n: n.isNull() | (n < 0))),
        "source_pattern": ~compiles("source_pattern"),
        "target_pattern": ~compiles("target_pattern"),
        "target_alone": F.col("target_pattern").isNotNull() & F.col("source_pattern").isNull(),
    })
    twice = keyed.groupBy("profile", "key").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("subject")).where("n > 1").select("profile", F.lit("selector_repeated").alias("rule"), "subject")
    none = roles.join(selectors.select("profile", "role").distinct(), ["profile", "role"], "left_anti").select("profile", F.lit("selectors_missing").alias("rule"), F.col("role").alias("subject"))
    return single.unionByName(twice).unionByName(none)


def inventory_faults(roles: DataFrame, inventory: DataFrame, auxiliary: DataFrame, constraints: DataFrame) -> DataFrame:
    """profile, rule, subject: bounds that don't cover the roles exactly or make no sense, auxiliary roles not
    covered exactly, and constraints that are unknown or repeated."""
    spark = roles.sparkSession
    mine, bounds = roles.select("profile", "role").distinct(), inventory.select("profile", "role").distinct()
    tag = lambda df, rule, subject="role": df.select("profile", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    known = spark.createDataFrame([(r,) for r in AUXILIARY_ROLES], "role string")
    wanted = mine.select("profile").distinct().crossJoin(F.broadcast(known))  # four rows a profile
    rules = spark.createDataFrame([(c,) for c in CONSTRAINTS], "constraint_id string")
    parts = [
        tag(mine.join(bounds, ["profile", "role"], "left_anti"), "bounds_missing"),
        tag(bounds.join(mine, ["profile", "role"], "left_anti"), "bounds_extra"),
        fault_rows(inventory, "profile", "role", {"minimum": ~F.coalesce(F.col("minimum") >= 0, F.lit(False)), "maximum": F.col("maximum") < F.col("minimum")}),
        tag(wanted.join(auxiliary.select("profile", "role"), ["profile", "role"], "left_anti"), "auxiliary_missing"),
        tag(auxiliary.join(F.broadcast(known), "role", "left_anti"), "auxiliary_extra"),
        fault_rows(auxiliary, "profile", "role", {"auxiliary_output": ~F.coalesce(F.col("disposition").isin(OUTPUTS), F.lit(False))}),
        tag(constraints.join(F.broadcast(rules), "constraint_id", "left_anti"), "constraint_known", "constraint_id"),
        tag(constraints.groupBy("profile", "constraint_id").count().where("count > 1"), "constraint_repeated", "constraint_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def faults(tables: dict[str, DataFrame], styles: DataFrame) -> DataFrame:
    """profile, rule, subject: everything that is wrong with the profiles; none means they may be used."""
    t = tables
    parts = [profile_faults(t["profiles"]), role_faults(t["roles"], styles), selector_faults(t["roles"], t["selectors"]), inventory_faults(t["roles"], t["inventory"], t["auxiliary"], t["constraints"])]
    return reduce(DataFrame.unionByName, parts)


def glossary_faults(terms: DataFrame) -> DataFrame:
    """source, rule for terms (source, targets, case_sensitive): without source or targets, or given twice in
    one case mode."""
    no_target = F.coalesce(F.size("targets") <= 0, F.lit(True)) | F.exists("targets", lambda t: t.isNull() | (F.trim(t) == ""))
    single = fault_rows(terms.withColumn("_s", F.coalesce("source", F.lit(""))), "_s", "_s", {"no_source": F.trim("_s") == "", "no_target": no_target}).select(F.col("_s").alias("source"), "rule")
    mode = F.coalesce("case_sensitive", F.lit(False))
    keyed = terms.withColumn("_key", F.when(mode, F.col("source")).otherwise(F.lower("source"))).withColumn("_mode", mode)
    twice = keyed.groupBy("_key", "_mode").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).where("n > 1 and _key is not null")
    return single.unionByName(twice.select("source", F.lit("repeated").alias("rule")))


def semantic_match(rows: DataFrame, text: str, selectors: list[dict], include_target: bool = True) -> DataFrame:
    """rows with match: role, language and identifier of the first pattern that is found in the text.

    selectors: role, source_pattern, target_pattern in profile order; a source pattern comes before the
    target pattern of its selector. A group named `identifier` gives the identifier.
    """
    hits = []
    for s in selectors:
        for field in ("source_pattern", *(("target_pattern",) if include_target else ())):
            if not s.get(field):
                continue
            pattern = "(?iuU)" + s[field]
            named = s[field].find("(?<identifier>")
            group = 1 + sum(1 for i, c in enumerate(s[field][:named]) if c == "(" and s[field][i : i + 2] != "(?" and s[field][i - 1 : i] != "\\") if named >= 0 else 0
            found = F.trim(F.col(text)).rlike(pattern)
            identifier = F.nullif(F.regexp_extract(F.trim(F.col(text)), pattern, group), F.lit("")) if named >= 0 else F.lit(None).cast("string")
            hits.append(F.when(found, F.struct(F.lit(s["role"]).alias("role"), F.lit(field.split("_")[0]).alias("language"), identifier.alias("identifier"))))
    return rows.withColumn("match", F.coalesce(*hits) if hits else F.lit(None).cast("struct<role:string,language:string,identifier:string>"))
