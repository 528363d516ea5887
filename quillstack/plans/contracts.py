"""Queries of the profile, document model, evidence and review operators, each beside its DuckDB SQL.

Rows of the driver's tables stand for roles, blocks, items and files; remainders of their keys plant
the faults that the operators look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import document_ir as ir
from ..operators import evidence as ev
from ..operators import blocks as bl
from ..operators import headings, inventory, layout, profiles, protect, reading, rendering, review, sequences
from .oracles import VISIBLE, grams, tokens
from .queries import SELECTORS, lines, read, turns

ORACLES: dict[str, str] = {}
QUERIES: list[str] = []


def checked(sql: str):
    """Registers a query with the SQL that gives the same rows."""

    def add(f):
        ORACLES[f.__name__] = sql
        QUERIES.append(f.__name__)
        return f

    return add


def pick(column: Column, values: list[str]) -> Column:
    """values[column % len(values)]."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(column, F.lit(len(values))).cast("int"))


def sql_pick(column: str, values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][{column} % {len(values)} + 1]"


# -- profiles --------------------------------------------------------------------------------------

STYLE_NAMES = [s[0] for s in profiles.STYLES] + ["fancy", "wild"]
CONTAINERS = ",".join(f"'{s[0]}'" for s in profiles.STYLES if s[2])
KNOWN = ",".join(f"'{s[0]}'" for s in profiles.STYLES)
GROUP_NAMES = [*profiles.GROUPINGS, "odd"]
OUTPUT_NAMES = [*profiles.OUTPUTS, "nowhere"]
AUX_NAMES = [*profiles.AUXILIARY_ROLES, "sidebar"]
RULE_NAMES = [*profiles.CONSTRAINTS, "no-such-rule"]


def part_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    role = F.concat_ws("-", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), "p_size")
    role = F.when(F.col("p_partkey") % 50 == 7, F.upper(role)).otherwise(role)
    return p.select(F.col("p_brand").alias("profile"), role.alias("role"), pick(F.col("p_size"), STYLE_NAMES).alias("style"), pick(F.col("p_partkey"), GROUP_NAMES).alias("grouping"), pick(F.floor(F.col("p_partkey") / 3), OUTPUT_NAMES).alias("output"), "p_partkey", "p_size")


_ROLES = f"""r as (select p_brand as profile, case when p_partkey % 50 = 7 then upper(replace(lower(p_name), ' ', '-') || '-' || p_size) else replace(lower(p_name), ' ', '-') || '-' || p_size end as role,
    {sql_pick('p_size', STYLE_NAMES)} as style, {sql_pick('p_partkey', GROUP_NAMES)} as grouping, {sql_pick('(p_partkey // 3)', OUTPUT_NAMES)} as output, p_partkey, p_size from part)"""


@checked(f"""with {_ROLES}, f as (
    select 'role_id' as rule from r where not regexp_full_match(role, '[a-z0-9]+(?:-[a-z0-9]+)*')
    union all select 'style_known' from r where style not in ({KNOWN})
    union all select 'grouping_known' from r where grouping = 'odd'
    union all select 'output_known' from r where output = 'nowhere'
    union all select 'container_style' from r where grouping = 'structural-container' and style in ({KNOWN}) and style not in ({CONTAINERS})
    union all select 'container_output' from r where grouping = 'structural-container' and output <> 'bilingual'
    union all select 'role_repeated' from (select profile, role from r group by all having count(*) > 1))
    select rule, count(*) as n from f group by rule""")
def profile_role_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.counts(profiles.role_faults(part_roles(spark, sf_dir), profiles.style_table(spark)), "rule")


@checked(f"""with {_ROLES}, m as (select distinct profile, role from r),
    i as (select profile, role, p_size % 5 - 1 as lo, case when p_size % 7 <> 0 then p_size % 7 - 1 end as hi from r where p_partkey % 3 <> 0 union all select profile, 'spare', 0, null from r where p_partkey % 100 = 1),
    a as (select profile, {sql_pick('p_size', AUX_NAMES)} as role, {sql_pick('p_partkey', OUTPUT_NAMES)} as disposition from r where p_partkey % 40 = 3),
    c as (select profile, {sql_pick('p_partkey', RULE_NAMES)} as rule from r where p_partkey % 30 < 2),
    x as (select unnest(['page-header','page-footer','page-number','marginalia']) as role),
    f as (select 'bounds_missing' as rule from m where not exists (select 1 from i where i.profile = m.profile and i.role = m.role)
    union all select 'bounds_extra' from (select distinct profile, role from i) i where not exists (select 1 from m where i.profile = m.profile and i.role = m.role)
    union all select 'minimum' from i where lo < 0 union all select 'maximum' from i where hi < lo
    union all select 'auxiliary_missing' from (select distinct profile from m) m, x where not exists (select 1 from a where a.profile = m.profile and a.role = x.role)
    union all select 'auxiliary_extra' from a where role = 'sidebar' union all select 'auxiliary_output' from a where disposition = 'nowhere'
    union all select 'constraint_known' from c where rule = 'no-such-rule'
    union all select 'constraint_repeated' from (select 1 from c group by profile, rule having count(*) > 1))
    select rule, count(*) as n from f group by rule""")
def profile_bound_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = part_roles(spark, sf_dir)
    bounds = r.where("p_partkey % 3 <> 0").select("profile", "role", (F.col("p_size") % 5 - 1).alias("minimum"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 7 - 1).alias("maximum"))
    spare = r.where("p_partkey % 100 = 1").select("profile", F.lit("spare").alias("role"), F.lit(0).alias("minimum"), F.lit(None).cast("int").alias("maximum"))
    auxiliary = r.where("p_partkey % 40 = 3").select("profile", pick(F.col("p_size"), AUX_NAMES).alias("role"), pick(F.col("p_partkey"), OUTPUT_NAMES).alias("disposition"))
    rules = r.where("p_partkey % 30 < 2").select("profile", pick(F.col("p_partkey"), RULE_NAMES).alias("constraint_id"))
    return inventory.counts(profiles.inventory_faults(r, bounds.unionByName(spare), auxiliary, rules), "rule")


@checked(f"""with {_ROLES}, s as (select profile, role, p_partkey as k, p_partkey % 11 as m, p_partkey % 13 as t from r where p_partkey % 9 <> 4),
    f as (select 'selector_empty' as rule from s where m = 0
    union all select 'adapter_token' from s where m in (2, 3) union all select 'node_types' from s where m in (4, 5)
    union all select 'text_levels' from s where m in (6, 7) union all select 'source_pattern' from s where m = 8
    union all select 'target_pattern' from s where t = 1 union all select 'target_alone' from s where t in (0, 1) and m not in (8, 9)
    union all select 'selectors_missing' from r where not exists (select 1 from s where s.profile = r.profile and s.role = r.role)
    union all select 'selector_repeated' from (select 1 from s group by profile, case m when 1 then 'a' || (k % 400) when 10 then 'b' || (k % 300) else 'm' || m || case when m in (2, 3, 8) then k::varchar else '' end end, case when t in (0, 1) then t else 9 end having count(*) > 1))
    select rule, count(*) as n from f group by rule""")
def profile_selector_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = part_roles(spark, sf_dir)
    k, m, t = F.col("p_partkey").cast("string"), F.col("p_partkey") % 11, F.col("p_partkey") % 13
    when = lambda *pairs: F.coalesce(*[F.when(m == i, v) for i, v in pairs])
    level = lambda *n: F.array(*map(F.lit, n))
    selectors = r.where("p_partkey % 9 <> 4").select(
        "profile",
        "role",
        F.col("p_partkey").alias("selector_ord"),
        when((1, F.concat(F.lit("token-"), (F.col("p_partkey") % 400).cast("string"))), (2, F.concat(F.lit("Bad "), k)), (3, F.concat(F.lit("bad token "), k))).alias("adapter_role"),
        when((4, F.array(F.lit("x"), F.lit("x"))), (5, F.array().cast("array<string>"))).alias("node_types"),
        F.lit(None).cast("array<string>").alias("sub_types"),
        when((6, level(-1)), (7, level(1, 1)), (10, F.array((F.col("p_partkey") % 300).cast("int")))).cast("array<int>").alias("text_levels"),
        when((8, F.concat(F.lit("("), k)), (9, F.lit("^a"))).alias("source_pattern"),
        F.when(t == 0, "b$").when(t == 1, "[").alias("target_pattern"),
    )
    return inventory.counts(profiles.selector_faults(r, selectors), "rule")


@checked("""with n as (select n_nationkey as k from nation), f as (
    select k, 'profile_id' as rule from n where k % 5 = 0 union all select k, 'source_language' from n where k % 6 = 0
    union all select k, 'native_ratio' from n where k % 7 = 0 union all select k, 'native_characters' from n where k % 8 = 0
    union all select k, 'reading_order' from n where k % 9 = 0 union all select k, 'target_pattern' from n where k % 10 = 0
    union all select k, 'style_known' from n where k % 4 = 1 union all select k, 'auxiliary_missing' from n where k % 3 = 2
    union all select k, 'maximum' from n where k % 6 = 5 union all select k, 'constraint_known' from n where k % 11 = 4)
    select k::int as profile, rule, count(*) as n from f group by all""")
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile documents as JSON texts, one for each nation: parsed into tables and checked as a whole."""
    k = F.col("n_nationkey")
    text = lambda s: F.lit(s)
    aux = F.map_from_arrays(F.when(k % 3 == 2, F.array(*map(text, profiles.AUXILIARY_ROLES[:3]))).otherwise(F.array(*map(text, profiles.AUXILIARY_ROLES))), F.when(k % 3 == 2, F.array_repeat(text("bilingual"), 3)).otherwise(F.array_repeat(text("artifact-omitted"), 4)))
    bounds = F.struct(F.lit(2).alias("minimum"), F.when(k % 6 == 5, 1).alias("maximum"))
    selector = F.struct(text("paragraph").alias("adapter_role"), F.array(text("prose")).alias("node_types"))
    role = F.struct(text("body-text").alias("role"), F.array(selector).alias("selectors"), F.when(k % 4 == 1, "odd").otherwise("body").alias("style"), text("none").alias("grouping"), text("bilingual").alias("output"))
    profile = F.struct(
        F.lit(2).alias("schema_version"),
        F.when(k % 5 == 0, "Bad Id").otherwise(F.concat(text("p-"), k.cast("string"))).alias("id"),
        F.struct(text("native-text-pdf").alias("adapter"), F.when(k % 6 == 0, " ").otherwise("en").alias("source_language"), F.when(k % 7 == 0, 1.5).otherwise(0.7).alias("minimum_native_text_page_ratio"), F.when(k % 8 == 0, 0).otherwise(100).alias("minimum_text_characters_per_page")).alias("input"),
        F.struct(text("zh").alias("target_language"), F.when(k % 9 == 0, "target-first").otherwise("source-then-target").alias("reading_order"), F.when(k % 10 == 0, "(").otherwise("[a-z]").alias("target_text_pattern"), text("all").alias("policy")).alias("translation"),
        F.struct(F.array(role).alias("roles"), aux.alias("auxiliary_dispositions")).alias("semantics"),
        F.struct(F.create_map(text("body-text"), bounds).alias("role_inventory"), F.array(F.when(k % 11 == 4, "none-such").otherwise("heading-hierarchy-v1")).alias("constraints")).alias("qa"),
    )
    texts = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("profile"), F.to_json(profile).alias("json"))
    return inventory.counts(profiles.faults(profiles.tables_of(texts, "profile", "json"), profiles.style_table(spark)), "profile", "rule")


@checked("""with t as (select case when p_partkey % 40 = 1 then ' ' when p_partkey % 3 = 0 then upper(p_name) else p_name end as s, p_partkey % 25 = 2 as bad, p_partkey % 2 = 0 as mode, p_size from part where p_partkey % 10 < 3),
    u as (select s || case when s = ' ' then '' else p_size::varchar end as source, bad, mode from t),
    g as (select min(source) as source from u group by case when mode then source else lower(source) end, mode having count(*) > 1),
    f as (select source, 'no_source' as rule from u where trim(source) = '' union all select source, 'no_target' from u where bad union all select source, 'repeated' from g)
    select source, rule, count(*) as n from f group by all""")
def glossary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 40 == 1, " ").when(k % 3 == 0, F.concat(F.upper("p_name"), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_name"), F.col("p_size").cast("string")))
    terms = read(spark, sf_dir, "part").where("p_partkey % 10 < 3").select(name.alias("source"), F.when(k % 25 == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("x"))).alias("targets"), (k % 2 == 0).alias("case_sensitive"))
    return inventory.counts(profiles.glossary_faults(terms), "source", "rule")


MATCHES = [
    {"role": "numbered", "source_pattern": r"^(?:of|to) (?<identifier>[a-z]+)"},
    {"role": "and-start", "source_pattern": r"^and\b", "target_pattern": r"\bis\.$"},
    {"role": "thing", "source_pattern": r"\b(?<identifier>th[a-z]*ing)\b"},
]


@checked(r"""with t as (select conv_id, turn, trim(text) as t from conversations),
    m as (select conv_id, turn, case when regexp_matches(t, '(?i)^(?:of|to) ([a-z]+)') then {'role': 'numbered', 'language': 'source', 'identifier': regexp_extract(t, '(?i)^(?:of|to) ([a-z]+)', 1)}
        when regexp_matches(t, '(?i)^and\b') then {'role': 'and-start', 'language': 'source', 'identifier': null} when regexp_matches(t, '(?i)\bis\.$') then {'role': 'and-start', 'language': 'target', 'identifier': null}
        when regexp_matches(t, '(?i)\b(th[a-z]*ing)\b') then {'role': 'thing', 'language': 'source', 'identifier': regexp_extract(t, '(?i)\b(th[a-z]*ing)\b', 1)} end as m from t)
    select conv_id, turn, m.role as role, m.language as language, m.identifier as identifier from m""")
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return profiles.semantic_match(rows, "text", MATCHES).select("conv_id", "turn", "match.role", "match.language", "match.identifier")


# -- the document model ----------------------------------------------------------------------------

#: The roles of queries.SELECTORS with a policy; documents are blocks, ten to a document of the model.
ROLES = [{**SELECTORS[0], "style": "note", "output": "bilingual", "grouping": "structural-container"}, {**SELECTORS[1], "style": "body", "output": "source-only", "grouping": "none"}, {**SELECTORS[2], "style": "reference", "output": "visual-once", "grouping": "none"}, {**SELECTORS[3], "style": "body", "output": "bilingual", "grouping": "structural-container"}]
AUXILIARY = {"page-footer": "artifact-omitted", "marginalia": "bilingual"}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    adapter_role = F.when(F.col("lang") == "de", "de").when(F.col("lang") == "fr", pick(k, ["footer", "aside_text", "page_number"]))
    return d.select(
        F.floor(k / 10).alias("document"), k.alias("id"), (F.floor(k / 3)).alias("page"), adapter_role.alias("adapter_role"), F.col("source").alias("node_type"), F.col("lang").alias("sub_type"), F.lit(None).cast("int").alias("text_level"),
        F.col("text").alias("source"), F.when(k % 6 == 5, "artifact").otherwise("prose").alias("kind"), (k % 4 != 0).alias("translatable"), F.when(k % 7 == 3, "other").otherwise("own").alias("adapter"),
        F.when(k % 3 == 0, F.array(k, k + 1)).when(k % 3 == 1, F.array(k, k)).alias("members"),
    )


_WON = """w as (select doc_id, (select m.role from (select unnest([
        case when lang = 'de' and regexp_matches(trim(text), '(?i)\\bdie\\b') then {'tier': 4, 'n': 2, 'r': 0, 's': 0, 'role': 'german-note'} end,
        case when lang = 'de' then {'tier': 4, 'n': 1, 'r': 0, 's': -1, 'role': 'german-note'} end,
        case when source in ('src0', 'src1') then {'tier': 1, 'n': 1, 'r': -1, 's': 0, 'role': 'main-source'} end,
        case when regexp_matches(trim(text), '\\d+') then {'tier': 2, 'n': 1, 'r': -2, 's': 0, 'role': 'numbered'} end,
        case when lang = 'en' then {'tier': 3, 'n': 1, 'r': -3, 's': 0, 'role': 'english'} end,
        case when source = 'src2' and regexp_matches(trim(text), '(?i)^the\\b') then {'tier': 2, 'n': 2, 'r': -3, 's': -1, 'role': 'english'} end]) as m) where m is not null order by m.tier desc, m.n desc, m.r desc, m.s desc limit 1) as won, lang from documents)"""
_NODES = _WON + """, z as (select *, case when won is null and lang = 'fr' then ['page-footer', 'marginalia', null][doc_id % 3 + 1] end as aux from w),
    n as (select doc_id // 10 as document, doc_id as id, doc_id // 3 as page, coalesce(won, aux) as role, won,
        case won when 'german-note' then 'note' when 'numbered' then 'reference' when 'main-source' then 'body' when 'english' then 'body' end as style,
        case when won in ('german-note', 'english') then 'bilingual' when won = 'main-source' then 'source-only' when won = 'numbered' then 'visual-once' when aux = 'page-footer' then 'artifact-omitted' when aux = 'marginalia' then 'bilingual'
             when doc_id % 6 = 5 then 'artifact-omitted' when doc_id % 4 <> 0 then 'bilingual' else 'source-only' end as output,
        case when won is not null then 'profile-selector' when aux is not null then 'profile-auxiliary-disposition' else 'unclassified' end as method,
        doc_id % 4 <> 0 as translatable, case when doc_id % 7 = 3 then 'other' else 'own' end as adapter from z)"""
_GROUPS = _NODES + """, g as (select a.document, a.role || ':' || a.id as group_id, a.role, a.id as anchor, a.page,
        a.won in ('german-note', 'english') and a.id % 3 = 0 and b.id is not null and b.adapter = a.adapter as whole, b.page as next_page from n a left join n b on b.document = a.document and b.id = a.id + 1 where a.won is not null),
    e as (select document, group_id, role, anchor as id from g union all select document, group_id, role, anchor + 1 from g where whole)"""


@checked(f"with {_NODES} select document, id, role, style, output, method from n")
def ir_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.nodes_of(blocks(spark, sf_dir), ROLES, AUXILIARY).select("document", "id", "role", "style", "output", "method")


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ir.model_of(blocks(spark, sf_dir), ROLES, AUXILIARY)


@checked(f"""with {_GROUPS} select document, group_id, role, anchor, case when whole then 'complete' else 'anchor-only' end as membership, case when whole then anchor || ',' || (anchor + 1) else anchor::varchar end as members,
    case when whole and next_page <> page then page || ',' || next_page else page::varchar end as pages from g""")
def ir_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return model(spark, sf_dir)[1].select("document", "group_id", "role", "anchor", "membership", listed("members"), listed("pages"))


@checked(f"""with {_GROUPS}, x(role, minimum, maximum) as (values ('german-note', 1, null::int), ('main-source', 0, 3), ('numbered', 0, null), ('english', 2, 8), ('nobody', 1, null)),
    c as (select document, role, count(*) as oc, count(*) filter (whole) as complete, string_agg(group_id, ' ' order by group_id) as ids from g group by all),
    m as (select document, role, count(distinct id) as nc from e group by all), d as (select distinct document from g)
    select d.document, x.role, coalesce(oc, 0) as occurrence_count, coalesce(nc, 0) as node_count, 0::bigint as none, coalesce(oc - complete, 0) as anchor_only, coalesce(complete, 0) as complete, coalesce(ids, '') as occurrences,
        coalesce(oc, 0) >= minimum and (maximum is null or coalesce(oc, 0) <= maximum) as within_bounds
    from d cross join x left join c on c.document = d.document and c.role = x.role left join m on m.document = d.document and m.role = x.role""")
def ir_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([("german-note", 1, None), ("main-source", 0, 3), ("numbered", 0, None), ("english", 2, 8), ("nobody", 1, None)], "role string, minimum int, maximum int")
    return ir.inventory_of(model(spark, sf_dir)[1], bounds).select("document", "role", "occurrence_count", "node_count", "none", "anchor_only", "complete", F.array_join("occurrence_ids", " ").alias("occurrences"), "within_bounds")


@checked(f"with {_GROUPS} select n.document, n.id, coalesce(string_agg(distinct e.group_id, ' ' order by e.group_id), '') as groups from n left join e on e.document = n.document and e.id = n.id group by all")
def node_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, groups = model(spark, sf_dir)
    return ir.groups_of_nodes(nodes.select("document", "id"), groups).select("document", "id", F.array_join("groups", " ").alias("groups"))


@checked(f"""with {_GROUPS}, f as (select 'unknown member' as fault from g where anchor % 20 = 1 union all select 'repeated member' from g where anchor % 20 = 2 union all select 'repeated group' from g where anchor % 20 = 3
    union all select 'anchor outside' from g where anchor % 20 = 4 union all select 'anchor of another role' from g where anchor % 20 = 5) select fault, count(*) as n from f group by fault""")
def group_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with one fault planted by the remainder of the anchor."""
    nodes, found = model(spark, sf_dir)
    a = F.col("anchor") % 20
    broken = found.withColumn("members", F.when(a == 1, F.array("anchor", -F.col("anchor"))).when(a == 2, F.array("anchor", "anchor")).when(a == 4, F.array(F.floor(F.col("anchor") / 10) * 10)).otherwise(F.col("members")))
    broken = broken.withColumn("role", F.when(a == 5, "someone").otherwise(F.col("role"))).unionByName(found.where(F.col("anchor") % 20 == 3))
    return inventory.counts(ir.group_faults(nodes, broken), "fault")


@checked(f"""with {_NODES}, s as (select id, role, output from n where id % 30 <> 4 union all select id, role, case when id % 30 = 4 then 'old' else output end from n where id % 30 = 4 union all select -1, null, 'bilingual'),
    d as (select 'gone' as side, * from (select * from s except all select id, role, output from n) union all select 'new', * from (select id, role, output from n except all select * from s)) select side, id, role, output from d""")
def ir_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = model(spark, sf_dir)[0].select("id", "role", "output")
    stored = now.withColumn("output", F.when(F.col("id") % 30 == 4, "old").otherwise(F.col("output"))).unionByName(spark.createDataFrame([(-1, None, "bilingual")], "id bigint, role string, output string"))
    return ir.changed(stored, now)


@checked(f"""with recursive {_NODES}, q as (select n.document, n.id, coalesce(n.role, 'unclassified') as role, length(d.text) as chars, row_number() over (partition by n.document order by n.id) as k from n join documents d on d.doc_id = n.id where n.translatable and n.output = 'bilingual'),
    f(document, k, role, chars, chunk, held) as (select document, k, role, chars, 1, chars from q where k = 1
        union all select q.document, q.k, q.role, q.chars, case when f.held > 0 and f.held + q.chars > 4000 then f.chunk + 1 else f.chunk end, case when f.held > 0 and f.held + q.chars > 4000 then q.chars else f.held + q.chars end from f join q on q.document = f.document and q.k = f.k + 1)
    select document, chunk::bigint as chunk, role, count(*) as segments, sum(chars)::bigint as chars from f group by all""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each document in parts of at most 4,000 letters, and how many of each role a part holds."""
    nodes = ir.requests_of(ir.nodes_of(blocks(spark, sf_dir), ROLES, AUXILIARY))
    rows = nodes.select("document", "id", F.coalesce("role", F.lit("unclassified")).alias("role"), F.length("source").cast("long").alias("chars"))
    parts = sequences.greedy_chunks(rows, ["document"], "id", "chars", 4000)
    return parts.groupBy("document", "chunk", "role").agg(F.count(F.lit(1)).alias("segments"), F.sum("chars").alias("chars"))


@checked("""with p as (select lang, count(*) as pages, count(*) filter (length(trim(text)) >= 400) as native from documents group by lang) select lang, pages, native, native / pages as ratio, native / pages >= 0.7 as passed from p""")
def native_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.native_pages(read(spark, sf_dir, "documents"), "lang", "text", 400, 0.7)


@checked("""with f as (select 'repeated id' as fault from documents where doc_id % 90 = 1 union all select 'hash differs' from documents where doc_id % 70 = 2 union all select 'no id' from documents where doc_id % 80 = 3)
    select fault, count(*) as n from f group by fault""")
def block_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.floor(k / 10).alias("document"), F.when(k % 80 == 3, "").otherwise(k.cast("string")).alias("id"), F.col("text").alias("source"), F.when(k % 70 == 2, "stale").otherwise(tx.sha256_text(F.col("text"))).alias("source_sha256"), k)
    again = rows.where(k % 90 == 1)
    return inventory.counts(ir.block_faults(rows.unionByName(again)), "fault")


@checked("""with s as (select doc_id % 5 as k, length(text) as n, text from documents), f as (
    select 'bounds' as fault from s where n < 4 or (k = 1) or (k <> 1 and n < 9) union all select 'order' from s where k = 2
    union all select 'text' from s where k in (1, 3) union all select 'role' from s where k = 4) select fault, count(*) as n from f group by fault""")
def span_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans for each text: sound, past the end, in the wrong order, with other letters, of another role."""
    t, k = F.col("text"), F.col("doc_id") % 5
    span = lambda a, b, role, s: F.struct(F.lit(a).alias("start"), b.alias("end"), role.alias("role"), s.alias("text"))
    code = F.when(k == 4, "bold").otherwise("code")
    first = span(0, F.lit(4), code, F.when(k == 3, "????").otherwise(F.substring(t, 1, 4)))
    second = span(5, F.when(k == 1, F.length(t) + 9).otherwise(F.lit(9)).cast("int"), code, F.when(k == 1, "????").otherwise(F.substring(t, 6, 4)))
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(k == 2, F.array(second, first)).otherwise(F.array(first, second)).alias("spans"))
    return inventory.counts(protect.span_faults(rows, "doc_id", "text", "spans"), "fault")


# -- adapter evidence ------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as items of a conversation and as its content, with faults planted by the remainder of a hash."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("position"), "role", tx.sha256_text(F.col("text")).alias("sha256"), (F.col("conv_id") * 37 + F.col("turn")).alias("k"))
    content = t.select("document", "position", "sha256", F.col("role").alias("type"), F.col("position").alias("page_idx"))
    k, me = F.col("k"), F.concat_ws("-", "document", "position")
    node = F.when(k % 11 == 1, F.array(me, me)).when(k % 11 == 2, F.array().cast("array<string>")).when(k % 11 == 3, F.array(F.lit("nobody"))).otherwise(F.array(me))
    rows = t.select(
        "document", "position", F.when(k % 13 == 1, "/x").otherwise(F.concat(F.lit("/"), F.col("position").cast("string"))).alias("pointer"), F.when(k % 17 == 2, "old").otherwise(F.col("sha256")).alias("item_sha256"), F.when(k % 19 == 3, "odd").otherwise(F.col("role")).alias("raw_type"),
        F.when(k % 23 == 4, -1).otherwise(F.col("position")).alias("page_idx"), F.when(k % 5 == 0, "artifact_omitted").when(k % 29 == 1, "lost").otherwise("emitted").alias("disposition"), F.when(k % 10 == 0, "furniture").alias("reason"), node.alias("node_ids"), F.array().cast("array<string>").alias("visual_ids"),
    )
    return rows, content


_ITEMS = "i as (select conv_id as document, turn as position, conv_id * 37 + turn as k, conv_id || '-' || turn as me, sha256(text) as sha from conversations)"


@checked(f"""with {_ITEMS}, f as (select 'pointer_position' as c from i where k % 13 = 1 union all select 'item_hash' from i where k % 17 = 2 union all select 'item_type' from i where k % 19 = 3 union all select 'item_page' from i where k % 23 = 4
    union all select 'disposition' from i where k % 5 <> 0 and k % 29 = 1 union all select 'no_target' from i where k % 11 = 2 union all select 'repeated_target' from i where k % 11 = 1 union all select 'no_reason' from i where k % 5 = 0 and k % 10 <> 0
    union all select 'pointer_repeated' from (select 1 from i where k % 13 = 1 group by document having count(*) > 1)) select c as "check", count(*) as n from f group by c""")
def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, content = items(spark, sf_dir)
    return inventory.counts(ev.item_faults(rows, content), "check")


@checked(f"""with {_ITEMS}, f as (select 'node_named_twice' as c from i where k % 11 = 1 union all select 'node_named_twice' from (select 1 from i where k % 11 = 3 group by document having count(*) > 1)
    union all select 'node_unknown' from (select distinct document from i where k % 11 = 3) union all select 'node_unnamed' from i where k % 11 in (2, 3)
    union all select 'reverse_pointer' from i where k % 13 = 1 and k % 11 not in (1, 2, 3) union all select 'reverse_pointer' from i, (values (1), (2)) where k % 13 = 1 and k % 11 = 1
    union all select 'reverse_hash' from i where k % 17 = 2 and k % 11 not in (1, 2, 3) union all select 'reverse_hash' from i, (values (1), (2)) where k % 17 = 2 and k % 11 = 1
    union all select 'visual_unnamed' from labels) select c as "check", count(*) as n from f group by c""")
def evidence_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = items(spark, sf_dir)
    nodes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("/"), F.col("turn").cast("string")).alias("pointer"), tx.sha256_text(F.col("text")).alias("item_sha256"))
    visuals = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document"), F.col("doc_id").cast("string").alias("id"))
    return inventory.counts(ev.pointer_faults(rows, nodes, visuals), "check")


@checked("""with v as (select doc_id as id, doc_id % 10 = 1 as gone, doc_id % 10 = 2 as other from labels join documents using (doc_id)) select case when gone then 'asset_unknown' else 'asset_hash' end as "check", id::varchar as subject from v where gone or other""")
def visual_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    assets = d.select(F.lit(1).alias("document"), k.alias("id"), tx.sha256_text(F.col("text")).alias("sha256"))
    visuals = read(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id").select(F.lit(1).alias("document"), k.alias("id"), F.when(k % 10 == 1, -k).otherwise(k).alias("asset_id"), F.when(k % 10 == 2, "x").otherwise(tx.sha256_text(F.col("text"))).alias("sha256"))
    return ev.asset_faults(visuals, assets).select("check", "subject")


_PAGES = """p as (select page_id // 20 as document, page_id % 20 as idx, page_id, length(html) as adapter, case when page_id % 9 = 0 then 0 else length(html) // (page_id % 5 + 1) end as native, page_id % 4 <> 1 as english, (page_id % 10) / 10.0 as raster, page_id % 3 = 0 as low from pages),
    r as (select *, list_filter([case when adapter >= 2 * greatest(native, 1) and native < 1500 then 'adapter_text_without_native_oracle' end, case when low and native < 1500 then 'document_native_ratio_below_threshold' end, case when raster >= 0.5 and native < 1500 then 'large_raster_without_native_oracle' end,
        case when native = 0 then 'native_oracle_empty' end, case when native >= 1500 and not english then 'native_oracle_not_substantive_english' end], lambda x: x is not null) as reasons from p)"""


def derived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id"), F.length("html")
    native = F.when(k % 9 == 0, 0).otherwise(F.floor(n / (k % 5 + 1)))
    reasons = ev.page_reasons(native, k % 4 != 1, n, (k % 10) / 10.0, F.lit(1500), k % 3 == 0)
    return read(spark, sf_dir, "pages").select(F.floor(k / 20).alias("document"), (k % 20).alias("page_idx"), "page_id", reasons.alias("reasons"))


@checked(f"with {_PAGES} select document, idx as page_idx, array_to_string(reasons, ' ') as reasons from r")
def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_pages(spark, sf_dir).select("document", "page_idx", F.array_join(F.array_sort("reasons"), " ").alias("reasons"))


@checked(f"""with {_PAGES}, f as (select 'page_extra' as c from r where page_id % 50 = 7 union all select 'page_missing' from r where page_id % 50 = 8
    union all select 'page_reasons' from r where page_id % 50 = 9 and not (len(reasons) = 1 and reasons[1] = 'native_oracle_empty')
    union all select 'page_status' from r where page_id % 50 = 10
    union all select 'page_gaps' from (select document, count(*) filter (page_id % 50 <> 8) as n, min(idx) filter (page_id % 50 <> 8) as lo, max(idx) filter (page_id % 50 <> 8) as hi from r group by document) where lo <> 0 or hi <> n - 1)
    select c as "check", count(*) as n from f group by c""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, again = F.col("page_id") % 50, derived_pages(spark, sf_dir)
    needs = (F.size("reasons") > 0) != (k == 10)
    stored = again.where(k != 8).withColumn("status", F.when(needs, "manual_source_review_required").otherwise("native_oracle_available"))
    stored = stored.withColumn("reasons", F.when(k == 9, F.array(F.lit("native_oracle_empty"))).otherwise(F.col("reasons")))
    return inventory.counts(ev.page_faults(stored, again.where(k != 7)), "check")


@checked(f"""with w as (select doc_id, unnest(string_split(text, chr(10))) as l from documents), h as (select page_id, {VISIBLE} as t from pages),
    t as (select doc_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) as t from w where regexp_matches(l, '\\pL') union all select page_id, t from h join documents on doc_id = page_id), s as (select doc_id, sum(length(t))::bigint + count(*) - 1 as chars from t where t <> '' group by doc_id)
    select doc_id // 10 as document, d.doc_id as page, coalesce(chars, 0)::bigint as chars from documents d left join s using (doc_id)""")
def substantive_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as prose, or as artifacts if they hold no letter, and the web page of the same number as a table."""
    kind = F.when(F.col("line").rlike(r"\p{L}"), "prose").otherwise("artifact")
    prose = lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("line").alias("t"), kind.alias("kind"))
    tables = read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("t"), F.lit("table").alias("kind"))
    pieces = prose.unionByName(tables).withColumn("document", F.floor(F.col("page") / 10))
    pages = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("document"), F.col("doc_id").alias("page"))
    return ev.text_lengths(pieces, pages, "t", "kind", compatible=True)


@checked("""with f as (select s_suppkey as k, 'file_missing' as c, 'middle' as s from supplier where s_suppkey % 6 = 1 union all select s_suppkey, 'file_ambiguous', 'content' from supplier where s_suppkey % 6 = 2
    union all select s_suppkey, 'origin_hash', s_suppkey || '/a_origin.pdf' from supplier where s_suppkey % 6 = 3) select k as document, c as "check", s as subject from f""")
def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as import folders: one file of each kind, but for a missing, a doubled and a foreign one."""
    k = F.col("s_suppkey")
    name = lambda s: F.concat(k.cast("string"), F.lit(f"/{s}"))
    files = F.array(name("a_content_list.json"), F.when(k % 6 != 1, name("a_middle.json")), name("a_origin.pdf"), F.when(k % 6 == 2, name("b_content_list.json")), name("notes.txt"))
    s = read(spark, sf_dir, "supplier")
    rows = s.select(k.alias("document"), F.explode(F.filter(files, lambda f: f.isNotNull())).alias("path"), F.when(k % 6 == 3, "other").otherwise(F.col("s_name")).alias("sha256"))
    return ev.input_faults(rows, s.select(k.alias("document"), F.col("s_name").alias("sha256")))


@checked("""with o as (select o_orderkey as k, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1), f as (select 'backend' as c from o where k % 9 = 1 union all select 'version' from o where k % 9 = 2 union all select 'page_count' from o where k % 9 = 3
    union all select 'page_order' from o where k % 9 in (3, 4) union all select 'page_size' from o where k % 9 = 5) select c as "check", count(*) as n from f group by c""")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tree files of three pages."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        k.alias("document"), F.when(k % 9 == 1, "vlm").otherwise("pipeline").alias("backend"), F.when(k % 9 == 2, F.lit(None)).otherwise("3.4.4").alias("version"), F.lit("3.4.4").alias("expected_version"), F.lit(3).alias("pages"),
        F.when(k % 9 == 3, F.array(F.lit(0), F.lit(1))).when(k % 9 == 4, F.array(F.lit(0), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page_idx"),
        F.array(F.array(F.lit(595.0), F.when(k % 9 == 5, 0.0).otherwise(842.0))).alias("sizes"),
    )
    return inventory.counts(ev.tree_faults(rows), "check")


@checked("""with d as (select doc_id, sha256(text) as sha from documents), f as (select 'file_gone' as c from d where doc_id % 20 = 1 union all select 'file_size' from d where doc_id % 20 = 2 union all select 'file_hash' from d where doc_id % 20 = 3 union all select 'file_twice' from d where doc_id % 20 = 4) select c as "check", count(*) as n from f group by c""")
def frozen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    files = read(spark, sf_dir, "documents").select(F.lit(1).alias("document"), k.cast("string").alias("path"), F.octet_length("text").alias("size"), tx.sha256_text(F.col("text")).alias("sha256"), k)
    kept = files.withColumn("size", F.when(k % 20 == 2, -1).otherwise(F.col("size"))).withColumn("sha256", F.when(k % 20 == 3, "old").otherwise(F.col("sha256")))
    return inventory.counts(ev.frozen_faults(kept.unionByName(kept.where(k % 20 == 4)), files.where(k % 20 != 1)), "check")


@checked("""with c as (select conv_id as document, case when turn % 3 <> 0 then role end as path from conversations), t as (select conv_id as document, 'img' || (turn % 4) as path from conversations) select * from (select * from c union select * from t) where path is not null""")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "document")
    return ev.asset_paths(t.select("document", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("path")), t.select("document", F.concat(F.lit("img"), (F.col("turn") % 4).cast("string")).alias("path")))


# -- review, plan, final gates -----------------------------------------------------------------------


@checked("""with p as (select page_id // 40 as work, page_id % 40 as page, page_id from pages), s as (select work, page // 8 as sheet, min(page) as lo, max(page) + case when (any_value(work) + min(page) // 8) % 4 = 3 then 1 else 0 end as hi from p group by all),
    c as (select work, page, count(*) as n from (select work, unnest(generate_series(lo, hi)) as page from s) group by all),
    f as (select work, 'review_missing' as c, work::varchar as s from (select distinct work from p) where work % 5 = 1 union all select work, 'reviewer', work::varchar from (select distinct work from p) where work % 5 = 2 and work % 5 <> 1
    union all select work, 'verdict', 'maybe' from (select distinct work from p) where work % 5 = 3 union all select work, 'sheet_stale', 'sheet-' || sheet || ' changed' from s where (work + sheet) % 6 = 0 union all select work, 'sheet_stale', 'sheet-' || sheet || ' gone' from s where (work + sheet) % 6 = 1
    union all select c.work, 'page_shown_twice', c.page::varchar from c join p using (work, page) where n > 1 union all select c.work, 'page_unknown', c.page::varchar from c left join p using (work, page) where p.page is null) select work, c as "check", s as subject from f""")
def visual_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 40).alias("work"), (F.col("page_id") % 40).alias("page"))
    works, w = pages.select("work").distinct(), F.col("work")
    reviews = works.where(w % 5 != 1).select("work", F.when(w % 5 == 2, " ").otherwise("someone").alias("reviewer"), F.when(w % 5 == 3, "maybe").otherwise("passed").alias("status"))
    sheet = F.floor(F.col("page") / 8)
    late = F.when((w + F.min(sheet)) % 4 == 3, 1).otherwise(0)
    sheets = pages.groupBy("work", sheet.alias("sheet")).agg(F.min("page").alias("first_page"), (F.max("page") + late).alias("last_page")).withColumn("artifact", F.concat(F.lit("sheet-"), F.col("sheet").cast("string"))).withColumn("sha256", F.lit("a"))
    artifacts = sheets.where((w + F.col("sheet")) % 6 != 1).select("work", "artifact", F.when((w + F.col("sheet")) % 6 == 0, "b").otherwise("a").alias("sha256"))
    return review.visual_review_faults(reviews, sheets.drop("sheet"), artifacts, pages).withColumn("subject", F.when(F.col("check") == "reviewer", w.cast("string")).otherwise(F.col("subject")))


@checked("""with c as (select c_custkey as work, count(*) filter (o_orderkey % 4 <> 3) as p from customer left join orders on o_custkey = c_custkey group by 1),
    g as (select distinct o_custkey as work, ['g0','g1','g2'][o_orderkey % 3 + 1] as gate, case when o_orderkey % 41 = 0 then 'failed' when o_orderkey % 37 = 0 then 'manual_review_required' else 'passed' end as status from orders),
    a as (select work, count(distinct gate) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'manual_review_required') as manual from g group by work),
    s as (select c_custkey as work, count(*) as stale from customer, (values (0), (1)) v(x) where (c_custkey % 9 = 0 and x = 0) or (c_custkey % 7 = 0 and x = 1) group by 1)
    select work, passed, 3 - passed as open, coalesce(stale, 0) as stale, case when failed > 0 then 'failed' when coalesce(stale, 0) > 0 then 'stale' when manual > 0 then 'manual_review_required' when passed < 3 then 'pending' else 'passed' end as status from a left join s using (work)""")
def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as works, their orders as gates; two artifacts each, some gone or changed."""
    o = read(spark, sf_dir, "orders")
    gates = o.select(F.col("o_custkey").alias("work"), pick(F.col("o_orderkey"), ["g0", "g1", "g2"]).alias("gate"), F.when(F.col("o_orderkey") % 41 == 0, "failed").when(F.col("o_orderkey") % 37 == 0, "manual_review_required").otherwise("passed").alias("status")).distinct()
    w = F.col("work")
    lineage = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("artifact")).withColumn("sha256", F.lit("a"))
    now = lineage.where(~((w % 9 == 0) & (F.col("artifact") == "0"))).withColumn("sha256", F.when((w % 7 == 0) & (F.col("artifact") == "1"), "b").otherwise("a"))
    return review.final_status(gates, lineage, now, ["g0", "g1", "g2"])


@checked("""with q as (select o_custkey as work, o_orderkey as id, o_orderkey // 100 as part, length(o_orderpriority) as chars from orders), r as (select work, part, count(*) as n, sum(chars) as chars, min(id) as a, max(id) as b from q group by all),
    w as (select *, row_number() over (partition by work order by part) as k from r where part % 10 <> 3),
    f as (select 'part_order' as c from w where k <> part union all select 'part_unplanned' from r where part % 10 = 3 union all select 'segments' from w where part % 10 = 4 union all select 'characters' from w where part % 10 = 5 union all select 'boundary' from w where part % 10 = 6
    union all select 'unanswered' from q where id % 25 = 1 union all select 'unasked' from q where id % 35 = 2) select c as "check", count(*) as n from f group by c""")
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), F.floor(k / 100).alias("part"), k.alias("id"), k.alias("ord"), F.length("o_orderpriority").alias("chars"))
    part = F.col("part") % 10
    plan = asked.groupBy("work", "part").agg(F.count(F.lit(1)).alias("segments"), F.sum("chars").alias("chars"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where(part != 3)
    plan = plan.withColumn("segments", F.when(part == 4, -1).otherwise(F.col("segments"))).withColumn("chars", F.when(part == 5, -1).otherwise(F.col("chars"))).withColumn("last_id", F.when(part == 6, -1).otherwise(F.col("last_id")))
    answers = asked.where("id % 25 <> 1").select("work", "id").unionByName(asked.where("id % 35 = 2").select("work", (-F.col("id") - 1).alias("id")))
    return inventory.counts(review.plan_faults(plan, asked, answers), "check")


@checked("select lang, min(length(trim(text))) as least_text, min(n_chars % 100) as least_ink, count(distinct sha256(case when length(text) <= 500 then text else right(text, 500) end)) as tails from documents group by lang")
def rendering_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("ink", F.col("n_chars") % 100)
    tails = d.groupBy("lang").agg(F.count_distinct(F.sha2(review.log_tail(F.col("text"), 500).cast("binary"), 256)).alias("tails"))
    return review.least_of(d, "lang").join(tails, "lang")


@checked("""with r as (select conv_id as document, turn as range_id, regexp_replace(text, '\\s+', ' ', 'g') as r from conversations), g as (select conv_id as document, turn as group_id, regexp_replace(substr(text, 1 + turn % 3, 12), '\\s+', ' ', 'g') as t from conversations),
    h as (select g.document, group_id, count(range_id) as matches, min(range_id) as range_id from g left join r on r.document = g.document and contains(r, t) group by all) select document, group_id, matches, case when matches = 1 then range_id end as range_id from h""")
def callout_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of turns against the turns of their conversation: the one that holds them."""
    t = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "document")
    ranges = t.select("document", F.col("turn").alias("range_id"), "text")
    return review.callout_ranges(ranges, t.select("document", F.col("turn").alias("group_id"), F.substring(F.col("text"), F.col("turn") % 3 + 1, F.lit(12)).alias("text")))


@checked("""with r as (select l_orderkey as k, l_linenumber as f, l_linenumber + l_quantity::int % 2 as t from lineitem), p as (select k, unnest(generate_series(f, t)) as place from r) select k, place, count(*) as n from p group by all having count(*) > 1""")
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 2).alias("last"))
    return review.disjoint(rows, "k").withColumn("place", F.col("place").cast("long"))


@checked("""with w as (select conv_id, turn, text, string_agg(text, ' ' order by case when conv_id % 4 = 1 then -turn else turn end) over (partition by conv_id rows between unbounded preceding and unbounded following) as whole from conversations),
    a as (select conv_id, turn, case when conv_id % 4 = 2 and turn = 1 then 0 else strpos(whole, text) end as pos from w), b as (select *, lag(pos) over (partition by conv_id order by turn) as before from a)
    select conv_id, count(*) as pieces, count(*) filter (pos > 0) as found, count(*) filter (pos = 0 or pos <= before) = 0 as ordered from b group by conv_id""")
def piece_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns inside the text of their conversation, which runs backwards or lacks a turn in some."""
    t = read(spark, sf_dir, "conversations")
    place = F.when(F.col("conv_id") % 4 == 1, -F.col("turn")).otherwise(F.col("turn"))
    whole = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "text"))), lambda s: s["text"]), " ").alias("whole"))
    lost = (F.col("conv_id") % 4 == 2) & (F.col("turn") == 1)
    rows = t.join(whole, "conv_id").withColumn("piece", F.when(lost, F.lit("\u0001")).otherwise(F.col("text")))
    return review.in_order(rows, "conv_id", "turn", "whole", "piece")


@checked("select role, count(*) filter (turn % 5 <> 0) as textual, count(*) filter (turn % 5 = 0) as visual from conversations group by role")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.evidence_counts(read(spark, sf_dir, "conversations"), "role", F.col("turn") % 5 == 0)


@checked("""with t as (select conv_id, turn, conv_id || '-' || turn as id, trim(text) as text from conversations), c as (select * from t where turn % 3 = 0)
    select c.id as caption, md5(string_agg(t.text, ' ' order by t.turn)) as digest from c join t on t.conv_id = c.conv_id and t.turn between c.turn and c.turn + 2 group by c.id""")
def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("conv_id", "id", F.col("turn").alias("ord"), F.col("text").alias("source"))
    captions = t.where("ord % 3 = 0")
    pairs = captions.select("conv_id", F.col("id").alias("caption"), F.col("ord").alias("_at")).join(t.select("conv_id", F.col("id").alias("block"), "ord"), "conv_id").where("ord between _at + 1 and _at + 2").select("caption", "block")
    return review.joined_continuations(captions, pairs, t).select("caption", F.md5(F.col("text").cast("binary")).alias("digest"))


@checked("""with e as (select user_id, event_type, count(*) as n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from e) select user_id, k::int as place, event_type, n from r where k <= 3""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most common event types of each user: the rule for fonts of a block."""
    return inventory.most_common(read(spark, sf_dir, "events"), "user_id", "event_type", 3)


# -- reading order, lines, manifests -----------------------------------------------------------------


@checked("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents), b as (select *, line_no * 14.0::double + length(line) % 5 as y0 from l),
    g as (select *, y0 - lag(y0 + 10) over w as gap, lag(line) over w as before from b window w as (partition by doc_id order by line_no)),
    m as (select doc_id, gap as median from (select doc_id, gap, row_number() over (partition by doc_id order by gap) as r, count(*) over (partition by doc_id) as n from g where gap >= 0) where r = n // 2 + 1),
    k as (select g.doc_id, line_no, coalesce(regexp_matches(rtrim(before), '[.!?。！？]["'')\\]]?$') and (gap > coalesce(median, 0) + 0.2::double or regexp_matches(ltrim(line), '^(?:Problem|Deliverable|For reference|Note)\\b')), false) as breaks from g left join m on m.doc_id = g.doc_id)
    select doc_id, count(*) as lines, count(*) filter (breaks) + 1 as paragraphs, min(line_no) filter (breaks)::int as first_break from k group by doc_id""")
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    y0 = F.col("line_no") * 14.0 + F.length("line") % 5
    rows = reading.line_breaks(lines(spark, sf_dir).withColumn("y0", y0).withColumn("y1", y0 + 10), "doc_id", "line_no", "line")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("paragraph").alias("paragraphs"), F.min(F.when(F.col("breaks"), F.col("line_no"))).alias("first_break"))


@checked(f"""with l as (select conv_id, turn, text, case when turn % 3 = 1 then text else substr(text, length(text) // 2 + 1) || ' ' || substr(text, 1, length(text) // 2) end as a, case when turn % 3 = 2 then text else substr(text, 1, length(text) // 3) end as b from conversations),
    t as (select conv_id, turn, {tokens('text')} as o, {tokens('a')} as ta, {tokens('b')} as tb from l), g as (select conv_id, turn, {grams('o')} as o, {grams('ta')} as ga, {grams('tb')} as gb from t),
    s as (select conv_id, turn, case when len(o) > 0 then len(list_filter(o, lambda x: list_contains(ga, x))) / len(o) else 1.0 end as sa, case when len(o) > 0 then len(list_filter(o, lambda x: list_contains(gb, x))) / len(o) else 1.0 end as sb from g)
    select conv_id, turn, case when sa >= sb then 'content_stream' else 'geometric' end as strategy, greatest(sa, sb) as score from s""")
def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against two readings of it: halves swapped, or the first third alone."""
    t, n = read(spark, sf_dir, "conversations"), F.length("text")
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    swapped = F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.substring(F.col("text"), half + 1, n), F.lit(" "), F.substring(F.col("text"), F.lit(1), half)))
    short = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), third))
    either = F.array(F.struct(F.lit("content_stream").alias("strategy"), F.lit(0).alias("preference"), swapped.alias("reading")), F.struct(F.lit("geometric").alias("strategy"), F.lit(1).alias("preference"), short.alias("reading")))
    rows = t.select(F.struct("conv_id", "turn").alias("page"), F.col("text").alias("oracle"), F.explode(either).alias("c")).select("page", "oracle", "c.*")
    return reading.best_order(rows, "page", "strategy", "preference", "oracle", "reading", compatible=True).select("page.*", "strategy", "score")


@checked("""select l_orderkey as document, l_linenumber as page, l_partkey, 'p' || lpad(l_linenumber::varchar, 3, '0') || '-b' || lpad((row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice))::varchar, 3, '0') as place_id from lineitem""")
def placed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), "l_partkey", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("o"))
    return reading.placed_ids(rows, "document", "page", "o", "b").drop("o")


@checked(f"""with {_NODES} select document, count(*) as nodes, count(*) filter (output = 'bilingual') as bilingual, count(*) filter (output = 'source-only') as source_only, count(*) filter (output = 'visual-once') as visual_once,
    count(*) filter (output = 'artifact-omitted') as artifact_omitted, count(*) filter (output = 'bilingual' and translatable) as requests from n group by document""")
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.build_manifest(ir.nodes_of(blocks(spark, sf_dir), ROLES, AUXILIARY))


@checked("""with r as (select o_custkey as document, case o_orderkey % 7 when 0 then '../x' when 1 then '/abs' when 2 then 'a//b' else 'img/' || (o_orderkey % 40) || '.png' end as path, o_orderkey from orders),
    f as (select o_custkey as document, 'img/' || (o_orderkey % 40) || '.png' as path from orders where o_orderkey % 3 <> 0)
    select distinct document, path, 'unsafe' as problem from r where o_orderkey % 7 < 3 union all select distinct document, path, 'missing' from r where o_orderkey % 7 >= 3 and not exists (select 1 from f where f.document = r.document and f.path = r.path)""")
def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    image = F.concat(F.lit("img/"), (k % 40).cast("string"), F.lit(".png"))
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "document")
    named = o.select("document", F.when(k % 7 == 0, "../x").when(k % 7 == 1, "/abs").when(k % 7 == 2, "a//b").otherwise(image).alias("path"))
    return reading.asset_references(named, o.where("o_orderkey % 3 <> 0").select("document", image.alias("path")))


@checked("""with p as (select page_id, url, 'http://' || string_split(url, '/')[3] as host from pages), f as (select *, ['CM Math-BoldItalic.otf', 'dejavu/Sans_Mono-Regular.ttf', 'Noto Serif', 'x/y.z/Light.bold'][page_id % 4 + 1] as font from p)
    select page_id, case when starts_with(url, host || '/') then substr(url, length(host) + 2) end as below, null::varchar as elsewhere, replace(replace(url || '{' || page_id || '}', '{', '%7B'), '}', '%7D') as latex, ['cmmath', 'sansmono', 'notoserif', ''][page_id % 4 + 1] as family from f""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("http://"), F.get(F.split("url", "/"), 2))
    font = pick(F.col("page_id"), ["CM Math-BoldItalic.otf", "dejavu/Sans_Mono-Regular.ttf", "Noto Serif", "x/y.z/Light.bold"])
    marked = F.concat("url", F.lit("{"), F.col("page_id").cast("string"), F.lit("}"))
    return read(spark, sf_dir, "pages").select("page_id", reading.relative_to(F.col("url"), host).alias("below"), reading.relative_to(F.col("url"), F.lit("/other")).alias("elsewhere"), reading.latex_url(marked).alias("latex"), reading.font_family(font).alias("family"))


@checked("""with recursive b as (select vec_id, label, round(embedding[1]::double * 20) as y0, round(embedding[1]::double * 20) + 10 + vec_id % 2 as y1, embedding[2]::double as x0 from embeddings),
    o as (select *, row_number() over (partition by label order by y0, x0, vec_id) as k from b),
    f(label, k, vec_id, r, tops, bottoms) as (select label, k, vec_id, 0, [y0], [y1] from o where k = 1
        union all select label, k, vec_id, r, case when r < len(tops) then list_concat(list_concat(tops[1:r], [least(tops[r + 1], y0)]), tops[r + 2:]) else list_append(tops, y0) end,
            case when r < len(bottoms) then list_concat(list_concat(bottoms[1:r], [greatest(bottoms[r + 1], y1)]), bottoms[r + 2:]) else list_append(bottoms, y1) end
        from (select o.label, o.k, o.vec_id, o.y0, o.y1, f.tops, f.bottoms, coalesce(list_position(list_transform(range(1, len(f.tops) + 1), lambda i: abs(f.tops[i] - o.y0) <= 1.2::double and abs(f.bottoms[i] - o.y1) <= 1.2::double), true)::bigint - 1, len(f.tops)) as r from f join o on o.label = f.label and o.k = f.k + 1))
    select vec_id, label, r::bigint as "row" from f""")
def physical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as lines of a block for each label: lines of one row share their edges within 1.2 points."""
    v = lambda i: F.get("embedding", i).cast("double")
    y0 = F.rint(v(0) * 20)
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("line"), v(1).alias("x0"), y0.alias("y0"), v(1).alias("x1"), (y0 + 10 + F.col("vec_id") % 2).alias("y1"))
    return layout.physical_rows(rows, "label").select(F.col("line").alias("vec_id"), "label", "row")


# -- headings, renderings, tool output -------------------------------------------------------------

_CJK = "regexp_matches({c}, '[\u3400-\u9fff]')"
_NUMBER = r"regexp_extract({c}, '^\s*(\d+(?:\.\d+)*)\s+', 1)"
_STRIPPED = "case when " + _NUMBER + " <> '' and " + _NUMBER + r" = {n} then regexp_replace({c}, '^\s*\d+(?:\.\d+)*\s+', '') else {c} end"
_HEADS = """b as (select conv_id, turn, case when (conv_id + turn) % 5 = 4 then 'rule' when (conv_id + turn) % 11 = 3 then 'text' else 'header' end as kind, 2 + conv_id % 2 as level,
    case turn % 4 when 0 then (conv_id % 9) || '.1 ' || role when 1 then (conv_id % 9) || '.1 标题' when 2 then (conv_id % 9) || ' ' || role || ' / ' || (conv_id % 9) || ' 标题' else (conv_id % 9) || '.1 user' end as text from conversations)"""


@checked(rf"""with {_HEADS}, h as (select *, case when kind = 'header' then regexp_extract(text, '^(\S.*?)\s+/\s+(.*\S)$', 1) else '' end as l, regexp_extract(text, '^(\S.*?)\s+/\s+(.*\S)$', 2) as r, kind = 'header' and not {_CJK.format(c='text')} as plain from b where kind <> 'rule'),
    t as (select *, l <> '' and not {_CJK.format(c='l')} and {_CJK.format(c='r')} as two from h),
    p as (select *, lag(plain) over w as pe, lag(level) over w as pl, lag(text) over w as pt from t window w as (partition by conv_id order by turn)),
    s as (select *, coalesce(kind = 'header' and not two and pe and pl = level, false) as beside from p)
    select conv_id, turn, 0 as part, kind, level::int as level, text from b where kind = 'rule'
    union all select conv_id, turn, 0, 'header', level, l from s where two
    union all select conv_id, turn, 1, 'paragraph', null, {_STRIPPED.format(c='r', n='(' + _NUMBER.format(c='l') + ')')} from s where two
    union all select conv_id, turn, 0, 'paragraph', null, {_STRIPPED.format(c='text', n='(' + _NUMBER.format(c='pt') + ')')} from s where beside and {_CJK.format(c='text')}
    union all select conv_id, turn, 0, kind, level, text from s where not two and not (beside and (text = pt or {_CJK.format(c='text')}))""")
def paired_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as titles in two languages, with rules and plain blocks between them."""
    k, n = F.col("conv_id") + F.col("turn"), (F.col("conv_id") % 9).cast("string")
    kind = F.when(k % 5 == 4, "rule").when(k % 11 == 3, "text").otherwise("header")
    place = F.col("turn") % 4
    title = (
        F.when(place == 0, F.concat(n, F.lit(".1 "), F.col("role"))).when(place == 1, F.concat(n, F.lit(".1 标题")))
        .when(place == 2, F.concat(n, F.lit(" "), F.col("role"), F.lit(" / "), n, F.lit(" 标题"))).otherwise(F.concat(n, F.lit(".1 user")))
    )
    blocks = read(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), (2 + F.col("conv_id") % 2).alias("level"), title.alias("text"))
    return headings.paired_headings(blocks, "conv_id", "turn")


_ESCAPED = r"regexp_replace(replace({c}, '\', '\\'), '([`*_{{}}\[\]<>#])', '\\\1', 'g')"
_BULLET = r"'^\s*[-*+]\s+(.*)$'"


@checked(rf"""with s as (select conv_id, turn, ['code','heading','caption','list','prose'][turn % 5 + 1] as kind, case when turn % 5 = 3 then '* ' || replace(text, chr(10), chr(10) || ' + ') else text end as body from conversations),
    e as (select *, {_ESCAPED.format(c='body')} as esc, regexp_extract(body, '^(\d+(?:\.\d+)*)\s+', 1) as num, list_filter(regexp_split_to_array(body, '\r\n|[\n\r\x0B\f\x1C-\x1E]'), lambda x: trim(x) <> '') as shown from s)
    select conv_id, turn, kind, md5('<!-- bilingual:source-only id=' || conv_id || '-' || turn || ' source_sha256=' || sha256(body) || ' -->' || chr(10) || case kind when 'code' then '```text' || chr(10) || body || chr(10) || '```'
        when 'heading' then repeat('#', case when num = '' then 2 else least(4, len(string_split(num, '.')) + 1) end::int) || ' ' || esc when 'caption' then '*' || esc || '*'
        when 'list' then case when len(shown) > 0 and len(list_filter(shown, lambda x: not regexp_matches(x, {_BULLET}))) = 0 then array_to_string(list_transform(shown, lambda x: '- ' || {_ESCAPED.format(c=f"regexp_extract(x, {_BULLET}, 1)")}), chr(10)) else esc end else esc end) as digest from e""")
def source_only_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns shown without a translation, by kind."""
    t = read(spark, sf_dir, "conversations").withColumn("kind", pick(F.col("turn"), ["code", "heading", "caption", "list", "prose"]))
    body = F.when(F.col("kind") == "list", F.concat(F.lit("* "), F.replace("text", F.lit("\n"), F.lit("\n + ")))).otherwise(F.col("text"))
    rows = t.select("conv_id", "turn", "kind", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), body.alias("source")).withColumn("source_sha256", tx.sha256_text(F.col("source")))
    return rendering.source_only_markdown(rows).select("conv_id", "turn", "kind", F.md5(F.col("md").cast("binary")).alias("digest"))


@checked("""with r as (select label, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d, (label % 4) * 90 as turn from embeddings),
    u as (select label, turn, least(a, b) as x0, least(c, d) as y0, greatest(a, b) as x1, greatest(c, d) as y1 from r),
    v as (select label, case turn when 90 then 0.25 - y1 when 180 then 0.25 - x1 when 270 then y0 else x0 end as x0, case turn when 90 then x0 when 180 then 0.2 - y1 when 270 then 0.2 - x1 else y0 end as y0,
        case turn when 90 then 0.25 - y0 when 180 then 0.25 - x0 when 270 then y1 else x1 end as x1, case turn when 90 then x1 when 180 then 0.2 - y0 when 270 then 0.2 - x0 else y1 end as y1 from u),
    k as (select label, greatest(x0, 0) as x0, greatest(y0, 0) as y0, least(x1, 0.25) as x1, least(y1, 0.2) as y1 from v), g as (select * from k where x1 > x0 and y1 > y0),
    e as (select distinct label, unnest([x0, x1]) as l from g), s as (select label, l, lead(l) over (partition by label order by l) as h from e),
    i as (select s.label, s.l, s.h, g.y0, g.y1, max(g.y1) over (partition by s.label, s.l order by g.y0, g.y1 rows between unbounded preceding and 1 preceding) as reach from s join g on g.label = s.label and g.x0 < s.h and g.x1 > s.l where s.h is not null),
    t as (select label, sum((h - l) * greatest(y1 - greatest(y0, coalesce(reach, y0)), 0)) as area from i group by label)
    select p.label as page, round(least(1.0, coalesce(area, 0) / (0.25 * 0.2)), 6) as ratio from (select distinct label from embeddings) p left join t on t.label = p.label""")
def raster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as picture boxes on a turned page for each label, cut to the page."""
    v = lambda i: F.get("embedding", i).cast("double")
    boxes = read(spark, sf_dir, "embeddings").select(F.col("label").alias("page"), F.least(v(0), v(1)).alias("x0"), F.least(v(2), v(3)).alias("y0"), F.greatest(v(0), v(1)).alias("x1"), F.greatest(v(2), v(3)).alias("y1"))
    sheets = boxes.select("page").distinct().select("page", F.lit(0.25).cast("double").alias("width"), F.lit(0.2).cast("double").alias("height"), (F.col("page") % 4 * 90).alias("turn"))
    return geo.raster_coverage(sheets, boxes)


@checked(r"""with l as (select doc_id, text || case doc_id % 4 when 0 then chr(10) || 'Overfull \hbox (' || doc_id || 'pt)' when 1 then chr(10) || 'Missing character: ' || doc_id when 2 then chr(10) || 'x Reference ' || doc_id || ' undefined' else '' end as log from documents),
    x as (select doc_id, unnest(string_split(log, chr(10))) as line, generate_subscripts(string_split(log, chr(10)), 1) - 1 as line_no from l)
    select doc_id, 'overfull_box' as "check", line_no, line from x where starts_with(line, 'Overfull \hbox') union all select doc_id, 'missing_character', line_no, line from x where starts_with(line, 'Missing character:')
    union all select doc_id, 'undefined_reference', line_no, line from x where regexp_matches(line, 'Reference .* undefined|There were undefined references')""")
def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs of a tool, three of four with a fault in the last line."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    fault = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\nOverfull \\hbox ("), k, F.lit("pt)"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\nMissing character: "), k)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("\nx Reference "), k, F.lit(" undefined"))).otherwise("")
    return headings.log_findings(d.select("doc_id", F.concat("text", fault).alias("log")), "doc_id", "log")


@checked(rf"""with t as (select conv_id, turn, role || case turn % 3 when 0 then '.' when 1 then '' else '?' end as a, (conv_id % 7) || 'x' as b, turn * 14 + case when turn % 4 = 2 then 9 else 0 end as y, conv_id % 3 = 1 as near from conversations),
    l as (select conv_id as block, turn, y, a || case when near then '' else ' ' end || b as body, a, b from t),
    g as (select *, y - (lag(y) over w + 10) as gap, lag(body) over w as before from l window w as (partition by block order by turn)),
    r as (select block, gap, row_number() over (partition by block order by gap) as k, count(*) over (partition by block) as n from g where gap >= 0), m as (select block, gap as median from r where k = n // 2 + 1),
    x as (select g.*, coalesce(regexp_matches(before, '[.!?]$') and gap > coalesce(median, 0) + 0.2, false) as breaks from g left join m on m.block = g.block)
    select block, string_agg(case when before is null then '' when breaks then chr(10) || chr(10) else chr(10) end || body, '' order by turn) as "text", count(*) as lines, 1 + count(*) filter (breaks) as paragraphs,
        round(sum(length(b)) filter (block % 2 = 0) / sum(length(a) + length(b)), 4) as bold_ratio from x group by block""")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks: each turn a line of two spans, with wider gaps below some."""
    c = read(spark, sf_dir, "conversations")
    y = (F.col("turn") * 14 + F.when(F.col("turn") % 4 == 2, 9).otherwise(0)).cast("double")
    first = F.concat("role", F.when(F.col("turn") % 3 == 0, ".").when(F.col("turn") % 3 == 1, "").otherwise("?"))
    second = F.concat((F.col("conv_id") % 7).cast("string"), F.lit("x"))
    at = F.when(F.col("conv_id") % 3 == 1, 50.5).otherwise(53.0)
    spans = F.array(
        F.struct(F.lit(0.0).alias("x0"), F.lit(50.0).alias("x1"), first.alias("text"), F.lit("Times").alias("font")),
        F.struct(at.alias("x0"), F.lit(90.0).alias("x1"), second.alias("text"), F.when(F.col("conv_id") % 2 == 0, "Times-Bold").otherwise("Times").alias("font")),
    )
    rows = c.select(F.col("conv_id").alias("block"), F.lit(0.0).alias("left"), F.col("turn").alias("line"), F.lit(0.0).alias("lx0"), y.alias("ly0"), F.lit(90.0).alias("lx1"), (y + 10).alias("ly1"), F.explode(spans).alias("s"))
    rows = rows.select("block", "left", "line", "lx0", "ly0", "lx1", "ly1", "s.x0", F.col("ly0").alias("y0"), "s.x1", F.col("ly1").alias("y1"), "s.text", "s.font", F.lit(10.0).alias("size"))
    return bl.block_texts(rows).select("block", "text", F.col("lines").cast("long"), F.col("paragraphs").cast("long"), F.nullif("bold_ratio", F.lit(0.0)).alias("bold_ratio"))
