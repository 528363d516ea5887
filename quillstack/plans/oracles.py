"""DuckDB SQL for the registered queries: the same results from the same Parquet tables."""

from __future__ import annotations

_NORM = "trim(regexp_replace(translate({c}, '’‘“”—–', '''''\"\"--'), '\\s+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower(" + _NORM + "), '[a-z_][a-z0-9_]*(?:''[a-z]+)?|\\d+(?:\\.\\d+)*')"
_GRAMS = "list_transform(range(1, greatest(len({t}) - 3, 1)), lambda i: array_to_string({t}[i:i+4], ' '))"


def norm(c: str) -> str:
    return _NORM.format(c=c)


def tokens(c: str) -> str:
    return _TOKENS.format(c=c)


def grams(t: str) -> str:
    return _GRAMS.format(t=t)


def sha(c: str) -> str:
    return f"sha256({c})"


_COVERAGE = f"""
    o as (select item_id, {tokens('text')} as t from benchmark),
    og as (select item_id, unnest({grams('t')}) as gram from o),
    d as (select {tokens('text')} as t from documents),
    dg as (select distinct unnest({grams('t')}) as gram from d),
    s as (select b.item_id, count(dg.gram) as hits, count(og.gram) as total
          from benchmark b left join og on og.item_id = b.item_id left join dg on dg.gram = og.gram group by b.item_id),
    c as (select item_id, hits, total, case when total > 0 then hits / total else 1.0 end as score from s)
"""
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"
_OPEN = "(not regexp_matches({c}, '[.!?;:。！？；：][\"'')\\]]?$') or coalesce(lower(regexp_extract({c}, '([A-Za-z]+)[^\\pL\\pN_]*$', 1)), '') in ('a','an','and','as','at','by','for','from','in','of','or','the','to','with'))"
_URLS = "list_sort(list_distinct(list_transform(regexp_extract_all(url, 'https?://[^\\s<>\"]+'), lambda u: regexp_replace(u, '[.,;:!?)\\]]+$', ''))))"
_BARE = "regexp_replace(regexp_replace(html, '(?is)<(?:script\\b.*?</script|style\\b.*?</style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_SIGNS = f"replace(replace(replace(replace(replace(replace(replace({_BARE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&#39;', chr(39)), '&amp;', '&')"
VISIBLE = f"trim(regexp_replace({_SIGNS}, '\\s+', ' ', 'g'))"
RECT = "select label, vec_id as id, least(v0, v1) as x0, least(v2, v3) as y0, greatest(v0, v1) as x1, greatest(v2, v3) as y1 from (select label, vec_id, embedding[1]::double as v0, embedding[2]::double as v1, embedding[3]::double as v2, embedding[4]::double as v3 from embeddings)"
_T = "t as (select *, conv_id || '-' || turn as id from conversations)"
_STAGES = ["source_audit", "translation_plan", "translation_audit", "output_audit", "docx_audit", "compile_audit", "visual_review", "qa_report"]
_GATES = f"""s as (select unnest({_STAGES}) as gate, generate_subscripts({_STAGES}, 1) - 1 as k),
    g as (select c_custkey as work, gate, k, case when (c_custkey * 7 + k) % 29 = 5 then 'failed' when (c_custkey * 7 + k) % 31 = 6 then 'manual_review_required' else 'passed' end as status from customer, s where k <= c_custkey % 11)"""
_RUN_NAMES = ["title", "author-affiliation", "abstract", "section", "theorem", "proof", "subsection", "references"]
_ROLES = "r(doc, ord, role) as (values " + ",".join(
    f"({-d}::bigint,{i}::bigint,'{x}')"
    for d, run in (
        (1, "title author-affiliation abstract section theorem proof subsection references"),
        (2, "title subsection section proof theorem abstract"),
        (3, "title abstract author-affiliation section lemma section proof references"),
        (4, "paragraph paragraph"),
    )
    for i, x in enumerate(run.split())
) + f" union all select conv_id, turn, {_RUN_NAMES}[(conv_id + turn + length(text)) % 8 + 1] from conversations)"

ORACLES: dict[str, str] = {
    "coverage_by_item": f"with {_COVERAGE} select * from c",
    "coverage_global": f"""with {_COVERAGE}, g as (select coalesce(sum(hits), 0)::bigint as hits, coalesce(sum(total), 0)::bigint as total from c)
        select hits, total, case when total > 0 then hits / total else 1.0 end as score,
               case when case when total > 0 then hits / total else 1.0 end >= 0.95 then 'passed' else 'failed' end as status from g""",
    "source_copy_pairs": f"""
        with w as (select conv_id, turn, role, text, lag(text) over o as said, lag(role) over o as spoke from conversations window o as (partition by conv_id order by turn)),
        p as (select conv_id, turn, {tokens('said')} as a, {tokens('text')} as b from w where spoke = 'user' and role = 'assistant'),
        g as (select conv_id, turn, {grams('a')} as s, {grams('b')} as t from p),
        r as (select conv_id, turn, len(s)::int as grams, len(list_filter(s, lambda x: list_contains(t, x)))::int as copied from g),
        q as (select *, case when grams > 0 then copied / grams else 0.0 end as ratio from r)
        select *, grams >= 8 and ratio >= 0.8 as is_copy from q""",
    "margin_repetitions": f"""
        with e as (select doc_id, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) as line from documents),
        k as (select regexp_replace(lower({norm('line')}), '\\d+', '#', 'g') as key, doc_id from e)
        select key, count(distinct doc_id) as pages from k where key <> '' group by key having count(distinct doc_id) >= 3""",
    "duplicate_blocks": f"select {sha('text')} as sha256, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) > 1",
    "kind_counts": f"""
        with {_LINES}, t as (select {norm('line')} as t from l),
        s as (select t, len(regexp_extract_all(t, '[=∑√∫∏≤≥≠≈→←⊤⊥⋅×⊙]')) >= 1 and regexp_matches(t, '\\(\\d+\\)\\s*$') and len(regexp_extract_all(t, '\\b[A-Za-z]{{3,}}\\b')) <= 4 and length(t) <= 500 as mathy from t),
        k as (select case when t = '' then 'empty' when mathy and regexp_matches(t, '(?i)^where\\b') then 'math_with_text' when mathy then 'math'
                     when regexp_matches(t, '(?i)^(Figure|Table|Algorithm)\\s+\\d+\\s*:') then 'caption'
                     when regexp_matches(t, '(?i)^(Problem|Example|Low-Resource Tip)\\s*[(:]') then 'callout'
                     when length(t) <= 220 and regexp_matches(t, '^\\d+(?:\\.\\d+)*\\s+\\S') then 'heading'
                     when regexp_matches(t, '(?i)^(?:[•*-]|\\d+[.)]|\\([a-z]\\))\\s+') then 'list' else 'prose' end as kind from s)
        select kind, count(*) as n, kind not in ('artifact', 'code', 'math') as translatable from k group by kind""",
    "role_inventory": f"""
        with r(role, role_ord, least, most) as (values ('system',0,0,null::int),('user',1,1,null),('assistant',2,1,null),('tool',3,0,5),('narrator',4,1,null)), {_T},
        c as (select role, count(*) as node_count, count(distinct conv_id) as group_count, min(id) as first_id from t group by role)
        select r.role, role_ord, least, most, coalesce(node_count, 0) as node_count, coalesce(group_count, 0) as group_count, first_id,
               coalesce(node_count, 0) >= least and (most is null or coalesce(node_count, 0) <= most) as within_bounds
        from r left join c on c.role = r.role""",
    "upper_median_chars": """
        with w as (select lang, n_chars, row_number() over (partition by lang order by n_chars) as r, count(*) over (partition by lang) as n from documents)
        select lang, n_chars as median from w where r = n // 2 + 1""",
    "weighted_ratios": """
        select source, sum(case when lang = 'en' then n_chars else 0 end) / greatest(sum(n_chars), 1) as english,
               sum(case when n_chars > 2000 then n_chars else 0 end) / greatest(sum(n_chars), 1) as long from documents group by source""",
    "selector_winner": """
        with m as (select doc_id, unnest([
            case when lang = 'de' and regexp_matches(trim(text), '(?i)\\bdie\\b') then {'tier': 4, 'n': 2, 'r': 0, 's': 0, 'role': 'german-note'} end,
            case when lang = 'de' then {'tier': 4, 'n': 1, 'r': 0, 's': -1, 'role': 'german-note'} end,
            case when source in ('src0', 'src1') then {'tier': 1, 'n': 1, 'r': -1, 's': 0, 'role': 'main-source'} end,
            case when regexp_matches(trim(text), '\\d+') then {'tier': 2, 'n': 1, 'r': -2, 's': 0, 'role': 'numbered'} end,
            case when lang = 'en' then {'tier': 3, 'n': 1, 'r': -3, 's': 0, 'role': 'english'} end,
            case when source = 'src2' and regexp_matches(trim(text), '(?i)^the\\b') then {'tier': 2, 'n': 2, 'r': -3, 's': -1, 'role': 'english'} end]) as m from documents),
        k as (select doc_id, m, row_number() over (partition by doc_id order by m.tier desc nulls last, m.n desc, m.r desc, m.s desc) as k from m)
        select doc_id, m.role as role, m.tier as tier, -m.s as selector from k where k = 1""",
    "review_reasons": f"""
        with p as (select page_id, length({VISIBLE})::double as native, length(html)::double as adapter, page_id % 7 as blocks, (page_id % 10) / 10.0::double as raster, 0.69::double + (page_id % 4) / 100.0::double as display from pages)
        select page_id, array_to_string(list_filter([case when blocks = 0 then 'no_blocks' end, case when native < 1000 then 'sparse_native_text' end,
               case when native > 0 and native < 1000 and adapter >= 2 * native then 'adapter_text_exceeds_native' end, case when raster >= 0.5 then 'large_raster' end,
               case when least(abs(0.7::double - display), abs(0.7::double - 1 / display)) > 0.02 then 'page_ratio' end], lambda x: x is not null), ',') as reasons from p""",
    "context_window": """
        with v as (select *, case when role <> 'system' and trim(text) <> '' then substr(trim(replace(text, chr(10), ' ')), 1, 320) end as v from conversations)
        select conv_id, turn, coalesce(last_value(v ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as context_before,
               coalesce(first_value(v ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following), '') as context_after from v""",
    "page_order": """
        select conv_id, turn, row_number() over w::int as page_order, row_number() over w = 1 as starts_page,
               role = 'user' and sum(case when role = 'user' then 1 else 0 end) over w = 1 as is_title
        from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""",
    "paragraph_islands": f"""
        with {_LINES}, w as (select *, lag(line) over (partition by doc_id order by line_no) as p from l),
        o as (select *, case when p is not null and {_OPEN.format(c='p')} and length(p) + length(line) <= 1800 then 0 else 1 end as opens from w),
        i as (select *, sum(opens) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as island from o)
        select doc_id, island::bigint as island, count(*) as n_lines, sum(length(line))::bigint as chars, min(line_no)::int as first_line from i group by doc_id, island""",
    "greedy_chunks": """
        with recursive b as (select item_id, length(text) as n, row_number() over (order by item_id) as k from benchmark),
        f(k, item_id, n, chunk, held) as (select k, item_id, n, 1, n from b where k = 1
            union all select b.k, b.item_id, b.n, case when f.held > 0 and f.held + b.n > 1000 then f.chunk + 1 else f.chunk end, case when f.held > 0 and f.held + b.n > 1000 then b.n else f.held + b.n end
            from f join b on b.k = f.k + 1)
        select chunk::bigint as chunk, count(*) as n, sum(n)::bigint as chars, min(item_id) as first_id, max(item_id) as last_id from f group by chunk""",
    "anchored_clusters": """
        with recursive b as (select p_brand, p_retailprice as y, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as k from part),
        f(p_brand, k, y, cluster, anchor) as (select p_brand, k, y, 1, y from b where k = 1
            union all select b.p_brand, b.k, b.y, case when b.y - f.anchor > 18 then f.cluster + 1 else f.cluster end, case when b.y - f.anchor > 18 then b.y else f.anchor end
            from f join b on b.p_brand = f.p_brand and b.k = f.k + 1)
        select p_brand, cluster::bigint as cluster, count(*) as n, min(y) as anchor, max(y) as top from f group by p_brand, cluster""",
    "first_use_numbers": "with f as (select source, min(doc_id) as first_at from documents group by source) select source, first_at, row_number() over (order by first_at, source)::int as number from f",
    "order_checks": """
        with c as (select conv_id, count(turn) as members, max(turn) - min(turn) + 1 = count(turn) and count(distinct turn) = count(turn) as is_contiguous from conversations group by conv_id),
        w as (select conv_id, turn, row_number() over o - 1 as pos, length(text) as n, lag(length(text)) over o as p from conversations window o as (partition by conv_id order by turn)),
        a as (select conv_id, count(*) filter (pos <> turn) as off, count(*) filter (p > n) as backward from w group by conv_id)
        select c.conv_id, members, is_contiguous, off, backward from c join a on a.conv_id = c.conv_id""",
    "constraint_rules": f"""
        with {_ROLES},
        m as (select *, max(case when role = 'section' then ord end) over w as s, max(case when role in ('theorem','lemma','proposition','corollary') then ord end) over w as t from r window w as (partition by doc order by ord rows between unbounded preceding and current row)),
        f as (select doc, count(*) filter (role = 'subsection' and s is null) = 0 as heading_hierarchy,
                     count(*) filter (role = 'proof' and (t is null or (s is not null and t < s))) = 0 as proof_order,
                     min(ord) filter (role = 'title') as a, min(ord) filter (role = 'abstract') as b, min(ord) filter (role = 'section') as c, min(ord) filter (role = 'references') as d,
                     min(ord) filter (role = 'author-affiliation') as e, max(ord) filter (role = 'author-affiliation') as g from m group by doc)
        select doc, heading_hierarchy, proof_order, coalesce(a < b and b < c and c < d and (e is null or (a < e and g < b)), false) as academic_order from f""",
    "marker_ranges": """
        with m(doc, ord, kind) as (values (-1::bigint,0::bigint,'begin'),(-1,1,'text'),(-1,2,'end'),(-1,3,'end'),(-2,0,'begin'),(-2,1,'begin'),(-2,2,'end'),(-2,3,'text')
            union all select conv_id, turn, case when role = 'user' then 'begin' when length(text) % 3 = 0 then 'text' else 'end' end from conversations),
        d as (select *, (sum(case kind when 'begin' then 1 when 'end' then -1 else 0 end) over w)::bigint as depth, (sum(case when kind = 'begin' then 1 else 0 end) over w)::bigint as segment from m window w as (partition by doc order by ord))
        select doc, ord, kind, depth, case when depth < 0 then 'end without begin' when depth > 1 and kind = 'begin' then 'begin inside' end as fault, segment from d""",
    "border_ranges": """
        with r as (select conv_id, turn, case when role <> 'system' then role end as colour, length(text) % 5 = 0 as bottom from conversations),
        o as (select *, case when colour = lag(colour) over w and not coalesce(lag(bottom) over w, false) then 0 else 1 end as opens from r window w as (partition by conv_id order by turn)),
        i as (select *, (sum(opens) over (partition by conv_id order by turn rows between unbounded preceding and current row))::bigint as run from o)
        select conv_id, run, colour, min(turn) as first, max(turn) as last, count(*) as n from i where colour is not null group by conv_id, run, colour""",
    "missing_extra_ids": """
        with l as (select doc_id from labels union all values (-1), (-2))
        select distinct doc_id, 'missing' as side from documents where doc_id not in (select doc_id from l)
        union all select distinct doc_id, 'extra' from l where doc_id not in (select doc_id from documents)""",
    "response_join": """
        with q as (select doc_id, n_chars::varchar as sha from documents),
        a as (select l.doc_id, case when quality = 0 then 'old' else d.n_chars::varchar end as sha from labels l join documents d on d.doc_id = l.doc_id union all values (-1, 'x'), (-2, 'y'), (-2, 'y')),
        g as (select doc_id, count(*) as n, min(sha) as h from a group by doc_id),
        s as (select case when q.doc_id is null then 'unknown' when g.n is null then 'missing' when g.n > 1 then 'repeated' when g.h <> q.sha then 'stale' else 'answered' end as status from q full join g on g.doc_id = q.doc_id)
        select status, count(*) as n from s group by status""",
    "one_to_one": """
        with b as (select l_orderkey as id, count(*) as n from lineitem group by 1),
        p as (select case when b.id is null then 'missing' when o.o_orderkey is null then 'extra' when b.n > 1 then 'repeated' end as problem from orders o full join b on b.id = o.o_orderkey)
        select problem, count(*) as n from p where problem is not null group by problem""",
    "caption_parent": f"""
        with {_T}, w as (select id, role, lag(id) over (partition by conv_id order by turn) as parent from t)
        select w.id, w.parent, p.role as parent_role, coalesce(p.role in ('user'), false) as valid from w left join t p on p.id = w.parent where w.role = 'assistant'""",
    "glossary_hits": """
        with h as (select text, unnest([case when regexp_matches(text, '(?i)(^|[^\\pL\\pN_])the([^\\pL\\pN_]|$)') then 'the' end, case when regexp_matches(text, '(^|[^\\pL\\pN_])Is([^\\pL\\pN_]|$)') then 'Is' end,
                   case when regexp_matches(text, '(?i)(^|[^\\pL\\pN_])with([^\\pL\\pN_]|$)') then 'with' end]) as term from documents)
        select term, count(*) as docs, count(*) filter ((term = 'the' and not contains(text, 'der') and not contains(text, 'die')) or (term = 'with' and not contains(text, 'mit'))) as violations
        from h where term is not null group by term""",
    "set_ops_ids": """
        with a as (select doc_id from documents), b as (select doc_id from labels),
        u as (select 'intersect' as op, * from (select * from a intersect select * from b) union all select 'except', * from (select * from a except all select * from b) union all select 'union', * from (select * from a union select * from b))
        select op, count(*) as n, sum(doc_id)::bigint as total from u group by op""",
    "page_range_cover": """
        with p as (select page_id + 1 as page from pages),
        s as (select (page - 1) // 16 as sheet, min(page) as first, max(page) + case when ((min(page) - 1) // 16) % 3 = 0 then 1 else 0 end as last from p group by 1),
        c as (select page, count(*) as covers from (select unnest(generate_series(first, last)) as page from s) group by page)
        select coalesce(p.page, c.page) as page, coalesce(covers, 0) as covers, p.page is not null as exists from p full join c on c.page = p.page where coalesce(covers, 0) <> 1 or p.page is null""",
    "hash_pins": f"""
        select doc_id as artifact, 'stale' as pinned, {sha('text')} as actual from documents where doc_id % 10 = 0 union all select -1, 'gone', null""",
    "exact_matches": """
        with m as (select c_custkey, count(s_suppkey) as matches, min(s_suppkey) as target from customer left join supplier on s_nationkey = c_nationkey and floor(s_acctbal / 1000) = floor(c_acctbal / 1000) group by c_custkey)
        select c_custkey, matches, case when matches = 1 then 'exact' when matches > 1 then 'ambiguous' else 'unmatched' end as status, case when matches = 1 then target end as target from m""",
    "group_members": """
        with e as (select o_custkey as g, case when o_orderkey % 13 = 4 then -o_orderkey else o_orderkey end as id from orders), l as (select g, id, count(*) as n from e group by all)
        select g as "group", count(*) as members, count(*) filter (id not in (select o_orderkey from orders)) as unknown, count(*) filter (n > 1) as repeated from l group by g""",
    "uri_inventory": f"select uri, count(*) as n from (select unnest({_URLS}) as uri from pages) group by uri",
    "link_extract": """
        with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)
        select page_id, count(*) as links, count(distinct href) as distinct_links, min(href) as first_href from h group by page_id""",
    "html_text": f"with t as (select page_id, {VISIBLE} as t from pages) select page_id, length(t)::bigint as chars, ((length(t) - length(replace(t, 'the', ''))) // 3)::bigint as the_count, md5(t) as digest from t",
    "word_counts": f"""
        select doc_id, len(regexp_extract_all(regexp_replace(text, '[\\pL\\pN_]*[^\\x00-\\x7F][\\pL\\pN_]*', '1', 'g'), '\\b[A-Za-z]{{2,}}\\b'))::bigint as words, regexp_matches(text, '[㐀-䶿一-鿿豈-﫿]') as cjk, len({tokens('text')})::bigint as tokens from documents""",
    "heading_level": """
        with t as (select unnest(['1 Introduction', '2.1 Methods', '3.2.1 Detail', '4.1.2.3 Deep', 'Plain', '5. Dotted', '10 Ten']) as title union all select string_split(text, chr(10))[1] from documents),
        n as (select regexp_extract(title, '^(\\d+(?:\\.\\d+)*)\\s+', 1) as n from t)
        select (case when n = '' then 2 else least(4, len(string_split(n, '.')) + 1) end)::int as level, count(*) as n from n group by 1""",
    "json_pointer": "with k as (select unnest(json_keys(props)) as key from events) select '/props/' || replace(replace(key, '~', '~0'), '/', '~1') as pointer, count(*) as n from k group by 1",
    "problem_ids": """
        select * from (values (-1::bigint, 'a1,b_2'), (-2, 'c3'), (-3, ''), (-4, ''), (-5, 'd,a1')) v(id, ids)
        union all select doc_id, concat_ws(',', nullif(array_to_string(regexp_extract_all(text, '(?i)(?:problem|问题)\\s*[（(]([a-z0-9_]+)', 1), ','), ''), case when doc_id % 3 < 2 then doc_id::varchar end) from documents""",
    "page_split": """
        with p as (select doc_id, string_split(text, chr(10)) as p from documents), k as (select doc_id, case when regexp_matches(p[-1], '^\\s*$') then p[:-2] else p end as p from p)
        select doc_id, len(p)::bigint as pages, list_sum(list_transform(p, lambda x: length(x)))::bigint as chars from k where len(p) > 0""",
    "markdown_build": """
        with t as (select conv_id, turn, role, conv_id || '-' || turn as id, sha256(text) as sha, regexp_replace(replace(regexp_replace(trim(text), '[ \\t]*\\n[ \\t]*', ' ', 'g'), '\\', '\\\\'), '([`*_{}\\[\\]<>#])', '\\\\\\1', 'g') as s, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s+', 1) as n from conversations),
        m as (select conv_id, turn, '<!-- bilingual:segment id=' || id || ' source_sha256=' || sha || ' -->' || chr(10) ||
                     case role when 'system' then '**' || s || '**' || chr(10) || chr(10) || '> **done.**'
                               when 'user' then repeat('#', case when n = '' then 2 else least(4, len(string_split(n, '.')) + 1) end::int) || ' ' || s || chr(10) || chr(10) || '> **done.**'
                               else s || chr(10) || chr(10) || '> done.' end as md from t),
        d as (select conv_id, string_agg(md, chr(10) || chr(10) order by turn) as md from m group by conv_id)
        select conv_id, md5(md) as digest, length(md)::bigint as chars from d""",
    "placeholder_roundtrip": "select doc_id, md5(text) as digest, length(text)::bigint as chars, doc_id % 10 <> 3 as complete from documents",
    "rect_join": f"""
        with r as ({RECT}), p as (select a.label, a.id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as shared, (b.x1 - b.x0) * (b.y1 - b.y0) as area
             from r a join r b on a.label = b.label and a.id <> b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)
        select label, count(*) as pairs, count(distinct id) as holders, round(sum(shared), 6) as shared from p where shared > 0 and shared >= 0.65 * area group by label""",
    "rect_union_area": f"""
        with r as ({RECT}), e as (select distinct label, unnest([x0, x1]) as l from r), s as (select label, l, lead(l) over (partition by label order by l) as h from e),
        i as (select s.label, s.l, s.h, r.y0, r.y1, max(r.y1) over (partition by s.label, s.l order by r.y0, r.y1 rows between unbounded preceding and 1 preceding) as reach from s join r on r.label = s.label and r.x0 < s.h and r.x1 > s.l where s.h is not null),
        a as (select label, sum((h - l) * greatest(y1 - greatest(y0, coalesce(reach, y0)), 0)) as area from i group by label),
        b as (select label, (max(x1) - min(x0)) * (max(y1) - min(y0)) as box from r group by label)
        select a.label, round(area, 6) as area, round(box, 6) as box_area from a join b on b.label = a.label""",
    "gate_rollup": f"""with {_GATES}, p as (select unnest([0, 1, 2, 3, 4]) as part), x as (select p.part, g.status from p left join g on (p.part < 3 and work % 4 = p.part) or (p.part = 3 and status = 'passed'))
        select part, count(status) as gates, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'manual_review_required') as manual,
               case when count(status) = 0 then 'pending' when count(*) filter (status = 'failed') > 0 then 'failed' when count(*) filter (status = 'manual_review_required') > 0 then 'manual_review_required' else 'passed' end as status from x group by part""",
    "next_actions": f"""with {_GATES}, w as (select c_custkey as work, min(s.k) filter (status is distinct from 'passed') as k from customer cross join s left join g on g.work = c_custkey and g.gate = s.gate group by 1)
        select w.work, s.gate as stage, case when s.gate is null then 'complete' when g.status = 'manual_review_required' then 'review ' || s.gate else 'run ' || s.gate end as action from w left join s on s.k = w.k left join g on g.work = w.work and g.gate = s.gate""",
    "source_gate": """
        with c as (select 'block_hash' as "check", count(*) as n from documents where doc_id % 100 = 3 union all select 'link_known', count(*) from documents where doc_id % 50 = 49
            union all select 'visual_anchor', count(*) from labels where case when doc_id % 40 = 1 then -doc_id else doc_id end not in (select doc_id from documents)
            union all select 'page_cover', count(*) from (select page_id // 10 as s from pages group by 1) where s % 5 = 0)
        select 'source' as gate, "check", n from c where n > 0""",
    "translation_gate": f"""
        with t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer from conversations),
        a as (select *, case when conv_id % 4 = 0 then text when conv_id % 10 = 5 then answer || ' ⟦K001⟧' else answer end as tr0, case when conv_id % 5 = 0 then replace(tr0, '⟦K001⟧', 'of') else tr0 end as tr from t where role = 'user'),
        g as (select *, {grams("tk")} as s, {grams("tt")} as x from (select *, {tokens('text')} as tk, {tokens('tr')} as tt from a where answer is not null)),
        w as (select *, len(regexp_extract_all(regexp_replace(text, '[\\pL\\pN_]*[^\\x00-\\x7F][\\pL\\pN_]*', '1', 'g'), '\\b[A-Za-z]{{2,}}\\b')) as words from a where answer is not null),
        c as (select 'response' as "check", count(*) as n from a where answer is null or conv_id % 9 = 0
            union all select 'untranslated', count(*) from w where words >= 4 and not regexp_matches(tr, '[㐀-䶿一-鿿豈-﫿]')
            union all select 'copied', count(*) from g where len(s) >= 8 and len(list_filter(s, lambda q: list_contains(x, q))) / len(s) >= 0.8
            union all select 'placeholders', count(*) from a where answer is not null and conv_id % 5 = 0 and not (conv_id % 10 = 5 and conv_id % 4 <> 0)
            union all select 'glossary', count(*) from a where answer is not null and not contains(tr, 'der') and not contains(tr, 'of'))
        select 'translation' as gate, "check", n from c where n > 0""",
}
