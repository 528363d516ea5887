"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

ORACLES: dict[str, str] = {
    "op7_exact_dedup": f"""
        with n as (select doc_id, length(coalesce(text, '')) as chars, {_NORM} as norm from documents),
        k as (select *, count(*) over (partition by norm) as group_size,
                     first_value(doc_id) over (partition by norm order by chars desc, doc_id nulls last) as keep_id from n)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256 from k
    """,
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest from p),
        k as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes < 100 or first_id is not distinct from page_id then 'response' else 'revisit' end as record_type,
               case when payload_bytes >= 100 and first_id is distinct from page_id then first_id end as refers_to
        from k
    """,
    "op13_phrases": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents),
        worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
        counted as (select lang, sum(len(w))::bigint as n from worded group by lang),
        spans as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded where len(w) > 0),
        grams as (select lang, width, array_to_string(w[i : i + width - 1], ' ') as phrase from spans, (values (1), (2), (3), (4)) s(width) where i + width - 1 <= len(w)),
        f as materialized (select lang, width, phrase, count(*) as a from grams group by all having count(*) >= 30),
        c as (select *, string_split(phrase, ' ') as w from f where width > 1),
        cuts as (
            select c.lang, c.phrase, c.a, c.width, k, x.a as l, y.a as r, ((2000000::hugeint * c.a) // (x.a + y.a))::bigint as score
            from c, (values (1), (2), (3)) t(k), f x, f y
            where k < c.width and x.lang = c.lang and y.lang = c.lang
              and x.phrase = array_to_string(c.w[1 : k], ' ') and y.phrase = array_to_string(c.w[k + 1 : c.width], ' ')),
        lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        inner_ as (
            select lang, array_to_string(w[i : i + n - 1], ' ') as phrase, max(a) as longer
            from c, (values (2), (3)) s(n), (values (1), (2), (3)) t(i)
            where n < width and i + n - 1 <= width group by all),
        ranked as (
            select lowest.lang, lowest.phrase, a, l, r, score, row_number() over (partition by lowest.lang order by score desc, a desc, encode(lowest.phrase)) as rank
            from lowest left join inner_ on lowest.lang = inner_.lang and lowest.phrase = inner_.phrase
            where longer is null or 100::hugeint * longer < 80::hugeint * a)
        select lang, rank, phrase, a, l, r, n, score from ranked join counted using (lang) where rank <= 2000
    """,
    "op12_conversations": r"""
        with recursive crc as (
            select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when (c & 1) = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) order by n) as tab from range(256) r(n)),
        keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c)::bigint) as key from conversations),
        kinds as (
            select conv_id, turn, role, text,
                   xor(list_reduce(list_prepend(4294967295::bigint, key), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) % 20 as kind from keyed, crc),
        turns as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                   case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from kinds where kind <> 0),
        placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text), copy) as i from turns),
        faults as (
            select *, left(role, 1) as initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final,
                   row_number() over (partition by conv_id, role, text order by i) > 1 as again,
                   left(lag(role) over (partition by conv_id order by i), 1) as before from placed),
        marked as (
            select *, case when final = '' then 'blank' when again then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end as fault from faults),
        layers as (
            select distinct conv_id, 0::bigint as i, q as state, c as cost, e as edits from marked, (values (0, 0, ''), (2, 2, 'I'), (3, 4, 'II')) s(q, c, e)
            union all
            select * from (
                select l.conv_id, l.i + 1 as i, v.q as state, (l.cost + m.cost + 2 * v.k) as cost, l.edits || m.edit || repeat('I', v.k) as edits
                from layers l join marked r on r.conv_id is not distinct from l.conv_id and r.i = l.i + 1,
                     lateral (select 'D' as edit, l.state as q, 3 as cost
                              union all select 'R', case when l.state = 2 then 3 else 2 end, 2 + (r.fault = 'truncated')::int where r.fault not in ('blank', 'duplicate')
                              union all select 'K', case r.initial when 's' then 1 when 'u' then 2 else 3 end, (r.fault = 'truncated')::int
                              where r.fault not in ('blank', 'duplicate')
                                and (r.initial = 's' and l.state = 0 or r.initial = 'u' and l.state <> 2 or r.initial = 'a' and l.state = 2)) m,
                     lateral (select m.q, 0 as k union all select case when m.q = 2 then 3 else 2 end, 1 union all select case when m.q = 2 then 2 else 3 end, 2) v(q, k)
            ) qualify row_number() over (partition by conv_id, state order by cost, edits) = 1),
        sums as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                   count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from marked group by conv_id),
        best as (
            select l.conv_id, l.cost, l.edits from layers l join sums s on s.conv_id is not distinct from l.conv_id and s.n = l.i
            where l.state in (0, 3) qualify row_number() over (partition by l.conv_id order by l.cost, l.edits) = 1),
        letters as (select conv_id, edits, unnest(range(1, length(edits) + 1)) as j from best),
        steps as (
            select conv_id, j, edits[j] as edit, length(replace(left(edits, j), 'I', '')) as i, length(replace(left(edits, j), 'D', '')) as place from letters),
        emitted as (
            select s.*, r.role, r.text, (max(case when s.place = 1 and s.edit = 'K' and r.initial = 's' then 1 else 0 end) over (partition by s.conv_id)) as system
            from steps s left join marked r on r.conv_id is not distinct from s.conv_id and r.i = s.i and s.edit <> 'I' where s.edit <> 'D'),
        lines as (
            select conv_id, string_agg(case when edit = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) as body
            from emitted group by conv_id)
        select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(edits, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
        from (select distinct conv_id from conversations) c
             left join sums s on s.conv_id is not distinct from c.conv_id left join best b on b.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
    """,
}
