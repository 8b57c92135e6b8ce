"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

URL_FILTER = """
with cut as (
    select page_id, url, substr(url, instr(url, '://') + 3) as rest, coalesce(instr(url, '://') > 0, false) as ok from pages
), parts as (
    select page_id, ok,
        case when ok then translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when ok then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
            lambda p: p <> '' and not starts_with(p, 'utm_'))), '&') as parameters
    from cut
), keyed as (
    select *, case when ok then regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
        || case when parameters <> '' then '?' || parameters else '' end end as key
    from parts
), rules(verdict, rule_host, rule_path) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best as (
    select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
        arg_max(verdict, length(rule_host || rule_path)) as verdict
    from keyed join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    group by page_id
), listed as (
    select distinct key from keyed where regexp_matches(host, 'casino|bets|pills|ads-track') and key is not null
)
select page_id, host, path, rule,
    coalesce(best.verdict, case when listed.key is not null then 'block' else 'allow' end) as verdict,
    listed.key is not null as listed
from keyed left join best using (page_id) left join listed on keyed.key = listed.key
"""

CONTAINED = """
with words as (
    select 0 as kind, doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents
    union all
    select 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') from benchmark
), shingles as (
    select distinct kind, id, array_to_string(w[i:i + 4], ' ') as s
    from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i)
    where len(w) > 0
), sizes as (
    select id, count(*) as n_item from shingles where kind = 1 group by id
), shared as (
    select d.id as doc_id, i.id as item_id, count(*) as n_shared
    from shingles d join shingles i on d.s = i.s and d.kind = 0 and i.kind = 1
    group by 1, 2
)
select doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) as containment
from shared join sizes on id = item_id
where 10 * n_shared >= 8 * n_item
"""

#: The captures of ``queries.captures``; each header stands alone until the last step.
REVISITS = """
with page as (
    select page_id, url, md5(coalesce(html, '')) as d, regexp_extract(url, '^[^/]*://[^/?#]*') as site, 1767225600 + page_id * 60 as t
    from pages
), captured as (
    select page_id * 3 as capture_id, url, t as seconds, 'response' as kind, d, '"' || d[1:8] || '"' as etag, '60' as age from page
    union all
    select page_id * 3 + 1, url, t + 3600, 'revisit', d,
        case when d[1] < '4' then '"old"' when d[1] < '8' then 'W/"' || d[1:8] || '"' when d[1] < 'c' then '"' || d[1:8] || '"' end, '90'
    from page
    union all
    select page_id * 3 + 2, site || '/', t + 30, case when d[1] < '4' then 'response' else 'revisit' end, d, '"' || d[2] || '"', d[2] from page
), cut as (
    select *, substr(url, instr(url, '://') + 3) as rest, coalesce(instr(url, '://') > 0, false) as ok from captured
), parts as (
    select * exclude (rest, ok),
        case when ok then regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') end as place,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
            lambda p: p <> '' and not starts_with(p, 'utm_'))), '&') as parameters
    from cut
), keyed as (
    select *, place || case when parameters <> '' then '?' || parameters else '' end as key from parts
), matched as (
    select v.*, r.capture_id as response_id, r.d as r_d, r.etag as r_etag,
        row_number() over (partition by v.capture_id order by r.seconds desc, r.capture_id desc) as n
    from keyed v left join keyed r on r.kind = 'response' and r.key = v.key and r.seconds < v.seconds
    where v.kind = 'revisit'
), judged as (
    select *, case when response_id is null then 'no_response' when etag is null then 'unchecked'
        when regexp_replace(etag, '^[Ww]/', '') = regexp_replace(r_etag, '^[Ww]/', '') then 'resolved' else 'mismatch' end as status
    from matched where n = 1
)
select capture_id, url, status, response_id, case when status in ('resolved', 'unchecked') then r_d end as digest,
    case when status in ('resolved', 'unchecked') then 'cache-control: max-age=' || age || chr(10) || 'content-length: ' || r_d[1:2]
        || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || seconds || chr(10) || 'etag: ' || coalesce(etag, r_etag) end as headers
from judged
"""

#: Parameters as in ``mixing``: seed 11, share 0.8, three epochs.
MIXED = """
with docs as (
    select doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n_tokens,
        md5(coalesce(text, '')) as digest,
        case when source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') then 'web'
            when source in ('src10', 'src11', 'src12', 'src13', 'src14') then 'reference'
            when source in ('src15', 'src16', 'src17', 'src18', 'src19') then 'books' else 'other' end as domain
    from documents
), leaves as (
    select domain, lang, source, sum(n_tokens) as tokens from docs where n_tokens > 0 group by all
), d0 as (
    select domain, sum(tokens) * 3.0::double as capacity,
        case domain when 'web' then 0.5::double when 'reference' then 0.3::double when 'books' then 0.2::double else 1.0::double end as weight,
        (select sum(tokens) * 0.8::double from leaves) as budget
    from leaves group by domain
), r0 as (
    select *, capacity / weight as fill,
        (budget - coalesce(sum(capacity) over (order by capacity / weight, domain rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by capacity / weight, domain rows between current row and unbounded following) as rate
    from d0
), g0 as (
    select domain, least(capacity, coalesce(max(rate) filter (where rate <= fill) over () * weight, capacity)) as budget from r0
), d1 as (
    select l.domain, l.lang, sum(tokens) * 3.0::double as capacity,
        case l.lang when 'en' then 0.6::double when 'de' then 0.2::double when 'fr' then 0.1::double when 'es' then 0.1::double else 1.0::double end as weight,
        any_value(g0.budget) as budget
    from leaves l join g0 on l.domain = g0.domain group by l.domain, l.lang
), r1 as (
    select *, capacity / weight as fill,
        (budget - coalesce(sum(capacity) over (partition by domain order by capacity / weight, lang rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (partition by domain order by capacity / weight, lang rows between current row and unbounded following) as rate
    from d1
), g1 as (
    select domain, lang, least(capacity, coalesce(max(rate) filter (where rate <= fill) over (partition by domain) * weight, capacity)) as budget from r1
), d2 as (
    select l.domain, l.lang, l.source, tokens, tokens * 3.0::double as capacity,
        case l.source when 'src0' then 3.0::double else 1.0::double end as weight, g1.budget
    from leaves l join g1 on l.domain = g1.domain and l.lang is not distinct from g1.lang
), r2 as (
    select *, capacity / weight as fill,
        (budget - coalesce(sum(capacity) over (partition by domain, lang order by capacity / weight, source rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (partition by domain, lang order by capacity / weight, source rows between current row and unbounded following) as rate
    from d2
), g2 as (
    select domain, lang, source, tokens,
        floor(least(capacity, coalesce(max(rate) filter (where rate <= fill) over (partition by domain, lang) * weight, capacity)) + 1e-6)::bigint as budget
    from r2
), planned as (
    select d.*, budget // tokens as full_epochs, budget % tokens as rest
    from docs d join g2 g on d.domain = g.domain and d.lang is not distinct from g.lang and d.source is not distinct from g.source
    where n_tokens > 0
), ordered as (
    select *, md5('11|' || (full_epochs + 1)::varchar || '|' || coalesce(doc_id::varchar, '') || '|' || digest) as place from planned
), summed as (
    select *, sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row) as through
    from ordered
), counted as (
    select *, full_epochs + case when through <= rest then 1 else 0 end as times from summed
)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, unnest(range(1, times::bigint + 1))::integer as epoch from counted
"""

DIVERGENCE = """
with docs as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms,
        row_number() over () as row
    from documents
), occurrences as (
    select lang, source, row, unnest(terms) as term from docs
), vocabulary as (
    select lang, term from occurrences group by lang, term having count(distinct row) >= 30
), counts as (
    select lang, source, term, count(*)::hugeint as n from occurrences semi join vocabulary using (lang, term) group by all
), groups as (
    select g.lang, g.source, coalesce(n, 0) as total, coalesce(v, 0) as v
    from (select distinct lang, source from docs) g
    left join (select lang, source, sum(n) as n from counts group by all) using (lang, source)
    left join (select lang, count(*) as v from vocabulary group by all) using (lang)
), shares as (
    select g.lang, g.source, v.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * g.v) as p
    from groups g join vocabulary v on g.lang = v.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = v.term
), whole as (
    select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) as q
    from counts join (select lang, sum(total) as total, any_value(v) as v from groups group by lang) using (lang) group by lang, term
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join (
        select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
        from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
    ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
), tops as (
    select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value, rank::integer as rank from (
    select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
    from (select * from pairs union all select * from tops)
) where part = 'pair' or rank <= 50
"""

COLLOCATIONS = """
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
), words as (
    select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces
), totals as (
    select lang, sum(len(w)) as n from words group by lang
), grams as (
    select lang, 1 as size, unnest(w) as phrase from words
    union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
    union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words
    union all select lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) from words
), counted as (
    select lang, size, phrase, count(*) as f from grams group by all having count(*) >= 30
), candidates as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counted where size > 1
), halves as (
    select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
    from candidates join (values (1), (2), (3)) as t(k) on k < size
), cuts as (
    select h.*, x.f as l, y.f as r, (2000000::hugeint * a // (x.f + y.f))::bigint as score
    from halves h join counted x on x.lang = h.lang and x.phrase = h.first join counted y on y.lang = h.lang and y.phrase = h.rest
), scored as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), parts as (
    select lang, a, array_to_string(w[i:i + n - 1], ' ') as phrase
    from candidates join (values (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) as t(i, n) on n < size and i + n - 1 <= size
), inside as (
    select distinct s.lang, s.phrase from candidates s join parts l on l.lang = s.lang and l.phrase = s.phrase and 100 * l.a >= 80 * s.a
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
    from scored anti join inside using (lang, phrase)
)
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked join totals using (lang) where rank <= 2000
"""

SQL = {
    "op5_benchmark_decontamination": CONTAINED,
    "op6_url_filter": URL_FILTER,
    "op7_revisit_resolution": REVISITS,
    "op8_source_mixing": MIXED,
    "op11_source_divergence": DIVERGENCE,
    "op12_phrase_collocations": COLLOCATIONS,
}
