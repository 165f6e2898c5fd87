"""DuckDB SQL of the reference queries, written from the operators' definitions."""

from __future__ import annotations

from tarnwood.functions.text import ACCENTS, AUTHOR_SEPARATOR, NO_AUTHOR, NO_CODE, NO_VALUE, QUERY_TOKEN, STOPWORDS
from tarnwood.operators import evaluate, ingest, points, tree


def _in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({c}, ''), '{QUERY_TOKEN}'), lambda t: lower(t) not in {_in(STOPWORDS)} and (length(t) >= 2 or regexp_matches(t, '^[0-9]$')))"


def _terms(c: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+')"


PAPERS = """p as (select * exclude (rn) from (select *, row_number() over (partition by file order by ingested_at desc nulls last, cited desc nulls last) as rn from papers) where rn = 1),
own as (select * from p where category = 'film_motor')"""
QUERY = "q as (select d.doc_id as query_id, d.title as query, e.embedding as vector from documents d left join embeddings e on e.vec_id = d.doc_id where d.doc_id % 100 = 0 and d.title is not null)"
SCOPE = "scope as (select rowid from chunks where file in (select file from own))"
#: Needs q; gives bm(query_id, rowid, score, met).
BM25 = f"""qt as (select query_id, t as phrase, count(*) as times from (select query_id, unnest({_tokens('query')}) as t from q) group by all),
ph as (select phrase, {_terms('phrase')} as ts from (select distinct phrase from qt)),
part as (select phrase, len(ts) as m, unnest(ts) as term, generate_subscripts(ts, 1) - 1 as k from ph where len(ts) > 0),
doc as (select rowid, {_terms('text')} as a, {_terms('title')} as b from chunks),
size as (select count(*)::double as n_docs, avg(len(a) + len(b)) as avgdl from doc),
occ as (select rowid, len(a) + len(b) as dl, unnest(a) as term, generate_subscripts(a, 1) as pos from doc
        union all select rowid, len(a) + len(b), unnest(b), generate_subscripts(b, 1) + 10000000 from doc),
side as (select phrase, rowid, dl, pos - k as pos0 from part join occ using (term) group by phrase, rowid, dl, m, pos - k having count(*) = m),
tf as (select phrase, rowid, dl, count(*) as f from side group by all),
df as (select phrase, count(*) as n from tf group by all),
bm as (select query_id, rowid, round(sum(times * greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score, count(*) as met
       from qt join tf using (phrase) join df using (phrase) cross join size group by query_id, rowid)"""
#: Needs q, scope and bm; gives kw and vec (query_id, rowid, score, rank).
ROUTES = """kw as (select * from (select query_id, rowid, score, row_number() over (partition by query_id order by score desc, rowid) as rank from bm where rowid in (select rowid from scope)) where rank <= 30),
vec as (select * from (select query_id, rowid, score, row_number() over (partition by query_id order by score desc, rowid) as rank from (
        select query_id, vec_id as rowid, round(list_inner_product(q.vector::double[], e.embedding::double[]), 6) as score from q cross join embeddings e
        where q.vector is not null and e.vec_id in (select rowid from scope))) where rank <= 30)"""
FUSED = """fu as (select query_id, rowid, round(sum(1.0::double / (60 + rank)), 9) as score, min(case when route = 'keyword' then rank end) as kw_rank, min(case when route = 'vector' then rank end) as vec_rank
       from (select query_id, rowid, rank, 'keyword' as route from kw union all select query_id, rowid, rank, 'vector' from vec) group by query_id, rowid),
fused as (select *, row_number() over (partition by query_id order by score desc, kw_rank nulls last, vec_rank nulls last, rowid) as place from fu)"""
ALL = f"with {PAPERS}, {QUERY}, {SCOPE}, {BM25}, {ROUTES}, {FUSED}"
GOLD = "gold as (select distinct query_id, file from q join p on regexp_extract(lower(q.query), '^\\S+ \\S+') = regexp_extract(lower(p.title), '^\\S+ \\S+') where p.title is not null and regexp_extract(lower(q.query), '^\\S+ \\S+') <> ''), size_g as (select query_id, count(*) as g from gold group by 1)"


def _measures(runs: str, by: str) -> str:
    """CTEs from ``runs`` (query_id, by…, rowid, place) to m (query_id, by…, recall, mrr, ndcg)."""
    b = f", {by}" if by else ""
    return f"""firsts as (select query_id{b}, file, min(place) as p0 from {runs} join chunks using (rowid) group by query_id{b}, file),
    ranked as (select query_id{b}, file, row_number() over (partition by query_id{b} order by p0) as rank from firsts),
    asked as (select query_id{b}, g from size_g {f"cross join (select distinct {by} from ranked)" if by else ""}),
    hit as (select query_id{b}, count(*) as hits, min(rank) as f, sum(1 / log2(rank + 1.0)) as dcg from ranked join gold using (query_id, file) where rank <= 8 group by query_id{b}),
    m as (select query_id{b}, round(coalesce(hits / g, 0.0), 6) as recall, round(coalesce(1.0 / f, 0.0), 6) as mrr,
          round(coalesce(dcg / list_sum(list_transform(range(1, least(g, 8)::bigint + 1), lambda i: 1 / log2(i + 1.0))), 0.0), 6) as ndcg from asked left join hit using (query_id{b}))"""


_PIECE = f"list_filter(regexp_split_to_array(coalesce(authors, ''), '{AUTHOR_SEPARATOR}'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')"
_ONE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_STRIP = lambda c: f"regexp_replace({c}, '^[.,;]+|[.,;]+$', '', 'g')"
AUTHORS = f"""piece as (select file, year, coalesce(cited, 0) as cited, category, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as i from (select *, {_PIECE} as ps from own)),
clean as (select *, {_STRIP(_ONE(_STRIP(_ONE('piece'))))} as s from piece),
named as (select *, trim(regexp_extract(s, '(\\S+)$', 1)) as last, trim(regexp_replace(s, '\\s*\\S+$', '')) as first from clean
          where length(s) >= 3 and not regexp_matches(s, '{NO_AUTHOR}') and contains(s, ' ')),
au as (select file, i, year, cited, category, lower(last) || '|' || lower(substr(first, 1, 1)) as key, trim(first || ' ' || last) as name from named where length(last) >= 2),
longest as (select key, name from (select key, name, row_number() over (partition by key order by length(name) desc, min(row(file, i))) as r from au group by key, name) where r = 1),
cat as (select key, category from (select key, category, row_number() over (partition by key order by count(*) desc, min(row(file, i))) as r from au where category <> '' group by key, category) where r = 1),
base as (select key, count(*) as papers, sum(cited)::bigint as cited, count(*) filter (i = 0) as first_author, min(year)::varchar || '–' || max(year)::varchar as span from au group by key)"""
_INST = f"regexp_replace(regexp_replace(regexp_replace({_ONE(chr(99) + 'oalesce(institution, ' + chr(39) * 2 + ')')}, '\\s*[,，(（].*$', ''), '(?i)^(the|dept\\.?|department of)\\s+', ''), '^[ .,]+|[ .,]+$', '', 'g')"
INSTITUTIONS = f"""ins as (select *, {_INST} as name from paper_geo),
inst as (select lower(name) as key, min_by(name, file) as name, first(iso3 order by file) as iso3, count(*) as papers, sum(coalesce(cited, 0))::bigint as cited
         from ins join own using (file) where lower(name) not in {_in(NO_VALUE)} and length(name) >= 4 group by lower(name))"""
_CODE = f"case when regexp_matches(upper(trim(iso3)), '^[A-Z]{{3}}$') and upper(trim(iso3)) not in {_in(NO_CODE)} then case when upper(trim(iso3)) in ('TWN', 'HKG', 'MAC') then 'CHN' else upper(trim(iso3)) end end"


def _countries(papers: str) -> str:
    return f"""geo as (select file, country, upper(trim(iso3)) as raw, {_CODE} as code from paper_geo),
co as (select code as iso3, min_by(case when raw in ('TWN', 'HKG', 'MAC') then 'China' else coalesce(country, code) end, file) as country, count(*) as papers, sum(coalesce(cited, 0))::bigint as cited
       from geo join {papers} using (file) where code is not null group by code)"""


_UNITS = ", ".join(f"('{m}', '{u}', {f!r}::double)" for m, fam in points.FAMILY.items() for u, f in points.FACTORS[fam].items())
POINTS = f"""unit(metric, unit_key, factor) as (values {_UNITS}),
pt as (select b.*, replace(translate(lower(trim(coalesce(unit, ''))), ' ^', ''), '²', '2') as unit_key from benchmark b where file in (select file from own)),
cv as (select pt.*, case when value * factor > 0 and not (pt.metric = 'efficiency' and value * factor > 100) then value * factor end as v from pt left join unit using (metric, unit_key)),
shown as (select * from cv where metric in {_in(points.SHOWN)}),
dd as (select * from (select *, row_number() over (partition by file, metric, round(v, 6), voltage_kv, gap_um order by id) as rn from shown where v is not null) where rn = 1)"""
_MARK = " Authorized licensed use limited to: City Library. Downloaded on May 4 from IEEE Xplore. Restrictions apply. "
_SQUEEZE = lambda c: f"regexp_replace(regexp_replace({c}, '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_PAGE = "case when page is not null then coalesce(try_cast(regexp_extract(page, '^\\s*([+-]?[0-9]{1,9})', 1) as int), 0) end"
_LEAVES = ", ".join(f"('{a}', {o}, {lv}, '{lb}', '{q}')" for a, _, o, lv, lb, q in tree.parsed() if q)
_NODES = ", ".join(f"('{a}', {'null' if p is None else repr(p)}, {o}, '{lb}', {'null' if q is None else repr(q)})" for a, p, o, lv, lb, q in tree.parsed())
_SWEEP = ", ".join(f"({i}, {a!r}::double, {b!r}::double)" for i, (a, b) in enumerate(evaluate.SWEEP))
_PREVIEW = """case when body = '' then '' else (case when start > 0 then '…' else '' end) || (case when tok is null then seg else regexp_replace(seg, '(?i)(' || regexp_replace(tok, '([.\\\\\\-])', '\\\\\\1', 'g') || ')', '【\\1】', 'g') end)
   || (case when start + 340 < length(body) then '…' else '' end) end"""

_STRIP_ALL = lambda c: f"regexp_replace({c}, '^[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"
#: CTE clean(id, t) from a table source(id, text): text without publisher noise.
_CLEAN = """noisy as (select id, regexp_replace(coalesce(text, ''), 'Authorized licensed use limited to:.{0,120}?Restrictions apply\\.', ' ', 'gis') as t from source),
        less as (select id, regexp_replace(regexp_replace(t, 'Downloaded on .{0,60}?from IEEE Xplore\\.', ' ', 'gi'), 'This article has been accepted for publication.{0,160}?content may change', ' ', 'gis') as t from noisy),
        clean as (select id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as t from less)"""
#: CTE chunk(id, chunk_no, chunk) from clean: stretches by recursion over what is left of a paragraph, chunks by recursion over stretches.
_CHUNKS = f"""par as (select id, i, p from (select id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select id, list_transform(regexp_split_to_array(t, '\\n[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]*\\n'), lambda x: {_STRIP_ALL('x')}) as ps from clean where length(t) > 1680)) where p <> ''),
        cuts as (select id, i, 0 as k, '' as part, p as rest, false as alone from par
            union all select id, i, k + 1, case when length(rest) > 1920 then substr(rest, 1, at0) else rest end, case when length(rest) > 1920 then substr(rest, at0 + 1) else '' end, length(rest) > 1920
            from (select *, case when strpos(reverse(substr(rest, 1, 1200)), ' .') between 1 and 600 then 1201 - strpos(reverse(substr(rest, 1, 1200)), ' .') else 1200 end as at0 from cuts where rest <> '')),
        parts as (select id, part, alone, length(part) as size, row_number() over (partition by id order by i, k) as seq from cuts where k > 0),
        fold as (select id, seq, case when alone then 0 else size end as held, 1 as grp from parts where seq = 1
            union all select p.id, p.seq, case when alone then 0 when held > 0 and held + size + 2 <= 1200 then held + 2 + size else size end, grp + case when not alone and held > 0 and held + size + 2 <= 1200 then 0 else 1 end
            from fold f join parts p on p.id = f.id and p.seq = f.seq + 1),
        packed as (select id, grp, {_STRIP_ALL("string_agg(part, chr(10) || chr(10) order by seq)")} as c from parts join fold using (id, seq) group by id, grp),
        tailed as (select *, sum(case when length(c) >= 200 or grp = 1 then 1 else 0 end) over (partition by id order by grp) as g from packed),
        merged as (select id, g, {_STRIP_ALL("string_agg(c, chr(10) || chr(10) order by grp)")} as c from tailed group by id, g),
        chunk as (select id, row_number() over (partition by id order by g) as chunk_no, c as chunk from merged where length(c) >= 100 union all select id, 1, t from clean where length(t) between 200 and 1680)"""

SQL: dict[str, str] = {
    "chunk_documents": f"with recursive source as (select doc_id as id, text from documents), {_CLEAN}, {_CHUNKS} select id as doc_id, chunk_no, chunk from chunk",
    "tokenize_counts": f"select doc_id, len(t) as tokens, len(list_distinct(t)) as different from (select doc_id, {_tokens('text')} as t from documents)",
    "match_expressions": f"select doc_id, case when len(t) > 0 then array_to_string(list_transform(t, lambda x: '\"' || x || '\"'), ' OR ') end as expression from (select doc_id, {_tokens('title')} as t from documents)",
    "keyword_index": f"""with d as (select rowid, list_concat({_terms('text')}, {_terms('title')}) as ts from chunks), o as (select rowid, unnest(ts) as term from d)
        select term, count(*) as times, count(distinct rowid) as segments from o group by term""",
    "bm25_topk": f"{ALL} select query_id, rowid, score, rank from kw",
    "bm25_all_words": f"""with {PAPERS}, {QUERY}, {BM25}, full_q as (select query_id, count(*) as a from qt group by 1)
        select query_id, rowid, score, rank from (select *, row_number() over (partition by query_id order by score desc, rowid) as rank from bm join full_q using (query_id) where met = a) where rank <= 8""",
    "vector_topk": """select query_id, rowid, score, rank from (select *, row_number() over (partition by query_id order by score desc, rowid) as rank from (
        select a.vec_id as query_id, b.vec_id as rowid, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a cross join embeddings b where a.vec_id % 100 = 0)) where rank <= 10""",
    "rrf_fusion": f"{ALL} select query_id, rowid, round(score, 6) as score, kw_rank, vec_rank, place from fused",
    "hybrid_search": f"""{ALL} select query_id, rowid, round(score, 6) as score, kw_rank, vec_rank, final_rank from (
        select *, row_number() over (partition by query_id order by place) as final_rank from fused where place <= 40) where final_rank <= 8""",
    "scoped_tiered_search": f"""{ALL.replace("category = 'film_motor')", "category = 'film_motor' and contains(tier, '①'))")} select query_id, rowid, round(score, 6) as score, kw_rank, vec_rank, final_rank from (
        select f.*, row_number() over (partition by query_id order by place) as final_rank from fused f join chunks using (rowid) join own using (file)
        where place <= 40 and coalesce(nullif(own.year, 0), 0) >= 1995 and coalesce(nullif(own.year, 0), 9999) <= 2020) where final_rank <= 8""",
    "preview_highlight": f"""with t as (select rowid, coalesce(text, '') as body, ({_tokens('title')})[1] as tok from chunks),
        u as (select *, greatest(0, coalesce(nullif(strpos(lower(body), lower(tok)), 0) - 1, 0) - 113) as start from t),
        v as (select *, trim(replace(substr(body, start + 1, 340), chr(10), ' ')) as seg from u)
        select rowid, {_PREVIEW} as preview from v""",
    "build_context": f"""with {PAPERS}, {QUERY}, {SCOPE}, {BM25}, k as (select * from (select query_id, rowid, row_number() over (partition by query_id order by score desc, rowid) as n from bm where rowid in (select rowid from scope)) where n <= 8)
        select query_id, string_agg('[' || n || '] ' || coalesce(nullif(c.title, ''), '(untitled)') || ' | ' || coalesce(split_part(p.authors, ',', 1), '') || ' et al. | ' || coalesce(p.year::varchar, '?') || ' | ' || coalesce(nullif(p.venue, ''), '?') || ' | ' || coalesce(nullif(p.tier, ''), '?')
        || ' | DOI ' || coalesce(nullif(p.doi, ''), '—') || ' | p. ' || coalesce(nullif(c.page, ''), 'not verified') || chr(10) || trim(coalesce(c.text, '')), chr(10) || chr(10) order by n) as context from k join chunks c using (rowid) join p on p.file = c.file group by query_id""",
    "map_labels": f"""with recursive {PAPERS}, {_countries('own')}, b as (select *, row_number() over (order by papers desc, iso3) as r from (select iso3, papers, ascii(iso2) * 10.0::double as x, ascii(substr(iso2, 2, 1)) * 7.0::double as y from co join country_ref using (iso3))),
        g as (select r, [{{'x': x, 'y': y}}] as placed, true as put, iso3, papers, x, y from b where r = 1
            union all select b.r, case when ok then list_append(placed, {{'x': b.x, 'y': b.y}}) else placed end, ok, b.iso3, b.papers, b.x, b.y
            from (select g.r + 1 as r, placed, len(list_filter(placed, lambda q: abs(q.x - n.x) < 200 and abs(q.y - n.y) < 120)) = 0 as ok from g join b n on n.r = g.r + 1 where g.r < 6) s join b on b.r = s.r)
        select iso3, papers, x, y from g where put""",
    "paper_segments": f"""with {PAPERS} select own.file, own.title, row_number() over (partition by own.file order by {_PAGE} nulls first, rowid) as place, rowid, page from own join chunks c using (file)""",
    "corpus_stats": f"""with {PAPERS} select (select count(*) from own) as papers, (select min(year) from own where year > 1900) as year_min, (select max(year) from own where year > 1900) as year_max,
        (select count(*) from chunks where file in (select file from own)) as chunks, (select count(*) from chunks where file in (select file from own) and rowid in (select vec_id from embeddings)) as vectors,
        case when (select count(*) from chunks where file in (select file from own) and rowid in (select vec_id from embeddings)) > 0 then 'hybrid' else 'keyword-only' end as mode""",
    "tier_histogram": f"with {PAPERS} select coalesce(nullif(tier, ''), 'unclassified') as tier, n from (select tier, count(*) as n from own group by tier)",
    "category_rollup": f"""with {PAPERS}, named(category) as (values ('film_motor'), ('electroadhesion'), ('cross'), ('not_used')),
        c as (select file, count(*) as c from chunks group by file), g as (select category, count(*) as papers, sum(coalesce(cross_topic, 0))::bigint as cross_papers, sum(coalesce(c, 0))::bigint as chunks from p left join c using (file) group by category)
        select category, coalesce(papers, 0) as papers, coalesce(cross_papers, 0) as cross_papers, coalesce(chunks, 0) as chunks from named left join g using (category)""",
    "timeline": f"with {PAPERS} select year, count(*) as total, count(*) filter (category = 'film_motor') as in_scope from p where year > 1900 and year < 2100 group by year",
    "author_stats": f"with {PAPERS}, {AUTHORS} select key, name, papers, cited, first_author, span, category from base join longest using (key) left join cat using (key)",
    "top_authors": f"""with {PAPERS}, {AUTHORS} select row_number() over (order by papers desc, cited desc, key) as rank, key, name, papers, cited from base join longest using (key) order by rank limit 20""",
    "institution_stats": f"with {PAPERS}, {INSTITUTIONS} select key, name, iso3, papers, cited from inst",
    "country_stats": f"with {PAPERS}, {_countries('own')} select iso3, country, papers, cited from co",
    "overview_totals": f"""with {PAPERS}, {AUTHORS}, {INSTITUTIONS}, {_countries('own')} select (select count(*) from own) as papers, (select sum(coalesce(cited, 0))::bigint from own) as cited,
        (select count(*) from paper_geo where file in (select file from own) and coalesce(iso3, '') <> '') as geo_coverage, (select count(*) from base) as authors, (select count(*) from inst) as institutions, (select count(*) from co) as countries""",
    "top_cited": f"""with {PAPERS} select row_number() over (order by cited desc, file) as rank, file, title, split_part(authors, ',', 1) as first_author, cited from own where cited <> 0 order by rank limit 15""",
    "unit_normalise": f"with {PAPERS}, {POINTS} select id, round(v, 6) as v from cv",
    "metric_stats": f"""with {PAPERS}, {POINTS} select metric, count(*) as n, min(round(v, 4)) as lowest, max(round(v, 4)) as highest, percentile_disc(0.5) within group (order by round(v, 4) desc) as median from dd group by metric""",
    "point_counters": f"with {PAPERS}, {POINTS} select (select count(*) from dd) as points, count(*) filter (v is null) as dropped, count(v) - (select count(*) from dd) as deduped from shown",
    "title_like": f"""with {PAPERS} select row_number() over (order by cited desc nulls last, file) as rank, file, title, cited from p where title ilike '%film motor%' or authors ilike '%film motor%' order by rank limit 20""",
    "watermark_strip": f"""with m as (select rowid, case when rowid % 3 = 0 then text || '{_MARK}' when rowid % 3 = 1 then '{_MARK}x' else text end as text from chunks),
        st as (select *, regexp_replace(coalesce(text, ''), 'Authorized licensed use limited to:.{{0,120}}?Downloaded on .{{0,80}}?from IEEE Xplore\\.\\s*Restrictions apply\\.', ' ', 'gis') as a from m where contains(text, 'Authorized licensed use')),
        lo as (select *, {_SQUEEZE("case when contains(a, 'Authorized licensed use') then regexp_replace(a, '(?i)Authorized licensed use limited to:[^' || chr(10) || ']*(?:' || chr(10) || '|$)', ' ', 'g') else a end")} as b from st)
        select rowid, case when length(b) < 120 or length(b) < length(text) * (1 - 0.9) then 'drop' else 'edit' end as decision, b as text from lo""",
    "noise_clean": f"""with a as (select rowid, regexp_replace(coalesce(text || '{_MARK}', ''), 'Authorized licensed use limited to:.{{0,120}}?Restrictions apply\\.', ' ', 'gis') as t from chunks),
        b as (select rowid, regexp_replace(regexp_replace(t, 'Downloaded on .{{0,60}}?from IEEE Xplore\\.', ' ', 'gi'), 'This article has been accepted for publication.{{0,160}}?content may change', ' ', 'gis') as t from a)
        select rowid, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from b""",
    "catalog_merge": f"""with {PAPERS}, f as (select file, nullif(case when trim(title) <> '' then title end, '') as t, authors, venue, year, cited, abstract from p)
        select case when file like '%.pdf' then file else file || '.pdf' end as file, substr(coalesce(t, replace(regexp_replace(file, '\\.pdf$', ''), '_', ' ')), 1, 400) as title,
        substr(case when trim(authors) <> '' then authors end, 1, 600) as authors, substr(case when trim(venue) <> '' then venue end, 1, 200) as venue,
        coalesce(try_cast(substr(year::varchar, 1, 4) as int), try_cast(nullif(regexp_extract(file, '^([0-9]{{4}})', 1), '') as int)) as year, cited, substr(case when trim(abstract) <> '' then abstract end, 1, 4000) as abstract from f""",
    "three_vote_classify": f"""with {PAPERS}, v as (select file, tier, case when cross_topic = 1 then 'CROSS' when category = 'film_motor' then 'film_motor' when category = 'electroadhesion' then 'electroadhesion' end as f,
        case when category in ('film_motor', 'electroadhesion') then category when category = 'cross' then 'CROSS' end as d, case when tier like '③%' then 'electroadhesion' when tier like '①%' or tier like '②%' then 'film_motor' end as t from p),
        w as (select *, list_filter([f, d, t], lambda x: x is not null) as votes from v), c as (select *, list_distinct(list_filter(votes, lambda x: x <> 'CROSS')) as clean from w)
        select file, case when len(clean) = 1 then clean[1] when tier like '③%' then 'electroadhesion' else 'film_motor' end as category, (len(clean) <> 1 or list_contains(votes, 'CROSS')) as "cross",
        case when len(clean) = 1 then 'metadata' else 'tier' end as "by", array_to_string(list_filter(['folder=' || f, 'direction=' || d, 'tier=' || t], lambda x: x is not null), ';') as basis from c""",
    "pending_ingest": "select distinct file from papers where file not in (select file from chunks) or index_status = 'pending'",
    "upsert_latest": """select file, cited, ingested_at from (select file, cited, ingested_at, row_number() over (partition by file order by ingested_at desc nulls last, (cited is not null) desc) as rn from papers) where rn = 1""",
    "replace_and_update": f"""with {PAPERS} select file, case when category is null then 'unsorted' when cross_topic = 1 then 'cross' else category end as category, cross_topic from p""",
    "vector_reuse": "select rowid, rowid in (select vec_id from embeddings where len(list_filter(embedding, lambda x: x <> 0)) > 0) as reused from chunks",
    "vector_norms": """with v as (select vec_id, list_transform(embedding, lambda x: (x * 3::float)::double) as w from embeddings), n as (select vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12)) as u from v)
        select vec_id as rowid, round(list_inner_product(u, u), 6) as square, round(u[1], 4) as first from n""",
    "embed_inputs": """with i as (select rowid, substr(case when coalesce(title, '') <> '' then substr(title, 1, 200) || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') else regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') end, 1, 6000) as t from chunks)
        select rowid, length(t) as chars, md5(t) as digest from i""",
    "embedding_cost": """with i as (select substr(case when coalesce(title, '') <> '' then substr(title, 1, 200) || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') else regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') end, 1, 6000) as t from chunks)
        select count(*) as chunks, sum(length(t))::bigint as chars, round(sum(length(t)) / 4 / 1000 * 0.0005, 6) as cost from i""",
    "first_chunk": f"select file, rowid, substr(text, 1, 1500) as head from (select *, row_number() over (partition by file order by {_PAGE} nulls first, rowid) as rn from chunks) where rn = 1",
    "candidate_segments": f"""with {PAPERS}, c as (select *, len(regexp_extract_all(text, '{ingest.HINT}')) as hints from chunks where ({" or ".join(f"text ilike '%{h}%'" for h in ingest.HINTS)}) and file in (select file from own))
        select file, rowid, hints, place from (select *, row_number() over (partition by file order by hints desc, {_PAGE} nulls first, rowid) as place from c where hints > 0) where place <= 3""",
    "json_extract_rows": "select event_id, case when event_id % 2 = 0 then 2 else 1 end as n, (case when event_id % 2 = 0 then 2 else 1 end * (props->>'k')::bigint)::bigint as total from events",
    "extraction_fields": f"""select file, {", ".join(f"case when lower(trim({c})) not in {_in(NO_VALUE)} then trim({c}) end as {c}" for c in ("institution", "country"))}, {_CODE} as iso3, case when lower(trim(city)) not in {_in(NO_VALUE)} then trim(city) end as city from paper_geo""",
    "extraction_summary": "select count(*) as n, count(value) as with_value, count(distinct file) as files, count(distinct metric) as metrics from benchmark",
    "retrieval_metrics": f"{ALL}, {GOLD}, runs as (select query_id, rowid, place from fused where place <= 32), {_measures('runs', '')} select * from m",
    "mode_compare": f"""{ALL}, {GOLD}, runs as (select 'keyword' as mode, query_id, rowid, rank as place from kw union all select 'vector', query_id, rowid, rank from vec union all select 'hybrid', query_id, rowid, place from fused where place <= 32), {_measures('runs', 'mode')}
        select mode, count(*) as questions, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by mode""",
    "hybrid_gain": f"""{ALL}, {GOLD}, runs as (select 'keyword' as mode, query_id, rowid, rank as place from kw union all select 'vector', query_id, rowid, rank from vec union all select 'hybrid', query_id, rowid, place from fused where place <= 32), {_measures('runs', 'mode')},
        g as (select mode, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by mode)
        select {", ".join(f"round(max({c}) filter (mode = 'hybrid') - max({c}) filter (mode <> 'hybrid'), 6) as {c}_gain" for c in ("recall", "mrr", "ndcg"))} from g""",
    "weight_sweep": f"""{ALL}, {GOLD}, w(run, wk, wv) as (values {_SWEEP}),
        g as (select run, query_id, rowid, round(sum(case when route = 'keyword' then wk else wv end / (60 + rank)), 9) as score, min(case when route = 'keyword' then rank end) as kr, min(case when route = 'vector' then rank end) as vr
              from (select query_id, rowid, rank, 'keyword' as route from kw union all select query_id, rowid, rank, 'vector' from vec) cross join w group by run, query_id, rowid),
        runs as (select * from (select run, query_id, rowid, row_number() over (partition by run, query_id order by score desc, kr nulls last, vr nulls last, rowid) as place from g) where place <= 32), {_measures('runs', 'run')},
        a as (select run, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by run)
        select run, recall, mrr, ndcg, run = first_value(run) over (order by ndcg desc, run) as best from a""",
    "eval_nomination": f"""with {PAPERS}, {QUERY}, {BM25}, {GOLD}, k as (select * from (select query_id, rowid, row_number() over (partition by query_id order by score desc, rowid) as rank from bm) where rank <= 40),
        f as (select query_id, file, min(rank) as p0 from k join chunks using (rowid) group by query_id, file), r as (select query_id, file, row_number() over (partition by query_id order by p0) as rank from f)
        select query_id, file, rank, (query_id, file) in (select (query_id, file) from gold) as kept from r where rank <= 8""",
    "tree_outline": f"""with recursive t(id, parent, ord, label, q) as (values {_NODES}), w as (select id, label, q, lpad(ord::varchar, 6, '0') as path, 0 as depth from t where parent is null
        union all select t.id, t.label, t.q, w.path || '/' || lpad(t.ord::varchar, 6, '0'), depth + 1 from t join w on t.parent = w.id)
        select place, line from (select row_number() over (order by path) as place, depth, case when q is null then label else '  - ' || id || ': ' || label end as line from w) where depth > 0""",
    "tree_leaves": f"with l(id, ord, level, label, q) as (values {_LEAVES}), d as (select topic as id, count(*) as docs from documents group by 1) select id, level, label, coalesce(docs, 0) as docs from l left join d using (id)",
    "learn_overlap": f"""with {PAPERS}, l(id, ord, level, label, lq) as (values {_LEAVES}), q as (select doc_id as query_id, title as query from documents where doc_id % 100 = 0 and title is not null union all select -ord, lq from l), {SCOPE}, {BM25},
        k as (select * from (select query_id, rowid, row_number() over (partition by query_id order by score desc, rowid) as rank from bm where rowid in (select rowid from scope)) where rank <= 25),
        wt as (select query_id, file, 1.0::double / max(rank) as w from k join chunks using (rowid) where query_id >= 0 group by query_id, file),
        nf as (select distinct l.id, file from k join chunks c using (rowid) join l on -l.ord = k.query_id),
        sc as (select query_id, nf.id, sum(w) as s from wt join nf using (file) group by query_id, nf.id),
        e as (select query_id, l.id, level, ord, round(coalesce(s, 0.0), 9) as score from (select distinct query_id from wt) cross join l left join sc using (query_id, id)),
        t as (select * from (select *, row_number() over (partition by query_id order by score desc, ord) as r from e) where r <= 3)
        select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by level, r) as place from t""",
    "learn_papers": f"""with {PAPERS}, l(id, ord, level, label, lq) as (values {_LEAVES}), q as (select ord as query_id, lq || ' film motor' as query from l), {SCOPE}, {BM25},
        k as (select * from (select query_id, rowid, row_number() over (partition by query_id order by score desc, rowid) as rank from bm where rowid in (select rowid from scope)) where rank <= 12),
        f as (select query_id, file, min(rank) as p0 from k join chunks using (rowid) group by query_id, file)
        select query_id, file, rank from (select query_id, file, row_number() over (partition by query_id order by p0) as rank from f) where rank <= 3""",
    "map_bubbles": f"""with {PAPERS}, {_countries('own')}, b as (select iso3, papers, ascii(iso2) * 10.0::double as x, ascii(substr(iso2, 2, 1)) * 7.0::double as y from co join country_ref using (iso3))
        select iso3, papers, x, y, round(22 + 88 * sqrt(papers / max(papers) over ()), 4) as radius from b""",
    "map_unplaced": f"with {PAPERS}, {_countries('p')} select iso3, papers from co where iso3 not in (select iso3 from country_ref)",
    "event_windows": "select time_bucket(interval '1 hour', ts) as start, event_type as kind, count(*) as n from events group by all",
    "region_revenue": """select r_name, year(o_orderdate) as year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
}
