"""DuckDB SQL for every checked query (tables are pre-registered views).

Each text restates the adapter and the operator semantics in plain SQL,
independently of the Spark code, so a match checks both.
"""

from __future__ import annotations

from taxalake.operators.merge import CACHE_COLUMNS

EXT = (
    "concat(case ({k}) % 5 when 0 then 'NCBI' when 1 then 'GBIF' when 2 then 'WORMS' "
    "when 3 then 'IF' else 'ITIS' end, ':', cast({k} as varchar))"
)


def ext(k: str) -> str:
    return EXT.format(k=k)


SCHEMES = "('NCBI', 'IF', 'GBIF', 'WORMS')"

LINKS = f"""
links as (
  select {ext('l_partkey')} as ext, concat('OTT:', cast(l_suppkey % 10 as varchar)) as term from lineitem
  union all
  select {ext('l_partkey + 1')}, concat('OTT:', cast(l_suppkey % 10 as varchar)) from lineitem where l_returnflag = 'R'
  union all
  select {ext('p_partkey * 2')}, concat('WD:Q', cast(p_size as varchar)) from part
  union all
  select {ext('o_custkey * 3')},
         concat('GLOBI:', case when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM' then 'null' else o_orderstatus end,
                '@', o_orderpriority)
  from orders where not (o_orderstatus = 'P' and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW'))
),
wl as (
  select ext, term, split_part(ext, ':', 1) as scheme, split_part(term, ':', 1) as source
  from links where split_part(ext, ':', 1) in {SCHEMES}
),
prof as (
  select ext, any_value(scheme) as scheme, count(*) as n_links, count(distinct source) as n_sources,
         bool_or(source = 'OTT') as has_ott, bool_or(source = 'WD') as has_wd, bool_or(source = 'GLOBI') as has_globi
  from wl group by ext
)"""

COMPOSITES = f"""{LINKS},
others as (
  select ext, list(term) as others from wl where not starts_with(term, 'GLOBI') group by ext
),
g as (
  select ext, term as g, count(*) as n_links from wl where starts_with(term, 'GLOBI') group by ext, term
),
comps as (
  select g.ext, array_to_string(list_sort(list_append(coalesce(o.others, []::varchar[]), g.g)), '|') as composite,
         g.n_links
  from g left join others o on g.ext = o.ext
),
members as (select distinct composite, ext from comps),
stats as (
  select composite, count(*) as n_ids, count(*) - count(distinct split_part(ext, ':', 1)) as repeats,
         len(string_split(composite, '|')) as key_length
  from members group by composite
)"""

REGION = (
    "concat_ws('+', case when has_globi then 'GLOBI' end, case when has_ott then 'OTT' end, "
    "case when has_wd then 'WD' end, case when n_sources > (has_globi::int + has_ott::int + has_wd::int) then 'OTHER' end)"
)

ORACLES: dict[str, str] = {
    "link_union": f"with {LINKS} select ext, term from links",
    "split_source_ids": f"""
select {ext('l_partkey')} as ext, concat('OTT:', cast(l_suppkey % 10 as varchar)) as term from lineitem
union all
select {ext('l_partkey + 1')}, concat('OTT:', cast(l_suppkey % 10 as varchar)) from lineitem where l_returnflag = 'R'
""",
    "links_by_source_scheme": f"""with {LINKS}
select source, scheme, count(*)::bigint as n_links from wl group by source, scheme""",
    "link_groups": f"""with {LINKS}
select ext, scheme, n_links::bigint as n_links, n_sources::bigint as n_sources, has_ott, has_wd, has_globi from prof""",
    "ids_by_scheme": f"with {LINKS} select scheme, count(*)::bigint as n_ids from prof group by scheme",
    "coverage_report": f"""with {LINKS}
select count(*)::bigint as total_ids,
  count(*) filter (where n_sources = 3)::bigint as all_three,
  count(*) filter (where n_sources - has_globi::int = 2)::bigint as ott_and_wd,
  count(*) filter (where has_ott)::bigint as has_ott,
  count(*) filter (where has_wd)::bigint as has_wd,
  count(*) filter (where has_globi)::bigint as has_globi,
  count(*) filter (where n_sources = 1 and has_globi)::bigint as only_globi,
  count(*) filter (where n_sources = 1 and has_ott)::bigint as only_ott,
  count(*) filter (where n_sources = 1 and has_wd)::bigint as only_wd,
  count(*) filter (where n_sources = 2 and not has_globi)::bigint as two_no_globi,
  count(*) filter (where n_sources = 2 and not has_ott)::bigint as two_no_ott,
  count(*) filter (where n_sources = 2 and not has_wd)::bigint as two_no_wd,
  count(*) filter (where not has_globi)::bigint as no_globi
from prof""",
    "venn_by_scheme": f"""with {LINKS}
select {REGION} as region, scheme, count(*)::bigint as n_ids from prof group by all""",
    "composites": f"with {COMPOSITES} select ext, composite, n_links::bigint as n_links from comps",
    "composite_ids": f"with {COMPOSITES} select composite, ext from members",
    "composite_conflicts": f"""with {COMPOSITES}
select composite, n_ids::bigint as n_ids, repeats::bigint as repeats, key_length::bigint as key_length from stats""",
    "composites_long": f"""with {COMPOSITES}
select g.ext, g.g, g.n_links::bigint as n_links, coalesce(len(o.others), 0)::bigint as n_others,
       len(string_split(c.composite, '|'))::bigint as key_length
from g left join others o on g.ext = o.ext
join comps c on c.ext = g.ext
  and c.composite = array_to_string(list_sort(list_append(coalesce(o.others, []::varchar[]), g.g)), '|')""",
    "composite_stats_long": f"""with {COMPOSITES}
select g.g, coalesce(len(o.others), 0)::bigint as n_others, count(*)::bigint as n_ids,
       (count(*) - count(distinct split_part(g.ext, ':', 1)))::bigint as repeats,
       (coalesce(len(o.others), 0) + 1)::bigint as key_length
from g left join others o on g.ext = o.ext group by g.g, list_sort(o.others), len(o.others)""",
    "conflicts_by_key_length": f"""with {COMPOSITES}
select key_length::bigint as key_length, count(*)::bigint as n_composites from stats where repeats > 0 group by key_length""",
    "conflicts_pair": f"""with {COMPOSITES}
select m.composite, m.ext, s.repeats::bigint as repeats, s.key_length::bigint as key_length
from members m join stats s on m.composite = s.composite where s.repeats > 0 and s.key_length = 2""",
    "conflict_lines": f"""with {COMPOSITES},
hit as (
  select m.composite, m.ext, s.repeats, s.key_length, row_number() over (partition by m.composite order by m.ext) - 1 as i
  from members m join stats s on m.composite = s.composite where s.repeats > 0 and s.key_length = 2)
select composite, (i // 3)::bigint as chunk, string_agg(ext, '|' order by i) as ids, repeats::bigint as repeats,
       key_length::bigint as key_length
from hit group by composite, i // 3, repeats, key_length""",
    "term_lists": f"""with {LINKS},
placed as (select ext, term, row_number() over (partition by ext order by term) - 1 as i from wl)
select ext, (i // 4)::bigint as chunk, string_agg(term, '|' order by i) as terms, count(*)::bigint as n_terms
from placed group by ext, i // 4""",
    "conflicts_single": f"""with {COMPOSITES}
select m.composite, m.ext, s.repeats::bigint as repeats, s.key_length::bigint as key_length
from members m join stats s on m.composite = s.composite where s.repeats > 0 and s.key_length = 1""",
}

# ---------------------------------------------------------------- entity dump and merge

TERMS = """
taxa as (
  select p_partkey as k, p_name, p_type, p_size from part where p_partkey % 5 <> 0 and p_partkey % 11 <> 0
),
terms as (
  select 'Q' || cast(k as varchar) as id,
    p_name || case when k % 7 = 0 then '|' || p_type else '' end as names,
    case when k % 7 = 0 then 2 else 1 end as n_names,
    -- a P105 qualifier (k % 19 = 0) makes a second P105 key, so no rank is read
    case when k % 6 <> 0 and k % 19 <> 0 then 'Q' || cast(p_size as varchar) else '' end as first_rank,
    case when k % 6 <> 0 and k % 19 <> 0 then 'Q' || cast(p_size as varchar)
      || case when k % 17 = 0 then '|Q' || cast(p_size + 1 as varchar) else '' end else '' end as rank_ids,
    case when k % 6 = 0 or k % 19 = 0 then 0 when k % 17 = 0 then 2 else 1 end as n_ranks,
    'Q' || cast(k % 10 as varchar) || case when k % 13 = 0 then '|Q' || cast(k % 9 as varchar) else '' end as parent_ids,
    case when k % 13 = 0 then 2 else 1 end as n_parents,
    concat_ws('|', case when k % 2 = 0 and k % 8 <> 0 then 'NCBI:' || cast(k as varchar) end,
                   case when k % 3 = 0 then 'GBIF:' || cast(k as varchar) end) as same_as_ids,
    (k % 2 = 0 and k % 8 <> 0)::int + (k % 3 = 0)::int as n_same_as,
    k, p_name, p_size
  from taxa
),
elinks as (
  select id as entity, 'NCBI:' || cast(k as varchar) as ext from terms where k % 2 = 0 and k % 8 <> 0
  union all
  select id, 'GBIF:' || cast(k as varchar) from terms where k % 3 = 0
),
full_terms as (select * from terms where n_ranks > 0 and n_same_as > 0)"""

RESOLVER = """
resolver as (
  select case when c_custkey % 17 = 0 then null else 'EOL:' || cast(c_custkey as varchar) end as providedTaxonId,
         c_name as providedTaxonName,
         case when c_custkey % 2 = 0 then 'NCBI:' else 'GBIF:' end || cast(c_custkey as varchar) as resolvedTaxonId,
         c_mktsegment as resolvedTaxonName
  from customer
),
rewired as (
  select r.providedTaxonId, r.providedTaxonName, 'WD:' || t.id as resolvedTaxonId, t.p_name as resolvedTaxonName
  from resolver r join elinks l on r.resolvedTaxonId = l.ext join full_terms t on t.id = l.entity
)"""

ORACLES.update(
    {
        "entity_prefilter": """
select 'Q' || cast(p_partkey as varchar) as entity_id, false as trailing_comma
from part where p_partkey % 5 <> 0 or p_partkey % 11 = 0""",
        "entity_terms": f"with {TERMS} select id, names, rank_ids, parent_ids, same_as_ids from terms",
        "entity_links": f"with {TERMS} select entity, ext from elinks",
        "entity_dump_scan": f"with {TERMS} select id, same_as_ids, n_names::bigint as n_names from terms",
        "multi_valued_names": f"""with {TERMS}
select n_names::bigint as n_values, id, names as joined from terms where n_names > 1""",
        "multi_valued_ranks": f"""with {TERMS}
select n_ranks::bigint as n_values, id, rank_ids as joined from terms where n_ranks > 1""",
        "multi_valued_parents": f"""with {TERMS}
select n_parents::bigint as n_values, id, parent_ids as joined from terms where n_parents > 1""",
        "same_as_histogram": f"""with {TERMS}
select n_same_as::bigint as n_ids, count(*)::bigint as n_entities from terms group by n_same_as""",
        "distinct_entities": f"with {TERMS} select count(distinct entity)::bigint as n_entities from elinks",
        "distinct_ids_by_prefix": f"""with {TERMS}
select split_part(ext, ':', 1) as prefix, count(distinct ext)::bigint as n_ids from elinks group by prefix""",
        "merge_cache": f"""with {TERMS}
select case when c_custkey % 2 = 0 then 'NCBI:' else 'GBIF:' end || cast(c_custkey as varchar) as id,
       c_name as name, c_mktsegment as rank, null::varchar as commonNames, c_name as path,
       case when c_custkey % 2 = 0 then 'NCBI:' else 'GBIF:' end || cast(c_custkey as varchar) as pathIds,
       c_mktsegment as pathNames, null::varchar as externalUrl, null::varchar as thumbnailUrl
from customer
union
select 'WD:' || id, p_name, 'WD:' || first_rank, '',
       repeat(' | ', n_parents) || p_name,
       replace('WD:' || parent_ids, '|', ' | WD:') || ' | WD:' || id,
       repeat(' | ', n_parents) || 'WD:' || first_rank,
       'https://www.wikidata.org/wiki/' || id, ''
from full_terms""",
        "merge_cache_order": f"""with {TERMS}, cache as (
select case when c_custkey % 2 = 0 then 'NCBI:' else 'GBIF:' end || cast(c_custkey as varchar) as id,
       c_name as name, c_mktsegment as rank, null::varchar as commonNames, c_name as path,
       case when c_custkey % 2 = 0 then 'NCBI:' else 'GBIF:' end || cast(c_custkey as varchar) as pathIds,
       c_mktsegment as pathNames, null::varchar as externalUrl, null::varchar as thumbnailUrl
from customer
union
select 'WD:' || id, p_name, 'WD:' || first_rank, '',
       repeat(' | ', n_parents) || p_name,
       replace('WD:' || parent_ids, '|', ' | WD:') || ' | WD:' || id,
       repeat(' | ', n_parents) || 'WD:' || first_rank,
       'https://www.wikidata.org/wiki/' || id, ''
from full_terms)
select *, row_number() over (order by id nulls first, name nulls first, rank nulls first, commonNames nulls first, path nulls first,
       pathIds nulls first, pathNames nulls first, externalUrl nulls first, thumbnailUrl nulls first) as position from cache""",
        "merge_map_order": f"""with {TERMS}, {RESOLVER}, merged as (select * from resolver union select * from rewired)
select *, row_number() over (order by providedTaxonId nulls first, providedTaxonName nulls first, resolvedTaxonId nulls first,
       resolvedTaxonName nulls first) as position from merged""",
        "merge_rewire": f"with {TERMS}, {RESOLVER} select * from rewired",
        "merge_map": f"with {TERMS}, {RESOLVER} select * from resolver union select * from rewired",
    }
)

# ---------------------------------------------------------------- typed ingest


def _int(x: str) -> str:
    return (
        f"(case when {x} is null or trim({x}) = '' then null "
        f"when regexp_full_match({x}, '\\s*[+-]?[0-9]+\\s*') then try_cast(trim({x}) as integer) end)"
    )


def _ok_int(x: str) -> str:
    return f"({x} is null or trim({x}) = '' or {_int(x)} is not null)"


_DATE_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%Y/%m/%d']"


def _date(x: str) -> str:
    return f"(case when {x} is null or trim({x}) = '' then null else cast(try_strptime(trim({x}), {_DATE_FORMATS}) as date) end)"


def _ok_date(x: str) -> str:
    return f"({x} is null or trim({x}) = '' or {_date(x)} is not null)"


RAW_ITEMS = """
raw as (
  select o_orderkey as rn,
    case when o_orderkey % 97 = 0 then 'x' || cast(o_orderkey as varchar)
         when o_orderkey % 89 = 0 then ' ' else cast(o_orderkey as varchar) end as ItemID,
    cast(o_custkey as varchar) as TitleID,
    case when o_orderpriority = '5-LOW' then '' else cast(o_custkey as varchar) end as ThumbnailPageID,
    'bc' || cast(o_orderkey as varchar) as BarCode,
    o_orderstatus as MARCItemID, o_orderpriority as CallNumber, null::varchar as VolumeInfo,
    'item/' || cast(o_orderkey as varchar) as ItemURL,
    'local' || chr(10) || cast(o_orderkey as varchar) as LocalID,
    strftime(o_orderdate, '%Y') as Year, o_orderstatus as InstitutionName, null::varchar as ZQuery,
    case when o_orderkey % 101 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%d %H:%M') end as CreationDate
  from orders
)"""

TYPED_ITEMS = f"""{RAW_ITEMS},
typed as (
  select rn, {_int('ItemID')} as itemid, {_int('TitleID')} as titleid, {_int('ThumbnailPageID')} as thumbnailpageid,
    BarCode as barcode, MARCItemID as marcitemid, CallNumber as callnumber, VolumeInfo as volumeinfo,
    ItemURL as itemurl, LocalID as localid, Year as year, InstitutionName as institutionname, ZQuery as zquery,
    {_date('CreationDate')} as creationdate,
    {_ok_int('ItemID')} as ok_itemid, {_ok_int('TitleID')} as ok_titleid,
    {_ok_int('ThumbnailPageID')} as ok_thumbnailpageid, {_ok_date('CreationDate')} as ok_creationdate
  from raw
),
checked as (
  select *, ok_itemid and ok_titleid and ok_thumbnailpageid and ok_creationdate as ok from typed
)"""

ITEM_OUT = (
    "rn, itemid, titleid, thumbnailpageid, barcode, marcitemid, callnumber, volumeinfo, itemurl, localid, year, "
    "institutionname, zquery, creationdate"
)

ORACLES.update(
    {
        "typed_ingest": f"with {TYPED_ITEMS} select {ITEM_OUT} from checked where ok",
        "keep_all_good": f"with {TYPED_ITEMS} select {ITEM_OUT} from checked where ok",
        "ingest_tsv_roundtrip": f"with {TYPED_ITEMS} select {ITEM_OUT} from checked where ok",
        "typed_ingest_required": f"""
with raw as (
  select o_orderkey as rn, cast(o_custkey as varchar) as TitleID, o_orderpriority as Subject,
    case when o_orderstatus = 'P' then null else strftime(o_orderdate, '%Y-%m-%d') end as CreationDate
  from orders
)
select rn, {_int('TitleID')} as titleid, Subject as subject, {_date('CreationDate')} as creationdate from raw
where {_ok_int('TitleID')} and {_int('TitleID')} is not null and {_ok_date('CreationDate')} and {_date('CreationDate')} is not null""",
        "reject_report": f"""with {TYPED_ITEMS}
select reason, count(*)::bigint as n_rows from (
  select 'itemid' as reason from checked where not ok_itemid
  union all select 'titleid' from checked where not ok_titleid
  union all select 'thumbnailpageid' from checked where not ok_thumbnailpageid
  union all select 'creationdate' from checked where not ok_creationdate
) group by reason""",
        "error_budget": f"""with {TYPED_ITEMS},
cut as (select case when count(*) > 50 then max(rn) end as c from (select rn from checked where not ok order by rn limit 51))
select {ITEM_OUT} from checked where ok and ((select c from cut) is null or rn < (select c from cut))""",
        "row_slice": """
select * from (select * from orders order by o_orderkey desc limit 181461) order by o_orderkey limit 15000""",
        "row_slice_inner": """
select * from (select * from orders order by o_orderkey desc limit 900) order by o_orderkey limit 300""",
        "editions_cut": """
select 'all' as edition, count(*)::bigint as n_rows from events
union all select 'small', least(count(*), 300)::bigint from events
union all select 'half', least(count(*), 700)::bigint from events""",
        "edition_ordered_cut": "select * from orders order by o_orderkey limit 700",
        "media_fields": """
select cast(event_id as varchar) as uuid, event_type as genus, event_type as mediarecords, event_type as commonnames,
       event_type as associatedsequences from events""",
        "mini_fields": """
select cast(event_id as varchar) as uuid, event_type as genus, event_type as records, event_type as associatedsequences
from events""",
        "record_fields": """
select cast(event_id as varchar) as uuid, event_type as genus, event_type as records from events""",
        "uuid_head": "select cast(event_id as varchar) as uuid from events order by uuid limit 10",
        "archive_listing": """
select p_partkey as page_id, 'gb' || cast(p_partkey as varchar) || '.seq.gz' as link from part where p_partkey % 5 <> 0""",
        "snapshot_guard": "select *, true as guarded from region",
        "histogram_export": f"""with {TERMS}
select n_same_as::bigint as n_ids, count(*)::bigint as n_entities from terms group by n_same_as""",
        "delimited_roundtrip": "select c_custkey, c_name, c_nationkey, c_mktsegment from customer",
        "headerless_csv_scan": """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority
from orders""",
        "snapshot_roundtrip": "select * from orders",
        "snapshot_partition_scan": """
with e as (
  select event_id, user_id, value, props, event_type as source, strftime(ts, '%Y%m%d') as date from events
)
select * from e where source = 'click' and date = (select max(date) from e where source = 'click')""",
        "editions_counts": """
select 'all' as edition, count(*)::bigint as n_rows from events
union all select '100k', least(count(*), 100000)::bigint from events
union all select '1M', least(count(*), 1000000)::bigint from events""",
        "edition_ordered": "select * from orders order by o_orderkey limit 100000",
        "sideload_text": """
select p_partkey, p_name, d.text as ocrtext from part left join documents d on p_partkey = d.doc_id""",
        "mirror_sideload": """
select cast(p_partkey as varchar) as barcode, p_name, d.text as ocrtext from part left join documents d on p_partkey = d.doc_id""",
        "tile_reruns": """
with t as (
  select 'N' || lpad((s_suppkey % 60)::varchar, 2, '0') || 'E' || lpad(((s_suppkey // 60) % 180)::varchar, 3, '0') as tile,
         s_suppkey, s_nationkey, unnest(generate_series(0, 8)) as pos from supplier)
select tile, (pos % 3)::int as x, (pos // 3)::int as y,
       ((s_suppkey * 7 + pos) % 3000 + case when s_nationkey = 0 then 1 else 0 end)::int as height,
       case when s_nationkey = 0 then 2 else 1 end::int as version
from t""",
        "text_coverage": """
select count(*)::bigint as n_rows, count(d.text)::bigint as n_with_text
from part left join documents d on p_partkey = d.doc_id""",
        "hash_sample": """
select * from documents
where cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) % 1000 < 100""",
        "missing_manifest": """
with specs as (
  select cast(s_suppkey as varchar) as key, s.suffix from supplier, (values ('_djvu.txt'), ('_files.xml')) s(suffix)
),
present as (select distinct cast(p_partkey as varchar) || '_djvu.txt' as file from part where p_size < 20)
select key || suffix as file, key, suffix, 'data/mirror/' || key || suffix as local_fn,
       'http://archive.org/download/' || key || '/' || key || suffix as remote_fn, null::varchar as problem
from specs where key || suffix not in (select file from present)""",
        "listing_links": """
select page_id, coalesce(string_split(piece, '"')[2], '') as link
from (select page_id, unnest(string_split(html, '<li>')) as piece from pages)
where starts_with(piece, '<a ') and contains(piece, 'href=')""",
        "records_scan": """
select cast(event_id as varchar) as uuid, event_type as genus, cast(trunc(value) as integer) as individualcount,
       strftime(ts, '%Y-%m-%d') as "data.dwc:eventDate"
from events""",
        "term_filter": "select * from customer where lower(c_mktsegment) = 'building' and cast(c_nationkey as varchar) = '7'",
        "as_array_fields": """
select cast(event_id as varchar) as uuid, event_type as genus, 1::bigint as n_genus, event_type as commonnames
from events where lower(event_type) = 'click'""",
        "boolean_projection": "select event_id, event_type = 'click' as is_click from events",
        "field_inventory": """
select field, count(*)::bigint as n_records from (select unnest(json_keys(props)) as field from events) group by field""",
    }
)

META = """
meta as (
  select 'uuid' as field, 'string' as type
  union select distinct event_type, 'float' from events
  union select 'data.dwc:eventDate', 'string'
  union select 'data.k', 'long'
  union select 'flags', 'COMPLEX'
),
tbl as (
  select * from (values ('uuid', 'string'), ('genus', 'string'), ('individualcount', 'integer'),
    ('datemodified', 'timestamp_ntz'), ('hasimage', 'boolean'), ('commonnames', 'array'),
    ('data.dwc:eventDate', 'string'), ('data.k', 'long')) t(field, type)
  where exists (select 1 from events)
)"""

_PROBE = (
    "select '{f}' as field, '{t}' as expected, "
    "count(*) filter (where {c} is not null and trim(cast({c} as varchar)) <> '')::bigint as n_present, "
    "count(*) filter (where {c} is not null and trim(cast({c} as varchar)) <> '' "
    "and try_cast(trim(cast({c} as varchar)) as {dt}) is null)::bigint as n_bad from raw"
)

_TILES = """
t as (
  select s_suppkey,
    case when s_suppkey % 10 = 9 then 'bad' || cast(s_suppkey as varchar)
    else (case when s_suppkey % 2 = 0 then 'n' else 'S' end) || lpad(cast(s_suppkey % 60 as varchar), 2, '0')
      || (case when s_suppkey % 3 = 0 then 'E' else 'w' end) || lpad(cast(s_suppkey % 180 as varchar), 3, '0') || '.hgt'
    end as fname
  from supplier
),
b as (select *, upper(substr(fname, 1, greatest(length(fname) - 4, 0))) as tile from t),
m as (select *, regexp_matches(tile, '^([NS])([0-9]+)([EW])([0-9]+)') as ok from b)"""

_PAT = "'^([NS])([0-9]+)([EW])([0-9]+)'"

ORACLES.update(
    {
        "field_catalog": f"with {META} select field, type from meta",
        "field_list": f"with {META} select field from meta where type <> 'COMPLEX'",
        "field_drift": f"""with {META},
me as (select distinct field || '::' || type as entry from meta),
te as (select distinct field || '::' || type as entry from tbl)
select entry, 'meta' as only_in from me where entry not in (select entry from te)
union all
select entry, 'table' from te where entry not in (select entry from me)""",
        "probe_fields": f"""with {RAW_ITEMS}, p as (
  {_PROBE.format(f='rn', t='bigint', c='rn', dt='bigint')}
  union all {_PROBE.format(f='ItemID', t='int', c='ItemID', dt='integer')}
  union all {_PROBE.format(f='TitleID', t='int', c='TitleID', dt='integer')}
  union all {_PROBE.format(f='ThumbnailPageID', t='int', c='ThumbnailPageID', dt='integer')}
  union all {_PROBE.format(f='CreationDate', t='timestamp', c='CreationDate', dt='timestamp')}
)
select field, expected, n_present, n_bad, n_bad = 0 as ok from p""",
        "tile_name_parse": f"""with {_TILES}
select s_suppkey, fname, tile, ok,
  case when ok then case when regexp_extract(tile, {_PAT}, 1) = 'N' then 1 else -1 end end as lat_sign,
  case when ok then try_cast(regexp_extract(tile, {_PAT}, 2) as integer) end as base_lat,
  case when ok then case when regexp_extract(tile, {_PAT}, 3) = 'E' then 1 else -1 end end as lon_sign,
  case when ok then try_cast(regexp_extract(tile, {_PAT}, 4) as integer) end as base_lon,
  case when not ok then 'bad name' end as reason
from m""",
        "grid_cells": """
with g as (
  select vec_id as grid_id, case when vec_id % 2 = 0 then 1 else -1 end as lat_sign, (vec_id % 60)::int as base_lat,
    case when label % 2 = 0 then 1 else -1 end as lon_sign, (vec_id % 180)::int as base_lon, embedding
  from embeddings
),
c as (
  select grid_id, lat_sign, base_lat, lon_sign, base_lon,
    unnest(embedding) as height, unnest(generate_series(0, len(embedding) - 1)) as pos
  from g
)
select grid_id, (pos % 8)::int as x, (pos // 8)::int as y,
  lat_sign * (base_lat + (7 - (pos // 8))::double / 7.0) - 1.0 / 14 as lat_min,
  lat_sign * (base_lat + (7 - (pos // 8))::double / 7.0) + 1.0 / 14 as lat_max,
  lon_sign * (base_lon + (pos % 8)::double / 7.0) - 1.0 / 14 as lon_min,
  lon_sign * (base_lon + (pos % 8)::double / 7.0) + 1.0 / 14 as lon_max,
  height
from c""",
    }
)


ORACLES.update(
    {
        "link_union_distinct": f"with {LINKS} select distinct ext, term from links",
        "merge_cache_nulls": f"""select distinct {', '.join(f"nullif({c}, '') as {c}" for c in CACHE_COLUMNS)}
from ({ORACLES["merge_cache"]})""",
        "malformed_entities": """
select p_partkey as entity, case when p_partkey % 13 = 0 then 'no JSON object' else 'other types' end as reason
from part where (p_partkey % 5 <> 0 or p_partkey % 11 = 0) and (p_partkey % 13 = 0 or p_partkey % 17 = 0)""",
        "entities_without_malformed": """
select 'Q' || cast(p_partkey as varchar) as id
from part where (p_partkey % 5 <> 0 or p_partkey % 11 = 0) and p_partkey % 13 <> 0 and p_partkey % 17 <> 0""",
        # ways 1, 2 and 9 with a day up to 12 have two readings; each column takes one
        "free_dates": """
with o as (
  select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 12 as way from orders
), both_ways as (
  select *, case when day(d) <= 12 then make_date(year(d), day(d), month(d)) else d end as swapped from o
)
select o_orderkey,
  case when way = 2 then swapped when way >= 10 then null else d end as date,
  case when way in (1, 9) then swapped when way = 10 then cast(date_trunc('month', d) as date) when way = 11 then null else d end as filled
from both_ways""",
    }
)
