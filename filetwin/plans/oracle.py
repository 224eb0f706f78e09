"""Common table expressions in DuckDB SQL that mirror `sources.samples`."""

from __future__ import annotations

NOW = 1735689600

# Files, folders and roots derived from `documents`, clean (f, fo, r) and damaged (df, dfo, dr).
DOC_TABLES = """
f as (
  select '/' || source || '/' || lang || '/b' || (doc_id % 4) || '/doc_' || doc_id || '.txt' as path,
    octet_length(encode(text))::bigint as size, (1704067200 + doc_id * 60)::bigint as mtime,
    case when doc_id % 29 = 0 or doc_id % 31 = 0 then null else sha256(text) end as hash_value,
    case when doc_id % 29 = 0 or doc_id % 31 = 0 then null
         when doc_id % 50 = 0 then 'sha512' else 'sha256' end as hash_algorithm,
    case when doc_id % 29 = 0 then 'permission denied' end as error_status,
    (1704067200 + doc_id * 60)::bigint as first_scanned_at,
    (1704067200 + doc_id * 60 + 3600)::bigint as last_scanned_at,
    cast(doc_id % 23 = 0 as integer) as removed,
    '/' || source || '/' || lang || '/b' || (doc_id % 4) as folder_path,
    '/' || source as root_path, doc_id, source, lang
  from documents),
fx as (select * exclude (doc_id, source, lang) from f),
fo as (
  select folder_path, parent_path, root_path, null::varchar as error_status,
    min(first_scanned_at) as first_scanned_at, max(last_scanned_at) as last_scanned_at, 0 as removed
  from (
    select folder_path, '/' || source || '/' || lang as parent_path, root_path, first_scanned_at, last_scanned_at from f
    union all
    select '/' || source || '/' || lang, '/' || source, root_path, first_scanned_at, last_scanned_at from f
    union all
    select '/' || source, null, root_path, first_scanned_at, last_scanned_at from f)
  group by 1, 2, 3),
r as (
  select '/' || source as root_path, (substr(source, 4)::bigint % 5)::bigint as agent_id, 0 as traverse_links,
    case when substr(source, 4)::bigint % 3 <> 0 then 1704067200 + max(doc_id) * 60 + 3600 end::bigint as last_scan_date,
    0::bigint as folder_count, 0::bigint as file_count, 0::bigint as total_size
  from documents group by source),
e as (select * from f where hash_value is not null and removed = 0 and error_status is null and size > 0),
g as (select hash_value, size, count(*) as n from e group by 1, 2 having count(*) >= 2),
m as (
  select * exclude (rn) from (
    select e.*, g.n, row_number() over (partition by e.hash_value, e.size, lower(e.path) order by e.path) as rn
    from e join g using (hash_value, size))
  where rn = 1),
df as (
  select * replace (case when doc_id % 37 = 0 then first_scanned_at + 1000000000 else first_scanned_at end
                    as first_scanned_at)
  from f),
dfo as (
  select folder_path, case when folder_path like '%/b2' then '/nowhere' else parent_path end as parent_path,
    root_path, error_status, first_scanned_at, last_scanned_at,
    cast(folder_path like '%/de/b1' as integer) as removed
  from fo where folder_path not like '%/b3'),
st as (
  select r.root_path,
    (select count(*) from dfo where dfo.root_path = r.root_path and removed = 0) as folder_count,
    (select count(*) from df where df.root_path = r.root_path and removed = 0) as file_count,
    (select coalesce(sum(size), 0)::bigint from df where df.root_path = r.root_path and removed = 0) as total_size
  from r),
dr as (
  select r.root_path, r.agent_id, r.traverse_links, r.last_scan_date, st.folder_count,
    st.file_count + cast(right(r.root_path, 1)::int % 2 = 0 as bigint) as file_count, st.total_size
  from r join st using (root_path)),
li as (
  select path, size, mtime, hash_value, hash_algorithm, folder_path, root_path, doc_id from f where doc_id % 7 <> 0
  union all
  select '/moved' || path, size, mtime + 86400, hash_value, hash_algorithm, '/moved' || folder_path, root_path, doc_id
  from f where doc_id % 14 = 0),
up as (
  select * from f union all
  select * replace (upper(path) as path) from f where doc_id % 10 = 0)"""

# Files derived from `lineitem`: an order is a folder, a line a file.
ORDER_TABLES = """
o as (
  select '/wh' || (l_orderkey % 8) || '/o_' || l_orderkey || '/l_' || l_linenumber || '.dat' as path,
    (100 + l_partkey % 997)::bigint as size, sha256(cast(l_partkey as varchar)) as hash_value,
    floor(epoch(l_shipdate))::bigint as mtime,
    '/wh' || (l_orderkey % 8) || '/o_' || l_orderkey as folder_path, '/wh' || (l_orderkey % 8) as root_path,
    l_orderkey
  from lineitem),
oc as (select distinct folder_path, hash_value, size from o),
sh as (
  select folder_path, string_agg(hash_value || ':' || size, ',' order by hash_value, size) as shape, count(*) as contents
  from oc group by 1),
shapes as (select shape, min(folder_path) as name, count(*) as copies, any_value(contents) as contents from sh group by 1),
named as (select s.name, s.copies, s.contents, c.hash_value, c.size from shapes s join oc c on c.folder_path = s.name),
ct as (select hash_value, size from named group by 1, 2 having count(*) >= 2),
cs as (
  select n.name, any_value(n.copies) as copies, any_value(n.contents) as contents, count(ct.hash_value) as shared,
    coalesce(string_agg(ct.hash_value || ':' || ct.size, ',' order by ct.hash_value, ct.size), n.name) as core
  from named n left join ct using (hash_value, size) group by n.name),
cl as (
  select min(name) as class, sum(copies)::bigint as folders, sum(copies * copies)::bigint as squares, contents,
    any_value(shared) as shared, list_sort(list(name))[2] as other from cs group by contents, core),
cc as (
  select c.class, c.folders, c.contents, n.hash_value, n.size
  from cl c join named n on n.name = c.class join ct using (hash_value, size)),
co as (
  select a.class as left_folder, b.class as right_folder, count(*) as common,
    any_value(a.folders) as left_copies, any_value(b.folders) as right_copies,
    any_value(a.contents) + any_value(b.contents) - count(*) as distinct_contents
  from cc a join cc b using (hash_value, size) where a.class < b.class group by 1, 2),
sim as (
  select left_folder, right_folder, common, distinct_contents, left_copies, right_copies,
    left_copies * right_copies as folder_pairs from co
  union all
  select class, class, contents, contents, folders, folders, (squares - folders) // 2 from cl where squares > folders
  union all
  select class, other, shared, 2 * contents - shared, folders, folders, (folders * folders - squares) // 2
  from cl where folders * folders > squares and shared > 0)"""

# Observations and the scan log derived from `events`.
EVENT_TABLES = """
ob as (
  select event_id as seq, floor(epoch(ts))::bigint as ts, '/agent' || user_id as root_path,
    '/agent' || user_id || '/' || event_type || '/f' || json_extract_string(props, '$.k') as path,
    cast(round(value * 100) as bigint) as size, sha256(cast(value as varchar)) as hash_value
  from events),
ev as (
  select user_id * 100 + day(ts) as scan_id, '/agent' || user_id as root_path,
    case user_id % 3 when 0 then 'all' when 1 then 'folders' else 'files' end as scan_mode,
    case when row_number() over (partition by user_id * 100 + day(ts) order by event_id) = 1 then 'start'
         when event_type = 'purchase' then 'complete'
         when event_type = 'error' and user_id % 7 = 0 then 'clear' else 'save' end as event,
    '/agent' || user_id || '/' || event_type as folder_path,
    '/agent' || user_id || '/' || event_type || '/f' || json_extract_string(props, '$.k') as file_path,
    floor(epoch(ts))::bigint as tm, event_id as seq
  from events),
sc as (
  select scan_id, root_path,
    arg_min(scan_mode, row(tm, seq)) filter (event = 'start') as scan_mode,
    arg_max(folder_path, row(tm, seq)) filter (event = 'save') as current_folder_path,
    arg_max(file_path, row(tm, seq)) filter (event = 'save') as last_processed_file,
    min(tm) filter (event = 'start') as started_at, max(tm) as updated_at,
    max(cast(event = 'complete' as integer)) as completed
  from ev group by 1, 2
  having count(*) filter (event = 'clear') = 0 and count(*) filter (event = 'start') > 0)"""


def on(tables: str, body: str, ctes: str = "") -> str:
    """`body` behind the sample tables and any further common table expressions."""
    return "with " + ",\n".join(part.strip() for part in (tables, ctes) if part) + "\n" + body.strip()


def docs(body: str, ctes: str = "") -> str:
    return on(DOC_TABLES, body, ctes)


def orders(body: str, ctes: str = "") -> str:
    return on(ORDER_TABLES, body, ctes)


def events(body: str, ctes: str = "") -> str:
    return on(EVENT_TABLES, body, ctes)


def size_text(value: str) -> str:
    """Readable size of an SQL expression."""
    cases = [f"when {value} < 1024 then {value} || ' B'"]
    units = ["KB", "MB", "GB", "TB", "PB", "EB"]
    for power, unit in enumerate(units, start=1):
        shown = f"printf('%.1f {unit}', ({value})::double / {1024**power}::double)"
        cases.append(f"else {shown}" if unit == "EB" else f"when {value} < {1024 ** (power + 1)} then {shown}")
    return "case " + " ".join(cases) + " end"


def utc_text(value: str, pattern: str) -> str:
    return f"strftime(make_timestamp(({value})::bigint * 1000000), '{pattern}')"
