"""All named queries on the sample catalogs, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import catalog as cat
from ..operators import duplicates as dup
from ..operators import folders as tree
from ..operators import integrity as check
from ..operators import lifecycle as life
from ..operators import mutate as change
from ..operators import similarity as sim
from ..session import fresh_dir, materialize
from ..sources import fingerprint, listing, tables
from ..sources import samples as s
from ..sources.samples import NOW
from ..streaming import observe, resume
from . import oracle, scan
from .oracle import docs, events, orders, size_text, utc_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BEFORE = s.BASE_TIME + 30_000


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return add


def _select(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[name.strip() for name in columns.split(",")])


FILE_COLUMNS = (
    "path, size, mtime, hash_value, hash_algorithm, error_status, first_scanned_at, last_scanned_at, removed, "
    "folder_path, root_path"
)
FOLDER_COLUMNS = "folder_path, parent_path, root_path, error_status, first_scanned_at, last_scanned_at, removed"
ROOT_COLUMNS = "root_path, agent_id, traverse_links, last_scan_date, folder_count, file_count, total_size"

# --- scans, sources, sinks -------------------------------------------------------------------


def _relative(spark: SparkSession, sf_dir: str, path: str | Column = "path") -> Column:
    """A path of the document tree without the folder the tree lies in."""
    top = s.document_tree(spark, sf_dir)
    column = F.col(path) if isinstance(path, str) else path
    return F.substring(column, len(top) + 1, 1 << 30)


# One file per document, some of them empty or hidden.
_TREE_FILES = f"""
  select doc_id, source, {s.TREE_FOLDER} as folder_path, {s.TREE_FOLDER} || '/' || {s.TREE_NAME} as path,
    case when doc_id % 9 = 0 then '' else text || chr(10) end as content,
    '/source=' || source as top, '/source=' || source || '/lang=' || lang as middle
  from documents"""
_TREE_SIZE = "octet_length(encode(content))::bigint"
_TREE_FOLDERS = """
  select distinct parent_path, folder_path from (
    select middle as parent_path, folder_path from t
    union all select top, middle from t
    union all select '', top from t
    union all select null, '' from t)"""


@query(f"select folder_path, path, {_TREE_SIZE} as size from ({_TREE_FILES})")
def list_files(spark, sf_dir):
    found = listing.list_files(spark, s.document_tree(spark, sf_dir))
    return found.select(
        _relative(spark, sf_dir, "folder_path").alias("folder_path"), _relative(spark, sf_dir).alias("path"), "size"
    )


@query(
    f"""with t as ({_TREE_FILES})
        select 'file' as kind, folder_path as parent_path, path, {_TREE_SIZE} as size from t
        union all
        select 'folder', parent_path, folder_path, null::bigint from ({_TREE_FOLDERS})"""
)
def walk_tree(spark, sf_dir):
    entries = listing.walk_tree(spark, s.document_tree(spark, sf_dir), split=20)
    return entries.select(
        "kind", _relative(spark, sf_dir, "parent_path").alias("parent_path"), _relative(spark, sf_dir).alias("path"), "size"
    )


@query(docs("select folder_path, parent_path, root_path from fo"))
def folder_tree(spark, sf_dir):
    return tree.folder_tree(s.doc_files(spark, sf_dir))


@query("select doc_id, sha256(text) as hash_value from documents")
def fingerprint_sha256(spark, sf_dir):
    content = s.table(spark, sf_dir, "documents")
    return content.select("doc_id", fingerprint.digest(F.col("text"), "sha256").alias("hash_value"))


def _first_with_digest(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    """Every document's digest length and the first document with the same digest, hence the same text."""
    content = s.table(spark, sf_dir, "documents")
    hashed = content.select("doc_id", fingerprint.digest(F.col("text"), algorithm).alias("hash_value"))
    first = hashed.groupBy("hash_value").agg(F.min("doc_id").alias("first_doc"))
    return hashed.join(first, "hash_value").select("doc_id", F.length("hash_value").alias("digits"), "first_doc")


@query("select doc_id, 128 as digits, min(doc_id) over (partition by text) as first_doc from documents")
def fingerprint_sha512(spark, sf_dir):
    return _first_with_digest(spark, sf_dir, "sha512")


@query("select doc_id, 64 as digits, min(doc_id) over (partition by text) as first_doc from documents")
def fingerprint_sha3_256(spark, sf_dir):
    return _first_with_digest(spark, sf_dir, "sha3-256")


_TREE_DIGESTS = f"""
  select path, sha256(content) as hash_value, 'sha256' as hash_algorithm, null as error_status from ({_TREE_FILES})"""


def _digest_rows(spark: SparkSession, sf_dir: str, digests: DataFrame) -> DataFrame:
    return digests.select(_relative(spark, sf_dir).alias("path"), "hash_value", "hash_algorithm", "error_status")


@query(_TREE_DIGESTS, name="fingerprint")
def fingerprint_of_files(spark, sf_dir):
    found = listing.list_files(spark, s.document_tree(spark, sf_dir))
    return _digest_rows(spark, sf_dir, fingerprint.fingerprint_files(found, "sha256", task_bytes=1 << 22))


@query(_TREE_DIGESTS, name="fingerprint_tree")
def fingerprint_of_tree(spark, sf_dir):
    return _digest_rows(spark, sf_dir, fingerprint.fingerprint_tree(spark, s.document_tree(spark, sf_dir), "sha256"))


@query(
    f"""with t as (select sha256(content) as h, {_TREE_SIZE} as size, * from ({_TREE_FILES})),
         d as (select h, size, count(*) as n from t where size > 0 group by 1, 2 having count(*) >= 2)
       select (select count(*) from ({_TREE_FOLDERS})) as folders,
         (select count(*) from t) as files, (select sum(size)::bigint from t) as bytes,
         (select count(*) from d) as duplicate_sets, (select coalesce(sum(n), 0)::bigint from d) as duplicate_files"""
)
def scan_all(spark, sf_dir):
    return scan.scan_all(spark, scan.empty_catalog(spark), s.document_tree(spark, sf_dir), NOW, "sha256").summary


@query(
    f"""with t as (select sha256(content) as h, {_TREE_SIZE} as size, * from ({_TREE_FILES})),
          fo as ({_TREE_FOLDERS})
        select 'file' as kind, path, folder_path as parent_path, size, h as hash_value, 'sha256' as hash_algorithm,
          {NOW}::bigint as first_scanned_at, {NOW}::bigint as last_scanned_at, 0 as removed from t
        union all
        select 'folder', folder_path, parent_path, null, null, null, {NOW}::bigint, {NOW}::bigint, 0 from fo
        union all
        select 'root', '', (select count(*) from fo) || '/' || (select count(*) from t), (select sum(size)::bigint from t),
          null, null, null, {NOW}::bigint, null"""
)
def scan_all_tables(spark, sf_dir):
    """The three tables a complete scan gives: the root's row as counts, bytes and scan time."""
    catalog = scan.scan_all(spark, scan.empty_catalog(spark), s.document_tree(spark, sf_dir), NOW, "sha256").catalog
    own = lambda name: _relative(spark, sf_dir, name)
    null = lambda kind: F.lit(None).cast(kind)
    files = catalog.files.select(
        F.lit("file").alias("kind"),
        own("path").alias("path"),
        own("folder_path").alias("parent_path"),
        *["size", "hash_value", "hash_algorithm", "first_scanned_at", "last_scanned_at", "removed"],
    )
    folders = catalog.folders.select(
        F.lit("folder"),
        own("folder_path"),
        own("parent_path"),
        *[null("bigint"), null("string"), null("string")],
        *["first_scanned_at", "last_scanned_at", "removed"],
    )
    roots = catalog.roots.select(
        F.lit("root"),
        own("root_path"),
        F.concat_ws("/", "folder_count", "file_count"),
        *["total_size", null("string"), null("string"), null("bigint"), "last_scan_date", null("int")],
    )
    return files.union(folders).union(roots)


@query(
    docs(
        f"""select coalesce(n.folder_path, o.folder_path) as folder_path,
              case when n.folder_path is null then o.parent_path else n.parent_path end as parent_path,
              coalesce(o.root_path, n.root_path) as root_path,
              coalesce(o.first_scanned_at, {NOW}) as first_scanned_at,
              case when n.folder_path is null then o.last_scanned_at else {NOW} end as last_scanned_at,
              case when n.folder_path is null then o.removed else 0 end as removed
            from dfo o full join fo n on o.folder_path = n.folder_path"""
    )
)
def scan_folders(spark, sf_dir):
    old = scan.empty_catalog(spark)._replace(folders=s.dirty_folders(spark, sf_dir))
    found = scan.scan_folders(old, s.doc_files(spark, sf_dir), NOW)
    return _select(found, "folder_path, parent_path, root_path, first_scanned_at, last_scanned_at, removed")


@query(
    docs(
        f"""select path, size, mtime, hash_value, hash_algorithm, error_status, {NOW}::bigint as first_scanned_at,
              {NOW}::bigint as last_scanned_at, 0 as removed, folder_path, root_path
            from (select f.* replace (case when hash_value is null then null else 'sha256' end as hash_algorithm)
                  from f) where folder_path in (select folder_path from dfo where removed = 0)"""
    )
)
def scan_files(spark, sf_dir):
    folders = s.dirty_folders(spark, sf_dir)
    files = s.doc_files(spark, sf_dir)
    digests = files.select(
        "path",
        "hash_value",
        F.when(F.col("hash_value").isNotNull(), "sha256").alias("hash_algorithm"),
        "error_status",
    )
    old = scan.empty_catalog(spark)._replace(folders=folders)
    found = files.select("path", "size", "mtime", "folder_path", "root_path")
    return _select(scan.scan_files(old, found, digests, NOW), FILE_COLUMNS)


_OLD_TREE = f"""
  t as (select sha256(content) as h, {_TREE_SIZE} as size, * from ({_TREE_FILES})),
  was as (
    select path, 'changed' as h, 1 as removed from t where doc_id % 5 = 0
    union all select path, 'other', 0 from t where doc_id % 5 = 1
    union all select path, 'kept', doc_id % 2 from t where doc_id % 5 = 2
    union all select path, null, 0 from t where doc_id % 5 = 3
    union all select folder_path || '/gone' || doc_id, 'gone', 0 from t where doc_id % 10 = 0)"""


def _older_catalog(spark, sf_dir) -> change.Catalog:
    """The document tree as an older scan may have left it, by document: changed size, other algorithm, untouched, failed, unknown."""
    top = s.document_tree(spark, sf_dir)
    found = materialize(listing.list_files(spark, top), "older-listing")
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    case = number % 5
    time = F.lit(1000).cast("bigint")
    files = found.where(case < 4).select(
        "path",
        F.when(case == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "mtime",
        F.when(case == 0, "changed").when(case == 1, "other").when(case == 2, "kept").alias("hash_value"),
        F.when(case == 1, "sha512").when(case != 3, "sha256").alias("hash_algorithm"),
        F.when(case == 3, "denied").alias("error_status"),
        time.alias("first_scanned_at"),
        time.alias("last_scanned_at"),
        F.when(case == 0, 1).when(case == 2, number % 2).otherwise(0).cast("int").alias("removed"),
        "folder_path",
        "root_path",
    )
    gone = files.where(number % 10 == 0).withColumns(
        {
            "path": F.concat("folder_path", F.lit("/gone"), number.cast("string")),
            "hash_value": F.lit("gone"),
            "removed": F.lit(0),
        }
    )
    return scan.empty_catalog(spark)._replace(files=files.unionByName(gone))


@query(
    f"""with {_OLD_TREE}
        select coalesce(t.path, was.path) as path, case when t.path is null or was.h = 'kept' then was.h else t.h end as hash_value,
          'sha256' as hash_algorithm, (case when was.path is null then {NOW} else 1000 end)::bigint as first_scanned_at,
          {NOW}::bigint as last_scanned_at, case when t.path is null then 1 else 0 end as removed
        from t full join was on t.path = was.path"""
)
def rescan(spark, sf_dir):
    found = scan.rescan(spark, _older_catalog(spark, sf_dir), s.document_tree(spark, sf_dir), NOW, "sha256")
    files = found.catalog.files.select(
        _relative(spark, sf_dir).alias("path"), "hash_value", "hash_algorithm", "first_scanned_at", "last_scanned_at", "removed"
    )
    return files


@query(
    f"""with {_OLD_TREE}
        select (select count(*) from t) as listed,
          (select count(*) from t left join was using (path) where was.h is distinct from 'kept') as hashed,
          (select count(*) from was where h = 'gone') as removed,
          (select count(*) from was join t using (path) where was.removed = 1) as restored"""
)
def rescan_summary(spark, sf_dir):
    return scan.rescan(spark, _older_catalog(spark, sf_dir), s.document_tree(spark, sf_dir), NOW, "sha256").summary


_JSON_FILE = """'{"path":"' || path || '","size":' || size || '}'"""


@query(
    docs(
        f"""select hash_value, size, 0::bigint as part, 1::bigint as parts,
              '{{"hash":"' || hash_value || '","size":' || size || ',"count":' || count(*) || ',"files":['
              || string_agg({_JSON_FILE}, ',' order by path) || ']}}' as document
            from m group by 1, 2"""
    )
)
def duplicates_json(spark, sf_dir):
    return dup.duplicates_json(s.doc_files(spark, sf_dir))


@query(
    docs(
        f"""select hash_value, size, part, ceil(files / 2)::bigint as parts,
              '{{"hash":"' || hash_value || '","size":' || size || ',"count":' || files || ',"files":['
              || string_agg({_JSON_FILE}, ',' order by path) || ']}}' as document
            from (select *, ('0x' || substr(md5(path), 1, 8))::bigint % ceil(files / 2)::bigint as part
                  from (select *, count(*) over (partition by hash_value, size) as files from m))
            group by hash_value, size, files, part"""
    )
)
def duplicates_json_parts(spark, sf_dir):
    return dup.duplicates_json(s.doc_files(spark, sf_dir), part_files=2)


_TABLE_COLUMNS = {
    "files": FILE_COLUMNS,
    "folders": FOLDER_COLUMNS,
    "roots": ROOT_COLUMNS,
    "scans": "scan_id, root_path, scan_mode, current_folder_path, last_processed_file, started_at, updated_at, completed",
    "agents": "id, name, guid, enabled, updated, status",
    "scan_events": 'scan_id, root_path, scan_mode, event, folder_path, file_path, "at", seq',
}


def _row_texts(sources: dict[str, str]) -> str:
    """SQL for all rows of several tables as (name, text of the columns)."""
    texts = {
        name: " || '|' || ".join(f"coalesce(({c.strip()})::varchar, '-')" for c in columns.split(","))
        for name, columns in _TABLE_COLUMNS.items()
    }
    return " union all ".join(f"select '{name}' as name, {texts[name]} as content from ({sources[name]})" for name in sources)


@query(
    oracle.on(
        oracle.DOC_TABLES + "," + oracle.EVENT_TABLES,
        _row_texts(
            {
                "files": "select * from f where removed = 0 or root_path <> '/src7'",
                "folders": "select * from fo where root_path <> '/src3'",
                "roots": "select * from r",
                "scans": "select * from sc",
                "agents": """select c_custkey as id, c_name as name, md5(c_name) as guid, (c_custkey % 4 <> 0)::int as enabled,
                    1704067200 + c_custkey as updated, c_custkey % 15 as status from customer""",
                "scan_events": "select *, tm as \"at\" from ev",
            }
        ),
    )
)
def catalog_tables(spark, sf_dir):
    """All six tables written and read again, two of them after a change of one root."""
    base = fresh_dir(spark, "catalog")
    events_ = s.scan_events(spark, sf_dir)
    contents = {
        "files": s.doc_files(spark, sf_dir),
        "folders": s.doc_folders(spark, sf_dir),
        "roots": s.doc_roots(spark, sf_dir),
        "scans": change.scan_state(events_),
        "agents": s.agents(spark, sf_dir),
        "scan_events": events_,
    }
    for name, rows in contents.items():
        tables.write_table(rows, base, name)
    kept = tables.read_table(spark, base, "files", roots=["/src7"]).where("removed = 0")
    tables.replace_roots(kept, base, "files", ["/src7"])
    tables.replace_roots(tables.read_table(spark, base, "folders").limit(0), base, "folders", ["/src3"])
    whole = None
    for name, columns in _TABLE_COLUMNS.items():
        texts = [F.coalesce(F.col(c.strip().strip('"')).cast("string"), F.lit("-")) for c in columns.split(",")]
        part = tables.read_table(spark, base, name).select(F.lit(name).alias("name"), F.concat_ws("|", *texts).alias("content"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


# --- filters and look-ups --------------------------------------------------------------------


@query(docs("select path, hash_value, size from e where size >= 1024"))
def eligible_files(spark, sf_dir):
    return _select(dup.eligible_files(s.doc_files(spark, sf_dir), min_size=1024), "path, hash_value, size")


@query(docs("select * from dr where root_path = '/src7'"))
def root_by_path(spark, sf_dir):
    return cat.root_by_path(s.dirty_roots(spark, sf_dir), "/src7")


@query(docs("select * from fo where folder_path = '/src7/en'"))
def folder_by_path(spark, sf_dir):
    return cat.folder_by_path(s.doc_folders(spark, sf_dir), "/src7/en")


@query(docs("select folder_path, root_path from dfo where removed = 0"))
def active_folders(spark, sf_dir):
    return _select(cat.active_folders(s.dirty_folders(spark, sf_dir)), "folder_path, root_path")


@query(
    docs(
        f"""select root_path, count(*) as n, 'files' as kind from df
            where removed = 1 and last_scanned_at < {BEFORE} group by 1
            union all
            select root_path, count(*), 'folders' from dfo where removed = 1 and last_scanned_at < {BEFORE} group by 1"""
    )
)
def removed_candidates(spark, sf_dir):
    return cat.removed_candidates(s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir), before=BEFORE)


# --- joins -----------------------------------------------------------------------------------


@query(
    docs(
        """select hash_value, size, path, mtime, case when root_path in ('/src3', '/src8') then '' else root_path end as root_path
           from (select *, row_number() over (partition by hash_value, size, lower(path) order by path) as rn
                 from up where hash_value is not null and removed = 0 and error_status is null)
           where rn = 1"""
    )
)
def files_by_hash(spark, sf_dir):
    roots = s.doc_roots(spark, sf_dir).where(~F.col("root_path").isin("/src3", "/src8"))
    return dup.files_by_hash(s.clashing_files(spark, sf_dir), roots)


@query(docs("select path, hash_value, size, root_path from e join g using (hash_value, size)"))
def files_with_a_twin(spark, sf_dir):
    return dup.files_with_a_twin(s.doc_files(spark, sf_dir))


@query(docs("select path, folder_path, root_path from df where folder_path not in (select folder_path from dfo)"))
def orphan_files(spark, sf_dir):
    return check.orphan_files(s.dirty_files(spark, sf_dir), s.dirty_folders(spark, sf_dir))


@query(
    docs(
        """select folder_path, parent_path, root_path from dfo
           where parent_path is not null and parent_path not in (select folder_path from dfo)"""
    )
)
def orphan_folders(spark, sf_dir):
    return check.orphan_folders(s.dirty_folders(spark, sf_dir))


@query(
    docs(
        """select f.path, f.folder_path, f.root_path from df f join dfo o using (folder_path)
           where o.removed = 1 and f.removed = 0"""
    )
)
def removed_cascade_violations(spark, sf_dir):
    return check.removed_cascade_violations(s.dirty_files(spark, sf_dir), s.dirty_folders(spark, sf_dir))


@query(
    docs(
        """select c.folder_path, c.parent_path, p.folder_path as registered_parent
           from fo c left join dfo p on c.parent_path = p.folder_path"""
    )
)
def resolve_parent(spark, sf_dir):
    found = cat.resolve_parent(tree.folder_tree(s.doc_files(spark, sf_dir)), s.dirty_folders(spark, sf_dir))
    return _select(found, "folder_path, parent_path, registered_parent")


# --- aggregations ----------------------------------------------------------------------------


@query(docs("select hash_value, size, n, count(*) as files from m group by 1, 2, 3"))
def duplicate_sets(spark, sf_dir):
    return _select(dup.duplicate_sets(s.doc_files(spark, sf_dir)), "hash_value, size, n, files")


@query(
    docs(
        """select hash_value, size, count(*) as n, count(distinct lower(path)) as files from up
           where hash_value is not null and removed = 0 and error_status is null and size >= 512
           group by 1, 2 having count(*) >= 3"""
    )
)
def duplicate_sets_filtered(spark, sf_dir):
    return dup.duplicate_sets(s.clashing_files(spark, sf_dir), min_count=3, min_size=512)


@query(docs("select hash_value, size, n, path, root_path from m"))
def duplicate_members(spark, sf_dir):
    return dup.duplicate_members(s.doc_files(spark, sf_dir))


@query(docs("select count(*) as sets, coalesce(sum(n), 0)::bigint as files from g"))
def duplicate_counts(spark, sf_dir):
    return dup.duplicate_counts(s.doc_files(spark, sf_dir))


@query(
    docs(
        """select r.root_path,
             (select count(*) from dfo where dfo.root_path = r.root_path and removed = 0) as folder_count,
             (select count(*) from df where df.root_path = r.root_path and removed = 0) as file_count,
             (select coalesce(sum(size), 0)::bigint from df where df.root_path = r.root_path and removed = 0) as total_size
           from r"""
    )
)
def root_statistics(spark, sf_dir):
    return check.root_statistics(
        s.doc_roots(spark, sf_dir), s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    )


_BY_ROOT = """
  select case when root_path in ('/src3', '/src8') then '(unknown)' else root_path end as root_path,
    count(distinct hash_value || ':' || size) as duplicate_sets, count(*) as duplicate_files,
    sum(size)::bigint as total_size
  from m group by 1"""


@query(docs(_BY_ROOT))
def duplicates_by_root(spark, sf_dir):
    roots = s.doc_roots(spark, sf_dir).where(~F.col("root_path").isin("/src3", "/src8"))
    return dup.duplicates_by_root(s.doc_files(spark, sf_dir), roots)


@query(
    docs(
        f"""select root_path, case when length(root_path) > 6 then '...' || right(root_path, 3) else root_path end as shown_path,
              format('{{:,}}', duplicate_sets) as sets_text, format('{{:,}}', duplicate_files) as files_text,
              {size_text("total_size")} as size_text
            from ({_BY_ROOT})"""
    )
)
def duplicates_summary(spark, sf_dir):
    roots = s.doc_roots(spark, sf_dir).where(~F.col("root_path").isin("/src3", "/src8"))
    return dup.duplicates_by_root_text(s.doc_files(spark, sf_dir), roots, width=6)


@query(
    docs(
        """select count(*) as sets, coalesce(sum(files), 0)::bigint as files, coalesce(sum(size * files), 0)::bigint as bytes
           from (select hash_value, size, count(*) as files from m group by 1, 2)"""
    )
)
def duplicate_totals(spark, sf_dir):
    return dup.duplicate_totals(s.doc_files(spark, sf_dir))


@query(
    docs(
        """select root_path, hash_algorithm, count(*) as n,
             cast(count(*) over (partition by root_path) > 1 as integer) as mixed
           from df where hash_algorithm is not null group by 1, 2"""
    )
)
def algorithm_mix(spark, sf_dir):
    return check.algorithm_mix(s.dirty_files(spark, sf_dir))


_MISMATCH = """
  select dr.root_path, dr.folder_count as stored_folders, dr.file_count as stored_files,
    (select count(*) from dfo where dfo.root_path = dr.root_path {live}) as actual_folders,
    (select count(*) from df where df.root_path = dr.root_path {live}) as actual_files
  from dr"""
_MISMATCHED = "select * from ({rows}) where stored_folders <> actual_folders or stored_files <> actual_files"
_WRONG_STATS = _MISMATCHED.format(rows=_MISMATCH.format(live="and removed = 0"))


@query(docs(_WRONG_STATS))
def statistics_mismatch(spark, sf_dir):
    return check.statistics_mismatch(
        s.dirty_roots(spark, sf_dir), s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    )


@query(docs(_MISMATCHED.format(rows=_MISMATCH.format(live=""))))
def statistics_mismatch_all_rows(spark, sf_dir):
    return check.statistics_mismatch(
        s.dirty_roots(spark, sf_dir), s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir), live_only=False
    )


_FUTURE = f"select root_path, count(*) as n from df where first_scanned_at > {NOW} or last_scanned_at > {NOW} group by 1"
_INVERTED = "select root_path, count(*) as n from df where first_scanned_at > last_scanned_at group by 1"


@query(docs(_FUTURE))
def future_timestamps(spark, sf_dir):
    return check.future_timestamps(s.dirty_files(spark, sf_dir), NOW)


@query(docs(_INVERTED))
def inconsistent_timestamps(spark, sf_dir):
    return check.inconsistent_timestamps(s.dirty_files(spark, sf_dir))


# --- ordered reports -------------------------------------------------------------------------


@query(
    docs(
        f"""select set_no, files, {size_text("size")} as size_text, substr(hash_value, 1, 16) as short_hash, path
            from m join (select hash_value, size, count(*) as files,
                           row_number() over (order by size desc, hash_value) as set_no from m group by 1, 2)
              using (hash_value, size)"""
    )
)
def numbered_sets(spark, sf_dir):
    return dup.numbered_sets(s.doc_files(spark, sf_dir))


_SCAN_COLUMNS = (
    "scan_id, root_path, scan_mode, current_folder_path, last_processed_file, started_at, updated_at, completed"
)


@query(
    events(
        f"""select {_SCAN_COLUMNS} from (
              select *, row_number() over (partition by root_path order by started_at desc, scan_id desc) as rn
              from sc where completed = 0)
            where rn = 1"""
    )
)
def active_scan(spark, sf_dir):
    return _select(cat.active_scan(change.scan_state(s.scan_events(spark, sf_dir))), _SCAN_COLUMNS)


_LISTED_ROOTS = f"""
  select root_path, case when length(root_path) > 6 then '...' || right(root_path, 3) else root_path end as shown_path,
    format('{{:,}}', folder_count) as folders_text, format('{{:,}}', file_count) as files_text,
    {size_text("total_size")} as size_text,
    case when last_scan_date is null then 'Never scanned'
         else {utc_text("last_scan_date", "%Y-%m-%d %H:%M:%S UTC")} end as last_scan_text
  from dr"""


@query(docs(_LISTED_ROOTS))
def roots_listing(spark, sf_dir):
    return cat.roots_listing(s.dirty_roots(spark, sf_dir), width=6)


@query(
    docs(
        f"""select root_path, '{{"path":"' || root_path || '","folder_count":' || folder_count || ',"file_count":'
              || file_count || ',"total_size_bytes":' || total_size || ',"last_scan_date":'
              || case when last_scan_date is null then 'null'
                      else '"' || {utc_text("last_scan_date", "%Y-%m-%dT%H:%M:%SZ")} || '"' end || '}}' as document
            from dr"""
    )
)
def roots_json(spark, sf_dir):
    return cat.roots_json(s.dirty_roots(spark, sf_dir))


@query(docs("select count(*) as total_roots from r"))
def roots_total(spark, sf_dir):
    return cat.roots_total(s.doc_roots(spark, sf_dir))


_AGENTS = """
  select c_custkey as id, c_name as name, md5(c_name) as guid, cast(c_custkey % 4 <> 0 as integer) as enabled,
    1704067200 + c_custkey as updated, (c_custkey % 15)::integer as status
  from customer"""
_STATUS_LIST = "[" + ", ".join(f"'{label}'" for label in text.STATUS_LABELS) + "]"
_STATUS_SQL = f"case when status between 0 and 12 then ({_STATUS_LIST})[status + 1] else 'unknown' end"


@query(f"select *, {_STATUS_SQL} as status_label from ({_AGENTS})")
def agents_listing(spark, sf_dir):
    return cat.agents_listing(s.agents(spark, sf_dir))


_SAMPLE = """
  with v as (select f.path, f.folder_path, f.root_path, row_number() over (partition by f.root_path order by f.path) as i,
               count(*) over (partition by f.root_path) as n
             from df f join dfo o using (folder_path) where o.removed = 1 and f.removed = 0)
  select root_path, i::integer as issue_no,
    'Folder ' || folder_path || ' removed but child file ' || path || ' not marked removed' as description
  from v where i <= 3
  union all
  select distinct root_path, 4, '...and ' || (n - 3) || ' more inconsistencies' from v where n > 3"""


@query(docs(f"select * from ({_SAMPLE})"))
def violation_sample(spark, sf_dir):
    return check.violation_sample(s.dirty_files(spark, sf_dir), s.dirty_folders(spark, sf_dir))


# --- changes ---------------------------------------------------------------------------------


def _observed_listing(spark, sf_dir, twice: bool = True) -> DataFrame:
    """File rows of the newer listing; every fifth document observed a second time an hour later."""
    doc_id = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    seen = s.new_listing(spark, sf_dir).select(
        *["path", "size", "mtime", "hash_value", "hash_algorithm"],
        F.lit(None).cast("string").alias("error_status"),
        F.lit(NOW).cast("bigint").alias("first_scanned_at"),
        F.lit(NOW).cast("bigint").alias("last_scanned_at"),
        F.lit(0).alias("removed"),
        *["folder_path", "root_path"],
    )
    if not twice:
        return seen
    again = seen.where(doc_id % 5 == 0).withColumns(
        {
            "size": F.col("size") + 1,
            "first_scanned_at": F.col("first_scanned_at") + 3600,
            "last_scanned_at": F.col("last_scanned_at") + 3600,
        }
    )
    return seen.unionByName(again)


@query(
    docs(
        f"""select coalesce(n.path, o.path) as path, case when n.path is null then o.size else n.size end as size,
              case when n.path is null then o.mtime else n.mtime end as mtime,
              case when n.path is null then o.hash_value else n.hash_value end as hash_value,
              case when n.path is null then o.hash_algorithm else n.hash_algorithm end as hash_algorithm,
              case when n.path is null then o.error_status end as error_status,
              case when o.path is null then n.seen else o.first_scanned_at end as first_scanned_at,
              case when n.path is null then o.last_scanned_at else n.seen end as last_scanned_at,
              case when n.path is null then o.removed else 0 end as removed,
              case when n.path is null then o.folder_path else n.folder_path end as folder_path,
              case when n.path is null then o.root_path else n.root_path end as root_path
            from f o full join (
              select * replace (case when doc_id % 5 = 0 then size + 1 else size end as size),
                ({NOW} + case when doc_id % 5 = 0 then 3600 else 0 end)::bigint as seen from li) n on o.path = n.path"""
    )
)
def upsert_files(spark, sf_dir):
    return _select(change.upsert_files(s.doc_files(spark, sf_dir), _observed_listing(spark, sf_dir)), FILE_COLUMNS)


@query(
    docs(
        f"""select coalesce(n.folder_path, o.folder_path) as folder_path,
              case when n.folder_path is null then o.parent_path else n.parent_path end as parent_path,
              coalesce(o.root_path, n.root_path) as root_path,
              case when n.folder_path is null then o.error_status else n.error_status end as error_status,
              coalesce(o.first_scanned_at, {NOW})::bigint as first_scanned_at,
              (case when n.folder_path is null then o.last_scanned_at else {NOW} end)::bigint as last_scanned_at,
              case when n.folder_path is null then o.removed else 0 end as removed
            from dfo o full join (select * replace (case when folder_path like '%/b0' then 'denied' end as error_status)
                                  from fo) n on o.folder_path = n.folder_path"""
    )
)
def upsert_folders(spark, sf_dir):
    time = F.lit(NOW).cast("bigint")
    new = s.doc_folders(spark, sf_dir).withColumns(
        {
            "error_status": F.when(F.col("folder_path").endswith("/b0"), "denied"),
            "first_scanned_at": time,
            "last_scanned_at": time,
        }
    )
    return _select(change.upsert_folders(s.dirty_folders(spark, sf_dir), new), FOLDER_COLUMNS)


@query(
    docs(
        """select coalesce(dr.root_path, n.root_path) as root_path, coalesce(n.agent_id, dr.agent_id) as agent_id,
             coalesce(n.traverse_links, dr.traverse_links) as traverse_links, dr.last_scan_date,
             coalesce(dr.folder_count, 0) as folder_count, coalesce(dr.file_count, 0) as file_count,
             coalesce(dr.total_size, 0) as total_size
           from dr full join n on dr.root_path = n.root_path""",
        """n as (select root_path, 99::bigint as agent_id, 1 as traverse_links from r where agent_id < 2
                 union all select '/new' || root_path, 7, 0 from r)""",
    )
)
def upsert_roots(spark, sf_dir):
    roots = s.doc_roots(spark, sf_dir)
    known = roots.where("agent_id < 2").select(
        "root_path", F.lit(99).cast("bigint").alias("agent_id"), F.lit(1).alias("traverse_links")
    )
    fresh = roots.select(
        F.concat(F.lit("/new"), "root_path").alias("root_path"),
        F.lit(7).cast("bigint").alias("agent_id"),
        F.lit(0).alias("traverse_links"),
    )
    return _select(change.upsert_roots(s.dirty_roots(spark, sf_dir), known.unionByName(fresh)), ROOT_COLUMNS)


@query(
    docs(
        """select * from dr union all
           select '/new' || root_path, 7::bigint, 0, null::bigint, 0::bigint, 0::bigint, 0::bigint from r"""
    )
)
def upsert_roots_strict(spark, sf_dir):
    fresh = s.doc_roots(spark, sf_dir).select(
        F.concat(F.lit("/new"), "root_path").alias("root_path"),
        F.lit(7).cast("bigint").alias("agent_id"),
        F.lit(0).alias("traverse_links"),
    )
    return _select(change.upsert_roots(s.dirty_roots(spark, sf_dir), fresh, strict=True), ROOT_COLUMNS)


@query(
    f"""with a as ({_AGENTS}),
          n as (select * replace (1 - enabled as enabled, updated + 86400 as updated, 7 as status) from a where id % 3 = 0
                union all
                select * replace (id + 1000000 as id, 'new ' || name as name, 1 as status) from a where id % 5 = 0)
        select coalesce(a.id, n.id) as id, coalesce(a.name, n.name) as name, coalesce(a.guid, n.guid) as guid,
          coalesce(n.enabled, a.enabled) as enabled, coalesce(n.updated, a.updated) as updated,
          coalesce(n.status, a.status) as status
        from a full join n on a.name = n.name and a.guid = n.guid"""
)
def upsert_agents(spark, sf_dir):
    old = s.agents(spark, sf_dir)
    known = old.where("id % 3 = 0").withColumns(
        {"enabled": 1 - F.col("enabled"), "updated": F.col("updated") + 86400, "status": F.lit(7)}
    )
    fresh = old.where("id % 5 = 0").withColumns(
        {"id": F.col("id") + 1_000_000, "name": F.concat(F.lit("new "), "name"), "status": F.lit(1)}
    )
    return change.upsert_agents(old, known.unionByName(fresh))


@query(
    docs(
        f"""select path, case when doc_id % 29 <> 0 then sha256(text) else hash_value end as hash_value,
              case when doc_id % 29 <> 0 then 'sha256' else hash_algorithm end as hash_algorithm,
              (case when doc_id % 29 <> 0 then {NOW} else last_scanned_at end)::bigint as last_scanned_at
            from f join documents using (doc_id)"""
    )
)
def set_hashes(spark, sf_dir):
    documents = s.table(spark, sf_dir, "documents").where("doc_id % 29 <> 0")
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/b"), (F.col("doc_id") % 4).cast("string"))
    digests = documents.select(
        F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        fingerprint.digest(F.col("text"), "sha256").alias("hash_value"),
        F.lit("sha256").alias("hash_algorithm"),
    )
    found = change.set_hashes(s.doc_files(spark, sf_dir), digests, NOW)
    return _select(found, "path, hash_value, hash_algorithm, last_scanned_at")


@query(
    docs(
        f"""select path, case when doc_id % 29 <> 0 then sha256(text) else hash_value end as hash_value,
              case when doc_id % 29 <> 0 then null else 'unreadable' end as error_status, {NOW}::bigint as last_scanned_at
            from f join documents using (doc_id)"""
    )
)
def set_hashes_repeated(spark, sf_dir):
    documents = s.table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/b"), (F.col("doc_id") % 4).cast("string"))
    good = F.col("doc_id") % 29 != 0
    digests = documents.select(
        F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.when(good, fingerprint.digest(F.col("text"), "sha256")).alias("hash_value"),
        F.lit("sha256").alias("hash_algorithm"),
        F.when(~good, F.lit("unreadable")).alias("error_status"),
    )
    found = change.set_hashes(s.doc_files(spark, sf_dir), digests.unionByName(digests), NOW)
    return _select(found, "path, hash_value, error_status, last_scanned_at")


@query(
    docs(
        f"""select path, case when path in (select path from li) then removed else 1 end as removed,
              (case when path in (select path from li) then last_scanned_at else {NOW} end)::bigint as last_scanned_at
            from f"""
    )
)
def set_removed(spark, sf_dir):
    files = s.doc_files(spark, sf_dir)
    lost = files.select("path").join(s.new_listing(spark, sf_dir), "path", "left_anti")
    return _select(change.set_removed(files, lost, 1, NOW), "path, removed, last_scanned_at")


@query(
    docs(
        f"""select dr.root_path, dr.agent_id, dr.traverse_links, {NOW}::bigint as last_scan_date, st.folder_count,
              st.file_count, st.total_size from dr join st using (root_path)"""
    )
)
def refresh_roots(spark, sf_dir):
    found = change.refresh_roots(
        s.dirty_roots(spark, sf_dir), s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir), NOW
    )
    return _select(found, ROOT_COLUMNS)


_DOOMED = "root_path in (select root_path from r where agent_id = 3)"


@query(
    docs(
        f"""select 'roots' as kind, root_path, count(*) as n from dr where not {_DOOMED} group by 2
            union all select 'folders', root_path, count(*) from dfo where not {_DOOMED} group by 2
            union all select 'files', root_path, count(*) from df where not {_DOOMED} group by 2
            union all select 'scans', root_path, count(*) from df where doc_id % 10 = 0 and not {_DOOMED} group by 2
            union all select 'deleted ' || folder_count || '/' || file_count || '/' || total_size, root_path, 1
              from dr where {_DOOMED}"""
    )
)
def delete_root(spark, sf_dir):
    roots, files = s.dirty_roots(spark, sf_dir), s.dirty_files(spark, sf_dir)
    doc_id = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    scans = files.where(doc_id % 10 == 0).select(doc_id.alias("scan_id"), "root_path")
    doomed = s.doc_roots(spark, sf_dir).where("agent_id = 3")
    left = change.delete_root(change.Catalog(roots, s.dirty_folders(spark, sf_dir), files, scans), doomed)
    gone = change.deleted_statistics(roots, doomed).select(
        F.format_string("deleted %d/%d/%d", "folder_count", "file_count", "total_size").alias("kind"), "root_path"
    )
    rows = gone
    for kind, df in left._asdict().items():
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), "root_path"))
    return rows.groupBy("kind", "root_path").agg(F.count(F.lit(1)).alias("n"))


_PURGE = f"""
  with rm as (select folder_path from dfo where removed = 1 and last_scanned_at < {{before}}),
    bl as (select distinct c.folder_path from dfo c join rm on c.folder_path = rm.folder_path
           or starts_with(c.folder_path, rm.folder_path || '/')),
    pf as (select df.*, removed = 1 and last_scanned_at < {{before}} as own,
             folder_path in (select folder_path from bl) as below from df),
    pd as (select dfo.*, removed = 1 and last_scanned_at < {{before}} as own,
             folder_path in (select folder_path from bl) as below from dfo)"""


@query(
    docs(
        f"""select root_path, count(*) filter (k = 'f' and own) as purged_files,
              count(*) filter (k = 'd' and own) as purged_folders,
              count(*) filter (k = 'f' and not own) as cascaded_files,
              count(*) filter (k = 'd' and not own) as cascaded_folders
            from ({_PURGE.format(before=NOW)}
              select root_path, 'f' as k, own from pf where own or below
              union all select root_path, 'd', own from pd where own or below)
            group by 1"""
    )
)
def purge_removed(spark, sf_dir):
    folders, files = s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    return change.purge_removed(folders, files, before=NOW).counts


_PURGED_ROOT = """select * from ({purge}
  select 'file' as kind, path, '' as fate from pf where root_path <> '/src1' or not (own or below)
  union all select 'folder', folder_path, '' from pd where root_path <> '/src1' or not (own or below)
  union all select 'counts', '/src1', (select count(*) filter (own) || '/' || count(*) filter (below and not own) from pf where root_path = '/src1')
    || '/' || count(*) filter (own) || '/' || count(*) filter (below and not own) from pd where root_path = '/src1')"""


def _purge_rows(purge: change.Purge) -> DataFrame:
    """What is left of both tables, and the counts, as (kind, path, fate)."""
    counted = F.concat_ws("/", "purged_files", "cascaded_files", "purged_folders", "cascaded_folders")
    blank = F.lit("")
    return (
        purge.files.select(F.lit("file").alias("kind"), "path", blank.alias("fate"))
        .unionByName(purge.folders.select(F.lit("folder").alias("kind"), F.col("folder_path").alias("path"), blank.alias("fate")))
        .unionByName(purge.counts.select(F.lit("counts").alias("kind"), F.col("root_path").alias("path"), counted.alias("fate")))
    )


@query(docs(_PURGED_ROOT.format(purge=_PURGE.format(before=NOW))))
def purge_removed_root(spark, sf_dir):
    folders, files = s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    return _purge_rows(change.purge_removed(folders, files, root_path="/src1", before=NOW))


_PURGED_KIND = """
  select 'file' as kind, path, '' as fate from {files}
  union all select 'folder', folder_path, '' from {folders}
  union all
  select 'counts', root_path, count(*) filter (k = 'f' and own) || '/' || count(*) filter (k = 'f' and not own) || '/'
    || count(*) filter (k = 'd' and own) || '/' || count(*) filter (k = 'd' and not own) from ({counted}) group by root_path"""


@query(
    docs(
        _PURGED_KIND.format(
            files="df where removed = 0",
            folders="dfo",
            counted="select root_path, 'f' as k, true as own from df where removed = 1",
        )
    )
)
def purge_removed_files(spark, sf_dir):
    folders, files = s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    return _purge_rows(change.purge_removed(folders, files, kind="files"))


@query(
    docs(
        "select * from ("
        + _PURGE.format(before=NOW)
        + _PURGED_KIND.format(
            files="pf where not below",
            folders="pd where not (own or below)",
            counted="select root_path, 'f' as k, false as own from pf where below union all select root_path, 'd', own from pd where own or below",
        )
        + ")"
    )
)
def purge_removed_folders(spark, sf_dir):
    folders, files = s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    return _purge_rows(change.purge_removed(folders, files, kind="folders", before=NOW))


@query(docs(f"select path, folder_path from ({_PURGE.format(before=BEFORE)} select * from pf where not own and not below)"))
def purged_files(spark, sf_dir):
    folders, files = s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)
    return _select(change.purge_removed(folders, files, before=BEFORE).files, "path, folder_path")


@query(events(f"select {_SCAN_COLUMNS} from sc"))
def scan_log(spark, sf_dir):
    return _select(change.scan_state(s.scan_events(spark, sf_dir)), _SCAN_COLUMNS)


@query(
    events(
        """select user_id as scan_id, '/agent' || user_id as root_path, 'all' as scan_mode,
             case when '/agent' || user_id in (select root_path from sc where completed = 0) then 0 else 1 end as accepted
           from (select distinct user_id from events)"""
    )
)
def start_scans(spark, sf_dir):
    requests = (
        s.table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("scan_id"))
        .distinct()
        .select(
            "scan_id",
            F.concat(F.lit("/agent"), F.col("scan_id").cast("string")).alias("root_path"),
            F.lit("all").alias("scan_mode"),
        )
    )
    return _select(
        change.start_scans(change.scan_state(s.scan_events(spark, sf_dir)), requests),
        "scan_id, root_path, scan_mode, accepted",
    )


# --- integrity report and repairs ------------------------------------------------------------

_ISSUES = f"""
  select root_path, 'foreign_key_integrity' as "check", 'error' as severity, 1 as issue_no,
    count(*) || ' files reference non-existent folders' as description, count(*) as n
  from df where folder_path not in (select folder_path from dfo) group by 1
  union all
  select root_path, 'foreign_key_integrity', 'error', 2,
    count(*) || ' folders reference non-existent parent folders', count(*)
  from dfo where parent_path is not null and parent_path not in (select folder_path from dfo) group by 1
  union all
  select root_path, 'timestamp_validity', 'warning', 1, n || ' files have future timestamps', n from ({_FUTURE})
  union all
  select root_path, 'timestamp_validity', 'warning', 2, n || ' files have created_at > updated_at', n from ({_INVERTED})
  union all
  select root_path, 'removed_flag_cascade', 'error', issue_no, description, 1 from ({_SAMPLE})
  union all
  select root_path, 'statistics_accuracy', 'warning', 1, 'Statistics mismatch - Expected: ' || stored_folders
    || ' folders, ' || stored_files || ' files; Actual: ' || actual_folders || ' folders, ' || actual_files || ' files', 1
  from ({_WRONG_STATS})
  union all
  select root_path, 'hash_algorithm_consistency', 'warning', 1, 'Multiple hash algorithms detected: '
    || string_agg(hash_algorithm || ' (' || c || ' files)', ' ' order by hash_algorithm), 1
  from (select root_path, hash_algorithm, count(*) as c from df where hash_algorithm is not null group by 1, 2)
  group by 1 having count(*) > 1"""
_REPORT = f"""
  select root_path, c as "check", case when coalesce(errors, 0) > 0 then 'error' when coalesce(issues, 0) > 0 then 'warning'
      else 'pass' end as status,
    coalesce(issues, 0) as issues, coalesce(errors, 0) as errors, coalesce(issues - errors, 0) as warnings
  from (select root_path, unnest({check.CHECKS}) as c from dr)
    left join (select root_path, "check" as c, count(*) as issues, count(*) filter (severity = 'error') as errors
               from ({_ISSUES}) group by 1, 2) using (root_path, c)"""


def _dirty(spark, sf_dir):
    return s.dirty_roots(spark, sf_dir), s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir)


@query(docs(f"select * from ({_ISSUES})"))
def integrity_issues(spark, sf_dir):
    return check.integrity_issues(*_dirty(spark, sf_dir), NOW)


@query(docs(f"select * from ({_REPORT})"))
def integrity_report(spark, sf_dir):
    return check.integrity_report(*_dirty(spark, sf_dir), NOW)


@query(
    docs(
        f"""select root_path, count(*) as checks_run, sum(issues)::bigint as issues_found, sum(errors)::bigint as errors,
              sum(warnings)::bigint as warnings from ({_REPORT}) group by 1"""
    )
)
def integrity_summary(spark, sf_dir):
    return check.integrity_summary(check.integrity_report(*_dirty(spark, sf_dir), NOW))


_JSON_ISSUES = f"""
  select root_path, "check" as c, string_agg('{{"description":"' || description || '","severity":"' || severity || '"}}', ','
    order by issue_no) as listed from ({_ISSUES}) group by 1, 2"""


@query(
    docs(
        f"""select root_path, '{{"root_path":"' || root_path || '","checks_run":5,"issues_found":' || sum(issues) || ',"checks":['
              || string_agg('{{"name":"' || "check" || '","status":"' || status || '","issues":[' || coalesce(listed, '') || ']}}',
                   ',' order by list_position({check.CHECKS}, "check"))
              || '],"scan_timestamp":"' || {utc_text(str(NOW), "%Y-%m-%dT%H:%M:%SZ")} || '"}}' as document
            from ({_REPORT}) left join (select root_path, c as "check", listed from ({_JSON_ISSUES})) using (root_path, "check")
            group by root_path"""
    )
)
def integrity_json(spark, sf_dir):
    return check.integrity_json(*_dirty(spark, sf_dir), NOW)


@query(docs(f"select {FILE_COLUMNS} from df where folder_path in (select folder_path from dfo)"))
def repair_orphan_files(spark, sf_dir):
    _, folders, files = _dirty(spark, sf_dir)
    return _select(check.repair_orphan_files(files, folders), FILE_COLUMNS)


@query(
    docs(
        """select folder_path, case when parent_path in (select folder_path from dfo) then parent_path end as parent_path,
             root_path from dfo"""
    )
)
def repair_orphan_folders(spark, sf_dir):
    _, folders, _ = _dirty(spark, sf_dir)
    return _select(check.repair_orphan_folders(folders), "folder_path, parent_path, root_path")


@query(
    docs(
        f"""select path, least(first_scanned_at, {NOW})::bigint as first_scanned_at,
              greatest(least(last_scanned_at, {NOW}), least(first_scanned_at, {NOW}))::bigint as last_scanned_at from df"""
    )
)
def repair_timestamps(spark, sf_dir):
    _, _, files = _dirty(spark, sf_dir)
    return _select(check.repair_timestamps(files, NOW), "path, first_scanned_at, last_scanned_at")


@query(
    docs(
        f"""select path, case when hit then 1 else removed end as removed,
              (case when hit then {NOW} else last_scanned_at end)::bigint as last_scanned_at from x""",
        """x as (select df.*, removed = 0 and folder_path in (select folder_path from dfo where removed = 1) as hit from df)""",
    )
)
def repair_removed_cascade(spark, sf_dir):
    _, folders, files = _dirty(spark, sf_dir)
    return _select(check.repair_removed_cascade(files, folders, NOW), "path, removed, last_scanned_at")


@query(
    docs(
        """select dr.root_path, dr.agent_id, dr.traverse_links, dr.last_scan_date, st.folder_count, st.file_count,
             st.total_size from dr join st using (root_path)"""
    )
)
def repair_statistics(spark, sf_dir):
    return _select(check.repair_statistics(*_dirty(spark, sf_dir)), ROOT_COLUMNS)


_REPAIRED = ", ".join(
    (
    "kept as (select * from df where folder_path in (select folder_path from dfo))",
    f"""mended as (select kept.* replace (
          case when hit then 1 else removed end as removed,
          (case when hit then {NOW} else greatest(least(last_scanned_at, {NOW}), least(first_scanned_at, {NOW})) end)::bigint
            as last_scanned_at,
          least(first_scanned_at, {NOW})::bigint as first_scanned_at)
        from (select *, removed = 0 and folder_path in (select folder_path from dfo where removed = 1) as hit from kept) kept)""",
    """recounted as (select root_path,
          (select count(*) from dfo where removed = 0 and dfo.root_path = dr.root_path) as folder_count,
          (select count(*) from mended where removed = 0 and mended.root_path = dr.root_path) as file_count,
          (select coalesce(sum(size), 0)::bigint from mended where removed = 0 and mended.root_path = dr.root_path) as total_size
        from dr)""",
    )
)


def _repaired(spark, sf_dir):
    return check.repair_all(*_dirty(spark, sf_dir), NOW)


@query(docs(f"select {FILE_COLUMNS} from mended", _REPAIRED))
def repair_all_files(spark, sf_dir):
    return _select(_repaired(spark, sf_dir).files, FILE_COLUMNS)


@query(
    docs(
        """select folder_path, case when parent_path in (select folder_path from dfo) then parent_path end as parent_path,
             root_path from dfo"""
    )
)
def repair_all_folders(spark, sf_dir):
    return _select(_repaired(spark, sf_dir).folders, "folder_path, parent_path, root_path")


@query(
    docs(
        """select dr.root_path, dr.agent_id, dr.traverse_links, dr.last_scan_date, r.folder_count, r.file_count, r.total_size
           from dr join recounted r using (root_path)""",
        _REPAIRED,
    )
)
def repair_all_roots(spark, sf_dir):
    return _select(_repaired(spark, sf_dir).roots, ROOT_COLUMNS)


@query(
    docs(
        f"""select root_path, "check", coalesce(n, 0)::bigint as fixed,
              sum(coalesce(n, 0)) over (partition by root_path)::bigint as issues_fixed
            from (select root_path, unnest({check.CHECKS}) as "check" from dr) left join (
              select root_path, "check", sum(n) as n from (
                select root_path, '{check.FOREIGN_KEYS}' as "check", 1 as n from df
                  where folder_path not in (select folder_path from dfo)
                union all select root_path, '{check.FOREIGN_KEYS}', 1 from dfo
                  where parent_path is not null and parent_path not in (select folder_path from dfo)
                union all select root_path, '{check.TIMESTAMPS}', 1 from kept
                  where first_scanned_at > {NOW} or last_scanned_at > {NOW}
                union all select root_path, '{check.TIMESTAMPS}', 1 from kept
                  where least(first_scanned_at, {NOW}) > least(last_scanned_at, {NOW})
                union all select root_path, '{check.CASCADE}', 1 from kept
                  where removed = 0 and folder_path in (select folder_path from dfo where removed = 1)
                union all select root_path, '{check.STATISTICS}', 1 from dr join recounted r using (root_path)
                  where dr.folder_count <> r.folder_count or dr.file_count <> r.file_count)
              group by all) using (root_path, "check")""",
        _REPAIRED,
    )
)
def repair_all_report(spark, sf_dir):
    return _repaired(spark, sf_dir).fixed


# --- scalar functions ------------------------------------------------------------------------

_GROWN = "(octet_length(encode(text))::bigint << ((doc_id % 5) * 10)::integer)"


@query(f"select doc_id, {size_text(_GROWN)} as size_text from documents")
def human_size(spark, sf_dir):
    size = F.expr("shiftleft(cast(octet_length(text) as bigint), cast((doc_id % 5) * 10 as int))")
    return s.table(spark, sf_dir, "documents").select("doc_id", text.human_size(size).alias("size_text"))


@query(f"select doc_id, format('{{:,}}', {_GROWN}) as size_text from documents")
def thousands(spark, sf_dir):
    size = F.expr("shiftleft(cast(octet_length(text) as bigint), cast((doc_id % 5) * 10 as int))")
    return s.table(spark, sf_dir, "documents").select("doc_id", text.thousands(size).alias("size_text"))


@query("select page_id, case when length(url) > 25 then '...' || right(url, 22) else url end as shown from pages")
def short_path(spark, sf_dir):
    return s.table(spark, sf_dir, "pages").select("page_id", text.short_path("url", 25).alias("shown"))


@query(f"select id, {_STATUS_SQL} as label from ({_AGENTS})")
def status_label(spark, sf_dir):
    return s.agents(spark, sf_dir).select("id", text.status_label("status").alias("label"))


@query(
    docs(
        f"""select root_path, case when last_scan_date is null then 'Never scanned'
              else {utc_text("last_scan_date", "%Y-%m-%d %H:%M:%S UTC")} end as shown,
              {utc_text("last_scan_date", "%Y-%m-%dT%H:%M:%SZ")} as iso from r"""
    )
)
def scan_time_text(spark, sf_dir):
    return s.doc_roots(spark, sf_dir).select(
        "root_path",
        text.scan_time_text("last_scan_date").alias("shown"),
        text.iso_time("last_scan_date").alias("iso"),
    )


_MESSY = """
  select doc_id, case when doc_id % 11 = 0 then '../' || substr(p, 2) else p end as messy
  from (select doc_id, '/' || source || '//' || upper(lang) || '/./b' || (doc_id % 4)
          || (['/../x', '/', '/a/../../y/', '', '/../../../../z'])[doc_id % 5 + 1] as p from documents)"""
_CLEAN = f"""
  select doc_id, messy, case when starts_with(messy, '/') then '/' else '' end || array_to_string(list_reduce(
      list_transform(list_filter(string_split(messy, '/'), lambda s: s not in ('', '.')), lambda s: [s]),
      lambda a, s: case
        when s[1] <> '..' then list_concat(a, s)
        when len(a) > 0 and a[-1] <> '..' then a[1:len(a) - 1]
        when starts_with(messy, '/') then a
        else list_concat(a, s) end,
      []::varchar[]), '/') as clean
  from ({_MESSY})"""


@query(f"select doc_id, clean from ({_CLEAN})")
def clean_path(spark, sf_dir):
    return s.messy_paths(spark, sf_dir).select("doc_id", paths.clean_path("messy").alias("clean"))


@query(
    f"""select doc_id, case when starts_with(messy, '/') then upper(letter) || ':' || clean else clean end as stored from (
          select doc_id, clean, messy, (['c', 'D', 'z'])[doc_id % 3 + 1] as letter from ({_CLEAN}))"""
)
def storage_path(spark, sf_dir):
    letter = F.element_at(F.array(F.lit("c"), F.lit("D"), F.lit("z")), (F.col("doc_id") % 3 + 1).cast("int"))
    # Relative paths have no drive letter and are stored clean.
    drive = F.concat(letter, F.lit(":"), paths.clean_path("messy"), F.lit("/./"))
    given = F.when(F.col("messy").startswith("/"), drive).otherwise(F.col("messy"))
    return s.messy_paths(spark, sf_dir).select("doc_id", paths.storage_path(given).alias("stored"))


@query(f"select doc_id, lower(clean) as path_key from ({_CLEAN})")
def path_key(spark, sf_dir):
    return s.messy_paths(spark, sf_dir).select("doc_id", paths.path_key("messy").alias("path_key"))


@query(
    f"""select doc_id, starts_with(clean, '/' || source || '/') as below_source,
          starts_with(clean, '/' || source || '/' || upper(lang) || '/') as below_lang
        from ({_CLEAN}) join documents using (doc_id)"""
)
def is_under(spark, sf_dir):
    documents = s.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    source = F.concat(F.lit("/"), "source")
    return (
        s.messy_paths(spark, sf_dir)
        .join(documents, "doc_id")
        .select(
            "doc_id",
            paths.is_under(F.col("messy"), source).alias("below_source"),
            paths.is_under(F.col("messy"), F.concat(source, F.lit("/"), F.upper("lang"))).alias("below_lang"),
        )
    )


# --- from the design documents ---------------------------------------------------------------


@query(
    orders(
        """select min(folder_path) over (partition by c) as group_folder, folder_path,
             count(*) over (partition by c) as copies, files, bytes
           from ms qualify count(*) over (partition by c) >= 2""",
        """ms as (select folder_path, string_agg(hash_value || ':' || size, ',' order by hash_value, size) as c,
                      count(*) as files, sum(size)::bigint as bytes from o group by 1)""",
    )
)
def duplicate_folders_direct(spark, sf_dir):
    return sim.duplicate_folders(s.order_files(spark, sf_dir), "direct")


@query(
    orders(
        """select min(folder) over (partition by c) as group_folder, folder as folder_path,
             count(*) over (partition by c) as copies, files, bytes
           from ms qualify count(*) over (partition by c) >= 2""",
        """al as (
             select folder_path, root_path, hash_value, size from o
             union all
             select '/copy' || folder_path || '/sub', '/copy' || root_path, hash_value, size from o where l_orderkey % 4 = 0),
           an as (
             select folder_path as holder, folder_path as folder, hash_value, size from al
             union all
             select folder_path, regexp_replace(folder_path, '/sub$', ''), hash_value, size from al where folder_path like '%/sub'
             union all
             select folder_path, root_path, hash_value, size from al),
           ms as (select folder, string_agg(hash_value || ':' || size, ',' order by hash_value, size) as c,
                    count(*) as files, sum(size)::bigint as bytes
                  from an where folder not like '%/sub' group by 1)""",
    )
)
def duplicate_folders(spark, sf_dir):
    return sim.duplicate_folders(s.duplicate_seed(spark, sf_dir))


_SIMILAR = """
  select left_folder, right_folder, common, distinct_contents, left_copies, right_copies, folder_pairs::bigint as folder_pairs,
    round(common * 100 / distinct_contents, 2) as similarity
  from sim where common * 100 >= distinct_contents * {threshold}"""


@query(orders(_SIMILAR.format(threshold=50)))
def similar_folders(spark, sf_dir):
    return sim.similar_folders(s.order_files(spark, sf_dir))


@query(orders(_SIMILAR.format(threshold=30)))
def similar_folders_30(spark, sf_dir):
    return sim.similar_folders(s.order_files(spark, sf_dir), threshold=30)


# Folder by folder: every two folders are compared, then counted per pair of classes.
_SUBTREE_TABLES = """
  rt as (
    select folder_path as folder, hash_value, size from oc
    union
    select root_path, hash_value, size from o),
  fs as (
    select folder, string_agg(hash_value || ':' || size, ',' order by hash_value, size) as shape, count(*) as n from rt group by 1),
  nm as (select shape, min(folder) as name, count(*) as copies, any_value(n) as n from fs group by 1),
  sc as (select name, hash_value, size from nm join rt on folder = name),
  two as (
    select hash_value, size from sc group by 1, 2 having count(*) >= 2
    intersect
    select hash_value, size from oc join fs on folder = folder_path
    group by 1, 2 having count(distinct shape || regexp_replace(folder_path, '/[^/]*$', '')) >= 2),
  core as (
    select nm.name, any_value(shape) as shape, any_value(copies) as copies, any_value(n) as n, count(two.size) as shared,
      coalesce(string_agg(two.hash_value || ':' || two.size, ',' order by two.hash_value, two.size), nm.name) as core
    from nm join sc using (name) left join two using (hash_value, size) group by nm.name),
  mem as (
    select folder, name, copies, core.n, shared, min(folder) over (partition by core.n, core) as class,
      count(*) over (partition by core.n, core) as folders
    from fs join core using (shape)),
  ot as (select class, min(name) as other from mem where name <> class group by 1),
  pr as (
    select a.folder as lo, b.folder as hi, count(*) as common
    from rt a join rt b using (hash_value, size) where a.folder < b.folder and not starts_with(b.folder, a.folder || '/')
    group by 1, 2)"""


@query(
    orders(
        """select least(x.class, y.class) as left_folder,
             case when x.class = y.class and common < x.n then other else greatest(x.class, y.class) end as right_folder, common,
             x.n + y.n - common as distinct_contents,
             case when x.class <= y.class then x.folders else y.folders end as left_copies,
             case when x.class <= y.class then y.folders else x.folders end as right_copies,
             count(*) as folder_pairs, round(common * 100 / (x.n + y.n - common), 2) as similarity
           from pr join mem x on x.folder = lo join mem y on y.folder = hi left join ot on ot.class = x.class
           where common * 100 >= (x.n + y.n - common) * 50
           group by all""",
        _SUBTREE_TABLES,
    )
)
def similar_folders_subtree(spark, sf_dir):
    return sim.similar_folders(s.order_files(spark, sf_dir), scope="subtree")


@query(
    orders(
        """select class as class_folder, folder as folder_path, name as shape_folder, copies, folders, n as contents, shared
           from mem""",
        _SUBTREE_TABLES,
    )
)
def similar_members(spark, sf_dir):
    return sim.similar_members(s.order_files(spark, sf_dir), "subtree")


@query(
    orders(
        """select folder_path, min(folder_path) over (partition by shape) as group_folder,
             count(*) over (partition by shape) as copies, contents
           from sh"""
    )
)
def folder_shapes(spark, sf_dir):
    return sim.folder_shapes(sim.folder_contents(s.order_files(spark, sf_dir)))


_DIFFERENCE_TABLES = f"""
  pr as (select left_folder, right_folder from ({_SIMILAR.format(threshold=50)}) where left_folder <> right_folder),
  lc as (select left_folder, right_folder, hash_value, size from pr join oc on folder_path = left_folder),
  rc as (select left_folder, right_folder, hash_value, size from pr join oc on folder_path = right_folder),
  ls as materialized (select left_folder, right_folder, split_part(path, '/', 4) as name, mtime from pr join o on folder_path = left_folder),
  rs as materialized (select left_folder, right_folder, split_part(path, '/', 4) as name, mtime from pr join o on folder_path = right_folder),
  nm as (select left_folder, right_folder, name, ls.mtime as left_mtime, rs.mtime as right_mtime
         from ls join rs using (left_folder, right_folder, name))"""
_DIFFERENCES = """
  select left_folder, right_folder, 'missing_right' as difference, hash_value, size, null as name,
    null::bigint as left_mtime, null::bigint as right_mtime from (from lc except from rc)
  union all
  select left_folder, right_folder, 'missing_left', hash_value, size, null, null, null from (from rc except from lc)
  union all
  select left_folder, right_folder, 'different_date', null, null, name, max(left_mtime), max(right_mtime)
  from nm group by left_folder, right_folder, name having max(left_mtime) <> max(right_mtime)"""


@query(orders(_DIFFERENCES, _DIFFERENCE_TABLES))
def folder_differences(spark, sf_dir):
    files = s.order_files(spark, sf_dir)
    return sim.folder_differences(files, sim.similar_folders(files))


@query(
    docs(
        f"""select path, case when path not in (select path from li) then 1 else removed end as removed,
              (case when removed = 0 and path not in (select path from li) then {NOW} else last_scanned_at end)::bigint
                as last_scanned_at
            from f"""
    )
)
def detect_removed(spark, sf_dir):
    found = life.detect_removed(s.doc_files(spark, sf_dir), s.new_listing(spark, sf_dir), NOW)
    return _select(found, "path, removed, last_scanned_at")


_GONE_LANG = """
  with rm as (select folder_path from fo where folder_path like '%/en' and root_path like '%1'),
    gone as (select fo.folder_path from fo join rm on fo.folder_path = rm.folder_path
             or starts_with(fo.folder_path, rm.folder_path || '/'))"""


@query(
    docs(
        f"""select kind, path, removed from ({_GONE_LANG}
              select 'folder' as kind, folder_path as path, cast(folder_path in (select folder_path from gone) as integer) as removed from fo
              union all
              select 'file', path, greatest(removed, cast(folder_path in (select folder_path from gone) as integer)) from f)"""
    )
)
def cascade_removed(spark, sf_dir):
    gone = F.col("folder_path").endswith("/en") & F.col("root_path").endswith("1")
    folders = s.doc_folders(spark, sf_dir).withColumn("removed", gone.cast("int"))
    new_folders, new_files = life.cascade_removed(folders, s.doc_files(spark, sf_dir), NOW)
    return new_folders.select(F.lit("folder").alias("kind"), F.col("folder_path").alias("path"), "removed").unionByName(
        new_files.select(F.lit("file").alias("kind"), "path", "removed")
    )


@query(
    docs(
        """select f.path, f.root_path, f.first_scanned_at, li.size as listed_size, li.mtime as listed_mtime
           from f join li using (path) where f.removed = 1"""
    )
)
def restored_files(spark, sf_dir):
    return life.restored_files(s.doc_files(spark, sf_dir), s.new_listing(spark, sf_dir))


_CHANGED_LISTING = "(select path, size, mtime + case when doc_id % 9 = 0 then 60 else 0 end as mtime from f where doc_id % 7 <> 0)"
_REHASH = f"""
  select path, root_path, hash_algorithm as old_algorithm, '{{new}}' as new_algorithm, reason from (
    select f.*, case when error_status is not null then 'error' when hash_value is null then 'unhashed'
      when hash_algorithm <> '{{new}}' then 'algorithm' when l.size <> f.size or l.mtime <> f.mtime then 'changed' end as reason
    from f left join {_CHANGED_LISTING} l using (path))
  where reason is not null"""


def _changed_listing(spark, sf_dir):
    doc_id = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    files = s.doc_files(spark, sf_dir).where(doc_id % 7 != 0)
    return files.select("path", "size", (F.col("mtime") + F.when(doc_id % 9 == 0, 60).otherwise(0)).alias("mtime"))


@query(docs(_REHASH.format(new="sha256")))
def rehash_candidates(spark, sf_dir):
    return life.rehash_candidates(s.doc_files(spark, sf_dir), _changed_listing(spark, sf_dir), "sha256")


@query(docs(f"select old_algorithm, new_algorithm, count(*) as n from ({_REHASH.format(new='sha512')}) group by 1, 2"))
def rehash_summary(spark, sf_dir):
    found = life.rehash_candidates(s.doc_files(spark, sf_dir), _changed_listing(spark, sf_dir))
    return life.rehash_summary(found)


def _moved_catalog(spark, sf_dir):
    """The catalog after the newer listing: missing files removed, new ones first seen at NOW."""
    seen = _observed_listing(spark, sf_dir, twice=False)
    merged = change.upsert_files(s.doc_files(spark, sf_dir), seen)
    return life.detect_removed(merged, seen, NOW)


@query(
    docs(
        """select a.hash_value, a.size, a.path as from_path, arg_min(b.path, row(b.first_scanned_at, b.path)) as to_path,
              min(b.first_scanned_at) as moved_at, count(*) as later_copies
            from c a join c b on a.hash_value = b.hash_value and a.size = b.size and b.first_scanned_at > a.first_scanned_at
            where a.removed = 1 and b.removed = 0 and a.error_status is null and b.error_status is null and a.size > 0
            group by 1, 2, 3""",
        f"""c as (
              select coalesce(li.path, f.path) as path, coalesce(f.size, li.size) as size,
                coalesce(li.hash_value, f.hash_value) as hash_value,
                case when li.path is null then f.error_status end as error_status,
                coalesce(f.first_scanned_at, {NOW})::bigint as first_scanned_at,
                case when li.path is null then 1 else 0 end as removed
              from f full join li on f.path = li.path)""",
    )
)
def moved_files(spark, sf_dir):
    return life.moved_files(materialize(_moved_catalog(spark, sf_dir), "moved-catalog"))


@query(docs("select hash_value, size, n, (size * (n - 1))::bigint as reclaimable from g"))
def reclaimable_bytes(spark, sf_dir):
    return dup.reclaimable_bytes(s.doc_files(spark, sf_dir))


@query(
    docs(
        """select count(*) as sets, coalesce(sum(n), 0)::bigint as files, coalesce(sum(size * (n - 1)), 0)::bigint as reclaimable
           from g"""
    )
)
def reclaimable_total(spark, sf_dir):
    return dup.reclaimable_total(s.doc_files(spark, sf_dir))


_ISO = "%Y-%m-%dT%H:%M:%SZ"


@query(
    docs(
        f"""select hash_value, size, 0::bigint as part, 1::bigint as parts,
              '{{"hash":"' || hash_value || '","algorithm":"' || min(hash_algorithm) || '","size_bytes":' || size
              || ',"file_count":' || count(*) || ',"files":[' || string_agg('{{"path":"' || path || '","mtime":"'
                || {utc_text("mtime", _ISO)} || '","first_scanned_at":"' || {utc_text("first_scanned_at", _ISO)}
                || '","last_scanned_at":"' || {utc_text("last_scanned_at", _ISO)} || '"}}', ',' order by path)
              || ']}}' as document
            from m group by 1, 2"""
    )
)
def duplicates_json_full(spark, sf_dir):
    return dup.duplicates_json_full(s.doc_files(spark, sf_dir))


@query(
    docs(
        f"""select '{{"total_duplicate_files":' || count(*) || ',"total_duplicate_sets":' || count(distinct hash_value || ':' || size)
              || ',"scan_timestamp":"' || {utc_text(str(NOW), _ISO)} || '"}}' as document from m"""
    )
)
def duplicates_json_summary(spark, sf_dir):
    return dup.duplicates_json_summary(s.doc_files(spark, sf_dir), NOW)


@query(
    docs(
        """select "table", rule, count(*) as n from broken group by 1, 2""",
        """broken as (
             select 'files' as "table", unnest(list_filter([
               case when hash_algorithm not in ('sha256', 'sha512', 'sha3-256') then 'algorithm_name' end,
               case when size < 0 then 'size_not_negative' end,
               case when removed not in (0, 1) then 'removed_flag' end,
               case when first_scanned_at > last_scanned_at then 'first_not_after_last' end,
               case when folder_root <> root_path then 'same_root_as_folder' end], lambda x: x is not null)) as rule
             from (select df.* replace (
                       case when doc_id % 41 = 0 then 'md5' else hash_algorithm end as hash_algorithm,
                       case when doc_id % 43 = 0 then -1 else size end as size,
                       case when doc_id % 47 = 0 then 2 else df.removed end as removed,
                       case when doc_id % 53 = 0 then '/elsewhere' else df.root_path end as root_path),
                     dfo.root_path as folder_root
                   from df left join dfo using (folder_path))
             union all
             select 'folders', 'first_not_after_last' from dfo where first_scanned_at > last_scanned_at
             union all
             select 'roots', unnest(list_filter([
               case when traverse_links not in (0, 1) then 'traverse_links_flag' end,
               case when file_count - 40 < 0 then 'file_count_not_negative' end], lambda x: x is not null)) from dr
             union all
             select 'scans', 'scan_mode_name' from df where doc_id % 59 = 0)""",
    )
)
def constraint_violations(spark, sf_dir):
    roots, folders, files = _dirty(spark, sf_dir)
    doc_id = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    files = files.withColumn("doc_id", doc_id).withColumns(
        {
            "hash_algorithm": F.when(F.col("doc_id") % 41 == 0, "md5").otherwise(F.col("hash_algorithm")),
            "size": F.when(F.col("doc_id") % 43 == 0, -1).otherwise(F.col("size")),
            "removed": F.when(F.col("doc_id") % 47 == 0, 2).otherwise(F.col("removed")),
            "root_path": F.when(F.col("doc_id") % 53 == 0, "/elsewhere").otherwise(F.col("root_path")),
        }
    )
    scans = files.where("doc_id % 59 = 0").select(
        F.col("doc_id").alias("scan_id"), F.lit("everything").alias("scan_mode"), F.lit(1).alias("completed")
    )
    return check.constraint_violations(
        roots.withColumn("file_count", F.col("file_count") - 40), folders, files.drop("doc_id"), scans
    )


_STALE_NOW = s.BASE_TIME + 20 * 86400


@query(
    events(
        f"""select scan_id, root_path, scan_mode, started_at, updated_at, {_STALE_NOW} - updated_at as age
            from sc where completed = 0 and updated_at < {_STALE_NOW} - 86400"""
    )
)
def stale_scans(spark, sf_dir):
    return check.stale_scans(change.scan_state(s.scan_events(spark, sf_dir)), _STALE_NOW)


@query(docs("select path, size from f where size in (select size from f group by 1 having count(*) >= 2)"))
def hash_candidates(spark, sf_dir):
    found = s.doc_files(spark, sf_dir).select("path", "size", "mtime", "folder_path", "root_path")
    return _select(dup.hash_candidates(found), "path, size")


@query(
    docs(
        """select path, hash_value, size,
             first_value(path) over w as primary_path,
             case when row_number() over w = 1 then 7 else 9 end as status
           from (select e.*, case when lang = 'en' then 1 when lang = 'de' then 2 else 1000000 end as rank from e)
             join g using (hash_value, size)
           window w as (partition by hash_value, size order by rank, first_scanned_at, path)"""
    )
)
def keep_primary(spark, sf_dir):
    lang = F.get(F.split("folder_path", "/"), 2)
    rank = F.when(lang == "en", 1).when(lang == "de", 2)
    ranks = s.doc_folders(spark, sf_dir).select("folder_path", rank.alias("rank")).where("rank is not null")
    return dup.keep_primary(s.doc_files(spark, sf_dir), ranks)


@query(
    docs(
        """select fd.folder_path, coalesce(children, 0) as children, status as old_status,
             case when status = 6 and all_synced then 7 when status = 9 and children is null then 10 else status end as new_status
           from fd left join ag using (folder_path)""",
        """fd as (
             select folder_path, parent_path, case when folder_path like '%/b1' then 7 when folder_path like '%/b2' then 9
               when folder_path like '%/b3' then 7 else 6 end as status from fo),
           ch as (
             select parent_path as folder_path, status from fd where parent_path is not null
             union all
             select folder_path, case when hash_value is null then 6 else 7 end from f where folder_path not like '%/b2'),
           ag as (select folder_path, count(*) as children, bool_and(status = 7) as all_synced from ch group by 1)""",
    )
)
def folder_states(spark, sf_dir):
    return tree.folder_states(*s.folder_rows_with_status(spark, sf_dir))


_DEEP = """
  fd as (
    select folder_path, parent_path, old_status,
      case when folder_path like '%5/%/b0' and old_status in (5, 6, 7) then 8 when folder_path like '%5/%/b0' and old_status = 11 then 12
           else old_status end as status
    from (select folder_path, parent_path,
            case when folder_path like '%4/%' and folder_path like '%/b0' then 11 when folder_path like '%/b0' then 5
                 when folder_path like '%/b1' then 7 when folder_path like '%/b2' then 6 when folder_path like '%/b3' and root_path like '%7' then 9
                 when folder_path like '%/b3' then 6 when folder_path like '%/de' then 7 when folder_path like '%/fr' then 5
                 when parent_path is null and root_path like '%9' then 5 else 6 end as old_status
          from fo)),
  fi as (
    select folder_path, case when (doc_id % 8 = 2 and lang = 'es') or (doc_id % 4 = 1 and source like '%1') then 6 else 7 end as status
    from f where not (source like '%7' and doc_id % 4 = 3) and not (source = 'src6' and lang = 'fr')),
  ch as (
    select parent_path as folder_path, status not in (5, 6, 7) as stuck from fd where parent_path is not null
    union all
    select folder_path, status <> 7 from fi),
  ag as (select folder_path, count(*) as children, bool_or(stuck) as stuck from ch group by 1),
  kn as (select fd.*, coalesce(children, 0) as children, coalesce(stuck, false) as stuck from fd left join ag using (folder_path))"""


@query(
    "with recursive " + docs(
        """select folder_path, children, old_status,
             case when status in (5, 6) and folder_path in (select folder_path from bl) then 6
                  when status = 5 or (status = 6 and children > 0) then 7
                  when status = 9 and children = 0 then 10 else status end as new_status
           from kn""",
        _DEEP
        + """,
  bl as (
    select folder_path from kn
    where status in (5, 6) and (stuck or folder_path in (select parent_path from kn where status = 6 and children = 0))
    union
    select p.folder_path from bl join kn x on x.folder_path = bl.folder_path join kn p on p.folder_path = x.parent_path
    where p.status in (5, 6))""",
    ).removeprefix("with ")
)
def folder_states_deep(spark, sf_dir):
    """All states of the life cycle over the whole tree, folders that a listing missed included."""
    path, root = F.col("folder_path"), F.col("root_path")
    ends = lambda *tails: path.rlike("(" + "|".join(tails) + ")$")
    status = (
        F.when(path.rlike("4/.*/b0$"), 11)
        .when(ends("/b0"), 5)
        .when(ends("/b1"), 7)
        .when(ends("/b2"), 6)
        .when(ends("/b3") & root.endswith("7"), 9)
        .when(ends("/b3"), 6)
        .when(ends("/de"), 7)
        .when(ends("/fr"), 5)
        .when((path == root) & root.endswith("9"), 5)
        .otherwise(6)
    )
    folders = s.doc_folders(spark, sf_dir).select("folder_path", "parent_path", "root_path", status.alias("status"))
    documents = s.table(spark, sf_dir, "documents")
    number, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    waiting = ((number % 8 == 2) & (lang == "es")) | ((number % 4 == 1) & source.endswith("1"))
    left_out = (source.endswith("7") & (number % 4 == 3)) | ((source == "src6") & (lang == "fr"))
    files = documents.where(~left_out).select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/b"), (number % 4).cast("string")).alias("folder_path"),
        F.when(waiting, 6).otherwise(7).alias("status"),
    )
    missing = folders.where(path.rlike("5/.*/b0$")).select("folder_path")
    return tree.settle_folders(folders, files, missing)


_LABELS = """
  lb as (
    select folder_path, len(string_split(folder_path, '/')) as depth,
      case when len(string_split(folder_path, '/')) = 2 then 'owner' || regexp_extract(folder_path, '(\\d+)$', 1)
           when folder_path like '%/de' then 'owner_de' end as owner,
      case when len(string_split(folder_path, '/')) = 3 then 'purpose_' || regexp_extract(folder_path, '[^/]+$') end as purpose,
      case when regexp_extract(folder_path, '(\\d+)$', 1) = '1' then 'archive'
           when len(string_split(folder_path, '/')) = 2 then 'standard' end as policy
    from fo),
  fl as (
    select fo.folder_path, arg_max(owner, depth) filter (owner is not null) as owner,
      arg_max(purpose, depth) filter (purpose is not null) as purpose,
      arg_max(policy, depth) filter (policy is not null) as policy
    from fo left join lb on fo.folder_path = lb.folder_path or starts_with(fo.folder_path, lb.folder_path || '/')
    group by 1)"""


# The first rule that holds wins; null stands for any label.
_RULES = [
    (1, "owner7", "purpose_en", None, 5),
    (2, None, "purpose_de", "archive", 1),
    (3, "owner_de", None, None, 4),
    (4, None, "purpose_fr", None, 1),
    (5, "owner1", None, "archive", 2),
    (5, "owner1", None, "archive", 9),
    (6, None, "purpose_en", "standard", 3),
    (9, None, None, "archive", 0),
]


def _rule_values() -> str:
    shown = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(shown, rule)) + ")" for rule in _RULES)


@query(
    docs(
        """select path, hash_value, size, first_value(path) over w as primary_path,
             case when row_number() over w = 1 then 7 else 9 end as status
           from (select e.*, coalesce(rank, 1000000) as rank from e left join rk using (folder_path)) join g using (hash_value, size)
           window w as (partition by hash_value, size order by rank, first_scanned_at, path)""",
        _LABELS
        + f""",
  ru(no, owner, purpose, policy, rank) as (values {_rule_values()}),
  rk as (
    select fl.folder_path, arg_min(ru.rank, row(no, ru.rank)) as rank
    from fl join ru on (ru.owner is null or ru.owner = fl.owner) and (ru.purpose is null or ru.purpose = fl.purpose)
      and (ru.policy is null or ru.policy = fl.policy)
    group by 1)""",
    )
)
def keep_primary_by_labels(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule_no int, owner string, purpose string, policy string, rank int")
    labels = s.folder_label_rows(spark, sf_dir)
    return dup.keep_primary_by_labels(s.doc_files(spark, sf_dir), s.doc_folders(spark, sf_dir), labels, rules)


@query(docs("select * from fl", _LABELS))
def folder_labels(spark, sf_dir):
    return tree.folder_labels(s.doc_folders(spark, sf_dir), s.folder_label_rows(spark, sf_dir))


@query(docs("select path, f.folder_path, owner, purpose, policy from f left join fl using (folder_path)", _LABELS))
def file_labels(spark, sf_dir):
    labelled = tree.folder_labels(s.doc_folders(spark, sf_dir), s.folder_label_rows(spark, sf_dir))
    return tree.file_labels(s.doc_files(spark, sf_dir), labelled)


@query(
    docs(
        """select a.folder_path, a.root_path, (len(string_split(a.folder_path, '/')) - 2)::integer as depth,
             a.first_scanned_at as registered_at,
             (select count(*) from dfo d where d.removed = 0 and starts_with(d.folder_path, a.folder_path || '/')) as folders_below,
             (select count(*) from df f where f.removed = 0 and starts_with(f.path, a.folder_path || '/')) as files_below,
             (select coalesce(sum(size), 0)::bigint from df f where f.removed = 0 and starts_with(f.path, a.folder_path || '/'))
               as bytes_below
           from dfo a where a.removed = 0"""
    )
)
def folder_hierarchy(spark, sf_dir):
    return tree.folder_hierarchy(s.dirty_folders(spark, sf_dir), s.dirty_files(spark, sf_dir))


# --- streaming -------------------------------------------------------------------------------


@query(
    events(
        """select path, arg_max(root_path, row(ts, seq)) as root_path, arg_max(size, row(ts, seq)) as size,
             arg_max(hash_value, row(ts, seq)) as hash_value, min(ts) as first_seen, max(ts) as last_seen
           from ob group by 1"""
    )
)
def observe_stream(spark, sf_dir):
    source, out, done = [fresh_dir(spark, f"observe-{part}") for part in ("input", "batches", "checkpoint")]
    found = s.observations(spark, sf_dir)
    found.repartition(6, "seq").write.parquet(source)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 2).parquet(source)
    observe.observe_stream(stream, out, done).awaitTermination()
    return observe.observed_files(spark, out)


@query(SQL["observe_stream"])
def observe_stream_restarted(spark, sf_dir):
    """Two streams with checkpoints of their own, each with half of the input, into one folder."""
    out, found = fresh_dir(spark, "observe-batches"), s.observations(spark, sf_dir)
    for part in (0, 1):
        source, done = fresh_dir(spark, "observe-input"), fresh_dir(spark, "observe-checkpoint")
        found.where(F.pmod(F.col("seq"), F.lit(2)) == part).repartition(3, "seq").write.parquet(source)
        stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 2).parquet(source)
        observe.observe_stream(stream, out, done).awaitTermination()
    return observe.observed_files(spark, out)


_KNOWN = """
  old as (
    select path, min(ts) - 1000 as first, case when length(path) % 2 = 0 then max(ts) + 100000000 else min(ts) - 500 end as last
    from ob where seq % 3 = 0 and path is not null group by path),
  nw as (
    select path, min(ts) as first, max(ts) as last, arg_max(size, row(ts, seq)) as size,
      arg_max(hash_value, row(ts, seq)) as hash_value, arg_max(root_path, row(ts, seq)) as root_path
    from ob where seq % 3 <> 0 and path is not null group by path),
  bo as (
    select coalesce(old.path, nw.path) as path, old.first as of, old.last as ol, nw.first as nf, nw.last as nl, size, hash_value,
      nw.path is not null and (old.path is null or nw.last >= old.last) as newer
    from old full join nw on old.path = nw.path)"""


@query(
    events(
        """select path, case when newer then size else 1 end::bigint as size, case when newer then nl else 7 end::bigint as mtime,
             case when newer then hash_value end as hash_value, case when newer then 'sha256' end as hash_algorithm,
             case when not newer then 'denied' end as error_status, least(of, nf)::bigint as first_scanned_at,
             (case when newer then nl else ol end)::bigint as last_scanned_at, case when newer then 0 else 1 end as removed,
             regexp_replace(path, '/[^/]*$', '') as folder_path, '/' || split_part(path, '/', 2) as root_path
           from bo""",
        _KNOWN,
    )
)
def observed_catalog(spark, sf_dir):
    """Two thirds of the observations streamed into a catalog of removed files, with a restart half-way."""
    base, source, done = [fresh_dir(spark, f"observed-{part}") for part in ("catalog", "input", "checkpoint")]
    told = s.observations(spark, sf_dir).where("path is not null")
    seq = F.col("seq")
    newer = F.length("path") % 2 == 0
    known = told.where(seq % 3 == 0).groupBy("path").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.first("root_path").alias("root_path"))
    old = known.select(
        "path",
        F.lit(1).cast("bigint").alias("size"),
        F.lit(7).cast("bigint").alias("mtime"),
        F.lit(None).cast("string").alias("hash_value"),
        F.lit(None).cast("string").alias("hash_algorithm"),
        F.lit("denied").alias("error_status"),
        (F.col("lo") - 1000).alias("first_scanned_at"),
        F.when(newer, F.col("hi") + 100_000_000).otherwise(F.col("lo") - 500).alias("last_scanned_at"),
        F.lit(1).alias("removed"),
        paths.parent_of("path").alias("folder_path"),
        "root_path",
    )
    tables.write_table(old, base, "files")
    for part in (0, 1):
        rows = told.where((seq % 3 != 0) & (F.pmod(F.xxhash64("seq"), F.lit(2)) == part))
        rows.repartition(2, "seq").write.mode("append").parquet(source)
        stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 2).parquet(source)
        observe.observe_catalog(stream, base, done, algorithm="sha256").awaitTermination()
    return _select(tables.read_table(spark, base, "files"), FILE_COLUMNS)


@query(_TREE_DIGESTS)
def resumable_scan(spark, sf_dir):
    found = listing.list_files(spark, s.document_tree(spark, sf_dir))
    source, out, done = [fresh_dir(spark, f"scan-{part}") for part in ("listing", "digests", "checkpoint")]
    half = F.pmod(F.xxhash64("path"), F.lit(2))
    for part in (0, 1):
        resume.write_listing(found.where(half == part), f"{source}/part={part}", files=2)
        resume.resumable_scan(
            spark, f"{source}/part=*", out, done, algorithm="sha256", files_per_step=1
        ).awaitTermination()
    return _digest_rows(spark, sf_dir, resume.scanned_digests(spark, out))


@query(_TREE_DIGESTS)
def resumable_scan_restarted(spark, sf_dir):
    """A scan that is begun anew, in other steps, into the folder of an earlier one."""
    found = listing.list_files(spark, s.document_tree(spark, sf_dir))
    source, out = fresh_dir(spark, "scan-listing"), fresh_dir(spark, "scan-digests")
    resume.write_listing(found, source, files=5)
    for step in (1, 3):
        resume.resumable_scan(spark, source, out, algorithm="sha256", files_per_step=step).awaitTermination()
    return _digest_rows(spark, sf_dir, resume.scanned_digests(spark, out))


@query(
    f"""with t as ({_TREE_FILES}),
          steps as (
            select 'interrupted' as phase, max(path) filter (doc_id % 2 = 0) as last, count(*) filter (doc_id % 2 = 0) as digests,
              100 as updated_at, 0 as completed from t
            union all
            select 'resumed', max(path) filter (doc_id % 2 = 1), count(*), 200, 0 from t
            union all
            select 'completed', max(path) filter (doc_id % 2 = 1), count(*), 300, 1 from t)
        select phase, 1::bigint as scan_id, 'files' as scan_mode, regexp_replace(last, '/[^/]*$', '') as current_folder_path,
          last as last_processed_file, 100::bigint as started_at, updated_at::bigint as updated_at, completed, digests
        from steps"""
)
def resumable_scan_log(spark, sf_dir):
    """What the scan log says of a scan that stops half-way, goes on and is completed."""
    root = s.document_tree(spark, sf_dir)
    found = listing.list_files(spark, root)
    source, out = fresh_dir(spark, "scan-listing"), fresh_dir(spark, "scan-digests")
    even = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint") % 2 == 0
    phases = []

    def told(phase: str) -> DataFrame:
        state = change.scan_state(resume.scan_events(spark, out))
        shown = state.withColumn("digests", F.lit(resume.scanned_digests(spark, out).count()).cast("bigint")).select(
            F.lit(phase).alias("phase"),
            "scan_id",
            "scan_mode",
            _relative(spark, sf_dir, "current_folder_path").alias("current_folder_path"),
            _relative(spark, sf_dir, "last_processed_file").alias("last_processed_file"),
            *["started_at", "updated_at", "completed", "digests"],
        )
        return materialize(shown, "scan-log")

    for phase, part, at in (("interrupted", even, 100), ("resumed", ~even, 200)):
        resume.write_listing(found.where(part), f"{source}/part={at}", files=1)
        resume.logged_scan(spark, f"{source}/part=*", out, root, at, algorithm="sha256").awaitTermination()
        phases.append(told(phase))
    resume.complete_scan(spark, out, root, 300)
    return phases[0].unionByName(phases[1]).unionByName(told("completed"))
