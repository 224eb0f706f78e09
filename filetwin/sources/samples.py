"""Catalog tables derived from the given benchmark tables; see FIXTURES.md.

Everything is a plain projection of the input, so a query on a sample catalog reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, path_exists
from .stores import plain_path, store_of

BASE_TIME = 1704067200
NOW = 1735689600


# Columns read from the given tables; naming them saves a schema job per read.
COLUMNS = {
    "documents": "doc_id bigint, text string, lang string, source string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(column: str):
    """Whole seconds since 1970 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


_BUCKET = "concat('/', source, '/', lang, '/b', doc_id % 4)"
_SEEN = f"{BASE_TIME}L + doc_id * 60"
_FAILED = "doc_id % 29 = 0"
_UNHASHED = f"({_FAILED} or doc_id % 31 = 0)"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`files` from `documents`: exact copies, errors, missing hashes, removed rows."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"concat({_BUCKET}, '/doc_', doc_id, '.txt') as path",
        "cast(octet_length(text) as bigint) as size",
        f"{_SEEN} as mtime",
        f"if({_UNHASHED}, null, sha2(cast(text as binary), 256)) as hash_value",
        f"if({_UNHASHED}, null, if(doc_id % 50 = 0, 'sha512', 'sha256')) as hash_algorithm",
        f"if({_FAILED}, 'permission denied', null) as error_status",
        f"{_SEEN} as first_scanned_at",
        f"{_SEEN} + 3600 as last_scanned_at",
        "cast(doc_id % 23 = 0 as int) as removed",
        f"{_BUCKET} as folder_path",
        "concat('/', source) as root_path",
    )


def doc_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`folders` of `doc_files`: roots, languages and buckets with the times of the files below."""
    buckets = (
        table(spark, sf_dir, "documents")
        .selectExpr(
            "concat('/', source) as root_path",
            "concat('/', source, '/', lang) as lang_path",
            f"{_BUCKET} as bucket_path",
            f"{_SEEN} as seen",
        )
        .groupBy("root_path", "lang_path", "bucket_path")
        .agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    )
    levels = buckets.selectExpr(
        "root_path",
        "lo",
        "hi",
        "stack(3, root_path, cast(null as string), lang_path, root_path, bucket_path, lang_path) "
        "as (folder_path, parent_path)",
    )
    return (
        levels.groupBy("folder_path", "parent_path", "root_path")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .selectExpr(
            "folder_path",
            "parent_path",
            "root_path",
            "cast(null as string) as error_status",
            "lo as first_scanned_at",
            "hi + 3600 as last_scanned_at",
            "0 as removed",
        )
    )


def doc_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`roots`: one per source, registered but not yet counted; every third never scanned."""
    number = "cast(substring(source, 4) as bigint)"
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.max("doc_id").alias("last_id"))
        .selectExpr(
            "concat('/', source) as root_path",
            f"{number} % 5 as agent_id",
            "0 as traverse_links",
            f"if({number} % 3 <> 0, {BASE_TIME}L + last_id * 60 + 3600, null) as last_scan_date",
            "0L as folder_count",
            "0L as file_count",
            "0L as total_size",
        )
    )


def dirty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_folders` with missing rows, lost parents and removed folders."""
    return (
        doc_folders(spark, sf_dir)
        .where("not endswith(folder_path, '/b3')")
        .selectExpr(
            "folder_path",
            "if(endswith(folder_path, '/b2'), '/nowhere', parent_path) as parent_path",
            "root_path",
            "error_status",
            "first_scanned_at",
            "last_scanned_at",
            "cast(endswith(folder_path, '/de/b1') as int) as removed",
        )
    )


DOC_ID = "cast(regexp_extract(path, 'doc_([0-9]+)', 1) as bigint)"


def dirty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_files` with first times in the future where doc_id divides by 37."""
    late = F.expr(f"first_scanned_at + if({DOC_ID} % 37 = 0, 1000000000L, 0L)")
    return doc_files(spark, sf_dir).withColumn("first_scanned_at", late)


def dirty_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_roots` with true live counts, one file too many for roots ending in an even digit."""
    from ..operators.integrity import root_statistics

    roots = doc_roots(spark, sf_dir)
    true = root_statistics(roots, dirty_folders(spark, sf_dir), dirty_files(spark, sf_dir))
    kept = roots.drop("folder_count", "file_count", "total_size")
    even = F.expr("file_count + cast(cast(right(root_path, 1) as int) % 2 = 0 as bigint)")
    return kept.join(true, "root_path").withColumn("file_count", even)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`files` from `lineitem`: order = folder, line = file; folders overlap in contents."""
    root = "concat('/wh', l_orderkey % 8)"
    folder = f"concat({root}, '/o_', l_orderkey)"
    seen = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"concat({folder}, '/l_', l_linenumber, '.dat') as path",
        "100L + l_partkey % 997 as size",
        f"{seen} as mtime",
        "sha2(cast(cast(l_partkey as string) as binary), 256) as hash_value",
        "'sha256' as hash_algorithm",
        "cast(null as string) as error_status",
        f"{seen} as first_scanned_at",
        f"{seen} as last_scanned_at",
        "0 as removed",
        f"{folder} as folder_path",
        f"{root} as root_path",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream input from `events`: one file observation per event."""
    events = table(spark, sf_dir, "events")
    root = F.concat(F.lit("/agent"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_seconds("ts").alias("ts"),
        root.alias("root_path"),
        F.concat(root, F.lit("/"), "event_type", F.lit("/f"), F.get_json_object("props", "$.k")).alias("path"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
        F.sha2(F.col("value").cast("string").cast("binary"), 256).alias("hash_value"),
    )


def new_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of `doc_files`: every 7th file gone, every 14th moved below /moved.

    A moved file keeps its root.
    """
    files = doc_files(spark, sf_dir)
    doc_id = F.expr(DOC_ID)
    cols = ["path", "size", "mtime", "hash_value", "hash_algorithm", "folder_path", "root_path"]
    staying = files.where(doc_id % 7 != 0).select(*cols)
    moved = files.where(doc_id % 14 == 0).select(
        F.concat(F.lit("/moved"), "path").alias("path"),
        "size",
        (F.col("mtime") + 86400).alias("mtime"),
        "hash_value",
        "hash_algorithm",
        F.concat(F.lit("/moved"), "folder_path").alias("folder_path"),
        "root_path",
    )
    return staying.unionByName(moved)


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan log from `events`: agent and day = scan; its first event starts it.

    Purchases complete a scan, errors after a third of the month clear it, the rest saves progress.
    """
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    scan_id = F.col("user_id") * 100 + day
    root = F.concat(F.lit("/agent"), F.col("user_id").cast("string"))
    first = F.row_number().over(Window.partitionBy("scan_id").orderBy("event_id")) == 1
    kind = (
        F.when(first, "start")
        .when(F.col("event_type") == "purchase", "complete")
        .when((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0), "clear")
        .otherwise("save")
    )
    folder = F.concat(root, F.lit("/"), F.col("event_type"))
    mode = F.element_at(F.array(F.lit("all"), F.lit("folders"), F.lit("files")), (F.col("user_id") % 3 + 1).cast("int"))
    return events.withColumn("scan_id", scan_id).select(
        "scan_id",
        root.alias("root_path"),
        mode.alias("scan_mode"),
        kind.alias("event"),
        folder.alias("folder_path"),
        F.concat(folder, F.lit("/f"), F.get_json_object("props", "$.k")).alias("file_path"),
        epoch_seconds("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`agents` from `customer`, with status codes beyond the known ones."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.md5(F.col("c_name").cast("binary")).alias("guid"),
        (F.col("c_custkey") % 4 != 0).cast("int").alias("enabled"),
        (F.lit(BASE_TIME) + F.col("c_custkey")).alias("updated"),
        (F.col("c_custkey") % 15).cast("int").alias("status"),
    )


def folder_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner, purpose and policy given to some folders of `doc_folders`, at different depths."""
    folders = doc_folders(spark, sf_dir)
    depth = F.size(F.split("folder_path", "/")) - 1
    tail = F.regexp_extract("folder_path", r"(\d+)$", 1)
    return folders.select(
        "folder_path",
        F.when(depth == 1, F.concat(F.lit("owner"), tail)).when(
            F.col("folder_path").endswith("/de"), "owner_de"
        ).alias("owner"),
        F.when(depth == 2, F.concat(F.lit("purpose_"), F.substring_index("folder_path", "/", -1))).alias("purpose"),
        F.when(tail == "1", "archive").when(depth == 1, "standard").alias("policy"),
    ).where("owner is not null or purpose is not null or policy is not null")


def duplicate_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`order_files` under a second tree: every fourth order also as an exact copy one level down."""
    files = order_files(spark, sf_dir)
    order = F.regexp_extract("folder_path", r"o_(\d+)", 1).cast("bigint")
    folder = F.concat(F.lit("/copy"), "folder_path", F.lit("/sub"))
    copies = files.where(order % 4 == 0).withColumn(
        "path", F.concat(folder, F.lit("/"), F.substring_index("path", "/", -1))
    )
    copies = copies.withColumn("folder_path", folder).withColumn("root_path", F.concat(F.lit("/copy"), "root_path"))
    return files.unionByName(copies)


def clashing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_files` with every tenth path a second time in capitals."""
    files = doc_files(spark, sf_dir)
    doc_id = F.expr(DOC_ID)
    return files.unionByName(files.where(doc_id % 10 == 0).withColumn("path", F.upper("path")))


def messy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a path full of empty, '.' and '..' segments; every 11th is relative."""
    docs = table(spark, sf_dir, "documents")
    tail = F.element_at(
        F.array(*[F.lit(t) for t in ("/../x", "/", "/a/../../y/", "", "/../../../../z")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    rooted = F.concat(
        F.lit("/"), "source", F.lit("//"), F.upper("lang"), F.lit("/./b"), (F.col("doc_id") % 4).cast("string"), tail
    )
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("../"), F.substring(rooted, 2, 1000))).otherwise(rooted).alias("messy"),
    )


def folder_rows_with_status(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Folders and files with a status for the folder life cycle.

    Files are synced when hashed; language folders end in a marked state without children where
    the bucket below has been dropped.
    """
    synced = F.when(F.col("hash_value").isNotNull(), 7).otherwise(6).alias("status")
    files = doc_files(spark, sf_dir).select("path", "folder_path", synced)
    folders = doc_folders(spark, sf_dir)
    path = F.col("folder_path")
    status = (
        F.when(path.endswith("/b1"), 7).when(path.endswith("/b2"), 9).when(path.endswith("/b3"), 7).otherwise(6)
    )
    kept_files = files.where(~F.col("folder_path").endswith("/b2"))
    return folders.select("folder_path", "parent_path", status.alias("status")), kept_files


_trees: dict[tuple[str, str], str] = {}


#: The name of a document's file: some are hidden.
TREE_NAME = """concat(case when doc_id % 10 = 3 then '.' when doc_id % 10 = 7 then '_' else '' end, 'doc_', doc_id, '.txt')"""
TREE_FOLDER = "concat('/source=', source, '/lang=', lang, '/b=', doc_id % 4)"


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """A directory tree with one file per document below source/lang/bucket, some hidden and some empty.

    Written by tasks, once per session and input. A file holds the text and a newline, every ninth nothing.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trees or not path_exists(spark, _trees[key]):
        target = plain_path(fresh_dir(spark, "document-tree"))
        content = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat("text", F.lit("\n")))
        files = table(spark, sf_dir, "documents").select(
            F.concat(F.lit(target), F.expr(TREE_FOLDER), F.lit("/"), F.expr(TREE_NAME)).alias("path"), content.alias("content")
        )

        def write(rows):
            store = store_of(target)
            for path, text in rows:
                store.write(path, text.encode())

        # Creating files is the slow part, so it gets all cores whatever the input's row groups. Rows reach a worker in
        # batches of some megabytes; ten thousand texts at once would take the more memory the longer they are.
        dealt = files.repartition(spark.sparkContext.defaultParallelism, "path")
        dealt.rdd.foreachPartition(write)
        _trees[key] = target
    return _trees[key]
