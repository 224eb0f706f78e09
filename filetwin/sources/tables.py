"""Durable catalog tables: Parquet, one directory per version, the newest complete one is read.

A version is partitioned by a bounded number of hash buckets of the root. A whole new table is a new
version; a change of some roots is Spark's dynamic partition overwrite of their buckets in the newest one, so that
the files of all other roots stay as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import fresh_dir, path_exists

TABLES = {
    "roots": (schemas.ROOTS, ["root_path"]),
    "folders": (schemas.FOLDERS, ["root_path", "folder_path"]),
    "files": (schemas.FILES, ["root_path", "path"]),
    "scans": (schemas.SCANS, ["root_path", "scan_id"]),
    "agents": (schemas.AGENTS, ["name", "guid"]),
    "scan_events": (schemas.SCAN_EVENTS, ["root_path", "scan_id", "at", "seq"]),
}
BUCKETS = 64
_BUCKET = "bucket"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def versions(spark: SparkSession, base: str, name: str) -> list[int]:
    """Numbers of the completely written versions of a table."""
    store, path = _store(spark, f"{base}/{name}")
    if not store.exists(path):
        return []
    found = []
    for status in store.listStatus(path):
        folder = status.getPath()
        done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        if folder.getName().startswith("v") and store.exists(done):
            found.append(int(folder.getName()[1:]))
    return sorted(found)


def bucket_of(name: str) -> Column:
    """The bucket of a row of a table: by its root, of an agent by its name."""
    return F.pmod(F.xxhash64(TABLES[name][1][0]), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, name: str) -> list[int]:
    """The buckets that `rows` of a table (or just its first key column) lie in, at most BUCKETS."""
    return sorted(r[0] for r in rows.select(bucket_of(name)).distinct().collect())


def _laid_out(df: DataFrame, name: str) -> DataFrame:
    """Neighbouring paths in a file, so statistics skip others, and a root with very many rows over many files."""
    schema, order = TABLES[name]
    rows = df.select(*schema.fieldNames(), bucket_of(name).alias(_BUCKET))
    return rows.repartitionByRange(_BUCKET, *order).sortWithinPartitions(_BUCKET, *order)


def write_table(df: DataFrame, base: str, name: str) -> int:
    """Writes the next version of a table and returns its number.

    A number is claimed by a file that only one writer can create; the others take later ones.
    """
    spark = df.sparkSession
    number = max(versions(spark, base, name), default=0) + 1
    while path_exists(spark, f"{base}/{name}/v{number:06d}") or not _claimed(spark, f"{base}/{name}/v{number:06d}"):
        number += 1
    _laid_out(df, name).write.partitionBy(_BUCKET).mode("append").parquet(f"{base}/{name}/v{number:06d}")
    return number


def _claimed(spark: SparkSession, folder: str) -> bool:
    store, path = _store(spark, f"{folder}/_claim")
    return store.createNewFile(path)


def replace_buckets(df: DataFrame, base: str, name: str, buckets: list[int], note: dict | None = None) -> None:
    """The given buckets of the newest version become the rows of `df`; all other files stay.

    The rows, which may come from the table itself, are written aside first. What is to be done is noted in the
    version until it is done, so that the next reader or writer finishes what a lost driver began. One writer at a time.
    """
    spark = df.sparkSession
    if not versions(spark, base, name):
        write_table(df.limit(0), base, name)
    version = f"{base}/{name}/v{versions(spark, base, name)[-1]:06d}"
    aside = fresh_dir(spark, f"{name}-change")
    _laid_out(df, name).write.partitionBy(_BUCKET).parquet(aside)
    _write_note(spark, f"{version}/_pending", {"aside": aside, "buckets": buckets, "note": note})
    _finish(spark, version, name)


def replace_roots(df: DataFrame, base: str, name: str, roots: list[str]) -> None:
    """The rows of the given roots become those of `df`; only the files of their buckets are written anew."""
    spark = df.sparkSession
    key = TABLES[name][1][0]
    buckets = buckets_of(spark.createDataFrame([(r,) for r in roots], f"{key} string"), name) if roots else []
    if buckets:
        others = read_table(spark, base, name, buckets=buckets).where(~F.col(key).isin(roots))
        replace_buckets(others.unionByName(df.select(*others.columns)), base, name, buckets)


def _write_note(spark: SparkSession, file: str, note: dict) -> None:
    store, path = _store(spark, file)
    out = store.create(path, True)
    out.write(json.dumps(note).encode())
    out.close()


def _read_note(spark: SparkSession, file: str) -> dict | None:
    store, path = _store(spark, file)
    if not store.exists(path):
        return None
    source = store.open(path)
    text = bytes(source.readAllBytes()).decode()
    source.close()
    return json.loads(text) if text else None


def _finish(spark: SparkSession, version: str, name: str) -> None:
    """Carries out a noted change; doing so twice changes nothing."""
    pending = _read_note(spark, f"{version}/_pending")
    if pending is None:
        return
    schema, _ = TABLES[name]
    held = {
        int(status.getPath().getName().removeprefix(f"{_BUCKET}="))
        for status in _children(spark, pending["aside"])
        if status.getPath().getName().startswith(f"{_BUCKET}=")
    }
    if held:
        rows = spark.read.schema(schema).parquet(pending["aside"])
        writer = _laid_out(rows, name).write.partitionBy(_BUCKET).option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(version)
    for bucket in set(pending["buckets"]) - held:
        store, path = _store(spark, f"{version}/{_BUCKET}={bucket}")
        store.delete(path, True)
    if pending["note"] is not None:
        _write_note(spark, f"{version}/_note", pending["note"])
    store, path = _store(spark, f"{version}/_pending")
    store.delete(path, False)


def table_note(spark: SparkSession, base: str, name: str) -> dict | None:
    """The note of the last change of the newest version, if that change had one."""
    known = versions(spark, base, name)
    if not known:
        return None
    version = f"{base}/{name}/v{known[-1]:06d}"
    _finish(spark, version, name)
    return _read_note(spark, f"{version}/_note")


def read_table(
    spark: SparkSession,
    base: str,
    name: str,
    version: int | None = None,
    roots: list[str] | None = None,
    buckets: list[int] | None = None,
) -> DataFrame:
    """The newest version of a table, or the given one; an empty table when there is none.

    With `roots` only their rows and with `buckets` only those, without a look at other files.
    """
    schema, order = TABLES[name]
    known = versions(spark, base, name)
    if version is None and not known:
        return spark.createDataFrame([], schema)
    chosen = known[-1] if version is None else version
    if chosen not in known:
        raise ValueError(f"table {name} has no version {chosen}")
    folder = f"{base}/{name}/v{chosen:06d}"
    _finish(spark, folder, name)
    if not any(s.getPath().getName().startswith(f"{_BUCKET}=") for s in _children(spark, folder)):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    if roots is not None:
        within = buckets_of(spark.createDataFrame([(r,) for r in roots], f"{order[0]} string"), name) if roots else []
        rows = rows.where(F.col(_BUCKET).isin(within) & F.col(order[0]).isin(roots))
    if buckets is not None:
        rows = rows.where(F.col(_BUCKET).isin(buckets))
    return rows.select(*schema.fieldNames())


def _children(spark: SparkSession, folder: str):
    store, path = _store(spark, folder)
    return store.listStatus(path)
