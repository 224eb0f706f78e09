"""Hashing a listing as a stream, so that an interrupted scan goes on where it stopped.

The stream's input files are the listing's Parquet files; the driver remembers those, not the
listed paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import active_scan
from ..operators.mutate import scan_state
from ..schemas import DEFAULT_ALGORITHM, LISTING, SCAN_EVENTS
from ..session import fresh_dir, path_exists, run_id
from ..sources.fingerprint import DIGEST_SCHEMA, fingerprint_files


def write_listing(
    listing: DataFrame, listing_dir: str, files: int | None = None, rows_per_file: int = 1_000_000
) -> None:
    """A listing as Parquet files, the steps in which a scan makes progress."""
    rows = listing.select(*LISTING.fieldNames())
    if files:
        rows = rows.repartition(files, "path")
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(listing_dir)


def resumable_scan(
    spark: SparkSession,
    listing_dir: str,
    out_dir: str,
    checkpoint_dir: str | None = None,
    algorithm: str = DEFAULT_ALGORITHM,
    files_per_step: int = 16,
    on_step: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Hashes the listing step by step; the same checkpoint goes on, a new one starts afresh.

    A step that was interrupted runs again and overwrites its own directory. `on_step` is called with the listing and the
    number of each step whose digests are written; it may be called again for the last one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fingerprint_files(batch, algorithm).write.mode("overwrite").parquet(f"{out_dir}/run={run}/batch={batch_id}")
        if on_step is not None:
            on_step(batch, batch_id)

    checkpoint_dir = checkpoint_dir or fresh_dir(spark, "scan-checkpoint")
    run = run_id(spark, checkpoint_dir)
    return (
        spark.readStream.schema(LISTING)
        .option("maxFilesPerTrigger", files_per_step)
        .parquet(listing_dir)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def scanned_digests(spark: SparkSession, out_dir: str) -> DataFrame:
    """Digests of all finished steps of the newest run: one per listed path, however often a scan began anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [status.getPath().getName() for status in store.listStatus(path)] if store.exists(path) else []
    runs = sorted(name for name in names if name.startswith("run="))
    if not runs:
        return spark.createDataFrame([], DIGEST_SCHEMA)
    return spark.read.schema(DIGEST_SCHEMA).parquet(f"{out_dir}/{runs[-1]}").drop("batch")


def scan_events(spark: SparkSession, out_dir: str) -> DataFrame:
    """The log of all scans that `logged_scan` ran into `out_dir`, as `scan_state` takes it."""
    if not path_exists(spark, f"{out_dir}/log"):
        return spark.createDataFrame([], SCAN_EVENTS)
    return spark.read.schema(SCAN_EVENTS).parquet(f"{out_dir}/log/scan=*/event=*")


def _record(rows: DataFrame, out_dir: str, scan_id: int, event: str) -> None:
    """One event in a folder of its own: writing it again changes nothing."""
    rows.select(*SCAN_EVENTS.fieldNames()).coalesce(1).write.mode("overwrite").parquet(
        f"{out_dir}/log/scan={scan_id}/event={event}"
    )


def _event(spark: SparkSession, out_dir: str, scan_id: int, root_path: str, mode: str, event: str, at: int, seq: int) -> None:
    row = (scan_id, root_path, mode, event, None, None, at, seq)
    _record(spark.createDataFrame([row], SCAN_EVENTS), out_dir, scan_id, event)


_LAST = 1 << 40


def logged_scan(
    spark: SparkSession,
    listing_dir: str,
    out_dir: str,
    root_path: str,
    now: int,
    restart: bool = False,
    algorithm: str = DEFAULT_ALGORITHM,
    files_per_step: int = 16,
) -> StreamingQuery:
    """`resumable_scan` of one root with its progress in the scan log.

    The log tells whether the root has an unfinished scan: if so, that one goes on where it stopped, with its own checkpoint, unless
    `restart` clears it. Each finished step adds a `save` event with the last path in it and its folder, so `active_scan`
    shows where the scan stands. `complete_scan` ends it.
    """
    events = scan_events(spark, out_dir)
    running = active_scan(scan_state(events)).where(F.col("root_path") == root_path).first()
    if running is not None and restart:
        _event(spark, out_dir, running["scan_id"], root_path, "files", "clear", now, _LAST)
        running = None
    if running is not None:
        scan_id = running["scan_id"]
    else:
        scan_id = (events.agg(F.max("scan_id")).first()[0] or 0) + 1
        _event(spark, out_dir, scan_id, root_path, "files", "start", now, 0)

    def save(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.max(F.struct("path", "folder_path")).alias("last")).where("last is not null")
        told = last.select(
            F.lit(scan_id).cast("bigint").alias("scan_id"),
            F.lit(root_path).alias("root_path"),
            F.lit("files").alias("scan_mode"),
            F.lit("save").alias("event"),
            F.col("last.folder_path").alias("folder_path"),
            F.col("last.path").alias("file_path"),
            F.lit(now).cast("bigint").alias("at"),
            F.lit(batch_id + 1).cast("bigint").alias("seq"),
        )
        _record(told, out_dir, scan_id, f"save-{batch_id}")

    checkpoint = f"{out_dir}/checkpoint/scan={scan_id}"
    return resumable_scan(spark, listing_dir, out_dir, checkpoint, algorithm, files_per_step, on_step=save)


def complete_scan(spark: SparkSession, out_dir: str, root_path: str, now: int) -> bool:
    """Marks the root's unfinished scan complete; False if there is none."""
    running = active_scan(scan_state(scan_events(spark, out_dir))).where(F.col("root_path") == root_path).first()
    if running is None:
        return False
    _event(spark, out_dir, running["scan_id"], root_path, running["scan_mode"], "complete", now, _LAST)
    return True
