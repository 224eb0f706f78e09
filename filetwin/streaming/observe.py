"""Continuous folding of file observations into one row per path, and into the catalog.

Each micro-batch is reduced to one partial row per path and written as a batch directory; reading
folds the partial rows. Minimum, maximum and newest are associative, so late observations need no
watermark, a replayed batch overwrites its own directory (each checkpoint has a run of its own), and no batch rewrites the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import parent_of
from ..operators.mutate import merge
from ..schemas import DEFAULT_ALGORITHM, FILES
from ..session import materialize, run_id
from ..sources import tables

PARTIAL_SCHEMA = (
    "path string, first_seen bigint, last_seen bigint, "
    "newest struct<ts: bigint, seq: bigint, root_path: string, size: bigint, hash_value: string>"
)


def partial_rows(observations: DataFrame) -> DataFrame:
    """One row per path of a batch: first and last time and the newest observation."""
    newest = F.struct("ts", "seq", "root_path", "size", "hash_value")
    return observations.groupBy("path").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(newest).alias("newest")
    )


def fold(partials: DataFrame) -> DataFrame:
    """Current rows from partial rows of any number of batches."""
    return (
        partials.groupBy("path")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("newest").alias("_n"))
        .select("path", "_n.root_path", "_n.size", "_n.hash_value", "first_seen", "last_seen")
    )


def observe_stream(stream: DataFrame, out_dir: str, checkpoint_dir: str, **trigger) -> StreamingQuery:
    """Starts folding a stream of observations; by default it stops when all input is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_rows(batch).write.mode("overwrite").parquet(f"{out_dir}/run={run}/batch={batch_id}")

    run = run_id(stream.sparkSession, checkpoint_dir)
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def observed_files(spark: SparkSession, *out_dirs: str) -> DataFrame:
    """The catalog rows folded from one or more batch directories."""
    parts = [spark.read.schema(PARTIAL_SCHEMA).parquet(d).select("path", "first_seen", "last_seen", "newest") for d in out_dirs]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return fold(whole)


def compact(spark: SparkSession, out_dirs: list[str], target: str) -> None:
    """Rewrites batch directories of stopped streams as one partial row per path."""
    whole = spark.read.schema(PARTIAL_SCHEMA).parquet(*[f"{d}/run=*/batch=*" for d in out_dirs])
    merged = whole.groupBy("path").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("newest").alias("newest")
    )
    merged.write.mode("overwrite").parquet(f"{target}/run=compact/batch=0")


#: What an observation may tell beyond its path, size and hash, and what holds if it does not.
OPTIONAL = ("mtime", "hash_algorithm", "error_status")


def observed_rows(observations: DataFrame, algorithm: str = DEFAULT_ALGORITHM) -> DataFrame:
    """Observations as `files` rows, one per path: first and last time seen, all else from the newest one.

    An observation without `mtime` takes its own time for it, one with a hash but without `hash_algorithm` the given algorithm.
    Equal times are ordered by `seq`. Rows without path or time are left out; they cannot be filed.
    """
    null = F.lit(None).cast("string")
    given = {name: F.col(name) if name in observations.columns else null for name in OPTIONAL}
    told = observations.where(F.col("path").isNotNull() & F.col("ts").isNotNull()).select(
        "path",
        F.col("ts").cast("bigint").alias("ts"),
        F.struct(
            F.col("ts").cast("bigint").alias("ts"),
            "seq",
            "root_path",
            F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"),
            F.coalesce(given["mtime"].cast("bigint"), F.col("ts").cast("bigint")).alias("mtime"),
            "hash_value",
            F.when(F.col("hash_value").isNotNull(), F.coalesce(given["hash_algorithm"], F.lit(algorithm))).alias("algorithm"),
            given["error_status"].alias("error"),
        ).alias("row"),
    )
    newest = told.groupBy("path").agg(F.min("ts").alias("first"), F.max("row").alias("n"))
    folder = parent_of("path")
    return newest.select(
        "path",
        F.col("n.size").alias("size"),
        F.col("n.mtime").alias("mtime"),
        F.col("n.hash_value").alias("hash_value"),
        F.col("n.algorithm").alias("hash_algorithm"),
        F.col("n.error").alias("error_status"),
        F.col("first").alias("first_scanned_at"),
        F.col("n.ts").alias("last_scanned_at"),
        F.lit(0).alias("removed"),
        F.coalesce(folder, F.lit("/")).alias("folder_path"),
        F.col("n.root_path").alias("root_path"),
    ).select(*FILES.fieldNames())


def merge_observed(files: DataFrame, observed: DataFrame, **options) -> DataFrame:
    """`files` with `observed_rows` merged in by time.

    The first time is the earlier one; the row that was seen last gives all other fields, and a file seen since it was
    removed is live again. So observations may come late, and merging the same ones again changes nothing.
    """

    def rule(exists, arrives):
        newer = arrives & (~exists | (F.col("n_last_scanned_at") >= F.col("last_scanned_at")))
        first = F.least("first_scanned_at", "n_first_scanned_at")
        taken = {
            name: F.when(newer, F.col(f"n_{name}")).otherwise(F.col(name))
            for name in files.columns
            if name not in ("path", "first_scanned_at")
        }
        return {**taken, "first_scanned_at": first}

    return merge(files, observed, ["path"], rule, **options)


def observe_catalog(
    stream: DataFrame, base: str, checkpoint_dir: str, algorithm: str = DEFAULT_ALGORITHM, **trigger
) -> StreamingQuery:
    """Merges a stream of observations into the catalog's `files` table.

    A micro-batch reads and writes only the buckets of the roots it has seen. The stream's run and the batch's number
    are written with the change, so a batch that is replayed after a restart is applied once. Batches should be as large as
    freshness allows: each one rewrites the buckets it touches. A path belongs to one root.
    """
    spark = stream.sparkSession
    run = run_id(spark, checkpoint_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        note = tables.table_note(spark, base, "files") or {}
        if note.get("run") == run and note["batch"] >= batch_id:
            return
        observed = materialize(observed_rows(batch, algorithm), "observed-rows")
        buckets = tables.buckets_of(observed, "files")
        if buckets:
            old = tables.read_table(spark, base, "files", buckets=buckets)
            merged = merge_observed(old, observed)
            tables.replace_buckets(merged, base, "files", buckets, {"run": run, "batch": batch_id})

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
