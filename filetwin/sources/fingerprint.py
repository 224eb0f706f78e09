"""Content digests by named algorithm, for columns and for files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running_sum
from ..schemas import ALGORITHMS, DEFAULT_ALGORITHM
from .listing import list_files
from .stores import store_of

BLOCK_BYTES = 1 << 20
TASK_BYTES = 1 << 30
#: What opening a file costs, in bytes read.
FILE_COST = 1 << 16
DIGEST_SCHEMA = "path string, hash_value string, hash_algorithm string, error_status string"

_python_names = {"sha256": "sha256", "sha512": "sha512", "sha3-256": "sha3_256"}


def check_algorithm(name: str) -> str:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {name!r}, expected one of {ALGORITHMS}")
    return name


@F.pandas_udf(T.StringType())
def _sha3_256(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else hashlib.sha3_256(data).hexdigest())


def digest(content: Column, algorithm: str = DEFAULT_ALGORITHM) -> Column:
    """Hex digest of a text or binary column. SHA-3 is the only one that leaves the JVM."""
    check_algorithm(algorithm)
    data = content.cast("binary")
    if algorithm == "sha256":
        return F.sha2(data, 256)
    if algorithm == "sha512":
        return F.sha2(data, 512)
    return _sha3_256(data)


def _digest_paths(algorithm: str, handle: Callable):
    def one(store, path: str) -> tuple[str | None, str | None]:
        state = hashlib.new(_python_names[algorithm])
        try:
            with store.open(path) as source:
                while block := source.read(BLOCK_BYTES):
                    state.update(block)
        except OSError as error:
            return None, str(error)
        return state.hexdigest(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = None
        for batch in batches:
            store = store or (handle(batch["path"].iloc[0]) if len(batch) else None)
            found = [one(store, path) for path in batch["path"]]
            hashes = [h for h, _ in found]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "hash_value": hashes,
                    "hash_algorithm": [algorithm if h else None for h in hashes],
                    "error_status": [e for _, e in found],
                }
            )

    return run


def dealt_by_bytes(listing: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path), partitioned so that a task has files of about `task_bytes` bytes to read, or one longer file.

    Files are cut into tasks by the running sum of their sizes in the order of a hash, so the long files of a folder
    are not neighbours; opening a file counts like reading FILE_COST bytes. The number of tasks follows from the bytes.
    """
    size = F.coalesce(F.col("size"), F.lit(0)) if "size" in listing.columns else F.lit(0)
    costs = listing.select("path", (size + FILE_COST).cast("bigint").alias("cost"))
    placed = running_sum(costs, [F.xxhash64("path"), F.col("path")], "cost", "before", "files-by-bytes")
    placed = placed.select("path", F.expr(f"before div {task_bytes}").cast("int").alias("task"))
    tasks = placed.agg(F.max("task")).first()[0]
    return placed.repartitionById((tasks or 0) + 1, F.col("task")).select("path")


def fingerprint_files(
    listing: DataFrame,
    algorithm: str = DEFAULT_ALGORITHM,
    task_bytes: int = TASK_BYTES,
    handle: Callable = store_of,
) -> DataFrame:
    """Digest of each listed file: path, hash_value, hash_algorithm, error_status.

    Files are read block by block where the task runs, so size does not matter, and through the handle of their
    store; a file that cannot be read keeps its row with the error. `listing` has `path` and, for even tasks, `size`.
    """
    check_algorithm(algorithm)
    return dealt_by_bytes(listing, task_bytes).mapInPandas(_digest_paths(algorithm, handle), DIGEST_SCHEMA)


def fingerprint_tree(
    spark: SparkSession, root: str, algorithm: str = DEFAULT_ALGORITHM, handle: Callable = store_of, **walk
) -> DataFrame:
    """Digests of all files below `root`, listed by `walk_tree` and read by `fingerprint_files`."""
    return fingerprint_files(list_files(spark, root, handle=handle, **walk), algorithm, handle=handle)
