"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: ASCII white space that separates words in the queries' contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: What a batch of rows holds at most (or one row), between the JVM and Python. Both sides keep a batch several times over.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Returns freed memory to the system: a Python worker that waits for its next task would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A `mapInArrow` function that gives its memory back at the end of each task."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def arrow_runs(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with `run`, tidied, over batches of bounded bytes: ten thousand texts at once would take the more the longer they are.

    The session's bound is lowered, never raised, and stays so, as it counts when the result is planned.
    """
    conf = df.sparkSession.conf
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(tidy(run), schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str):
    """`mapInArrow` with a batch function that `make` builds once per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return arrow_runs(df, run, schema)


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, unchanged."""
    if not text:
        return []
    # str.split() would also split at other Unicode white space, which belongs to a word here.
    for space in "\t\n\x0b\x0c\r":
        if space in text:
            text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of `width` consecutive values."""
    count = len(values) - width + 1
    out = values[:count].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += values[k : k + count]
    return mix(out)


_KEY_BITS = 1 << 24


def key_bits(rows: DataFrame, key: str) -> DataFrame:
    """One row, `bits`: a bitmap of the keys' hashes, as longs, whose size does not grow with the keys."""
    place = F.xxhash64(key).bitwiseAND(F.lit(_KEY_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    held = rows.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(one).alias("own"))
    longs = rows.sparkSession.range(_KEY_BITS // 64).join(held, "id", "left")
    longs = longs.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("own", F.lit(0)).alias("own")))).alias("all"))
    return materialize(longs.select(F.transform("all", lambda x: x["own"]).alias("bits")), "key-bits")


def may_hold(bits: DataFrame, key: str) -> Column:
    """Whether a row's key may be among those of `key_bits`; never false for one that is."""
    place = F.xxhash64(key).bitwiseAND(F.lit(_KEY_BITS - 1))
    long = F.get(bits.scalar(), F.shiftright(place, 6).cast("int"))
    own = F.call_function("shiftright", long, place.bitwiseAND(F.lit(63)).cast("int"))
    return own.bitwiseAND(F.lit(1)) == 1


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text, reduced; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def key_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, of batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        change = np.zeros(table.num_rows - 1, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for begin, end in zip(starts, starts[1:], strict=False):
            yield table.slice(begin, end - begin)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest
