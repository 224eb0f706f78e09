"""Joins that keep one hot key from landing in one task.

Every key with at least `hot_rows` rows is hot. Hot keys are a written table, broadcast if its size
allows it and joined like any other table if not; there are at most rows / `hot_rows` of them. No key, however
frequent, puts more than about `hot_rows` rows into one salt. Null keys match nothing and are
spread when they are as many. The rows of a hot key are
spread over salts and the other side's rows for it are repeated once per salt. Without hot keys the
join is an ordinary one.

Whether the other side is broadcast instead is decided by its size. Catalyst's estimate of a
filtered or grouped table is far above its true size, so such a side is written first and its
measured size counts: a large table is not shuffled only because a small one was overrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

NULL_SALTS = 1000
HOT_ROWS = 1_000_000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate, the one its broadcast decision uses."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark will broadcast `df` under the session's threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= limit


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; map-side partial counts keep a hot key cheap."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """The hot keys with the number of salts each gets (`_salts`), or None when there are none."""
    hot_rows = hot_rows or HOT_ROWS
    salts = F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts")
    found = materialize(counts.where(F.col("n") >= hot_rows).select(*keys, salts), "hot-keys")
    return None if found.isEmpty() else found


def _salt(spread: str | Column, salts: Column) -> Column:
    return F.pmod(F.xxhash64(spread), salts).cast("int")


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: str | Column = "path",
    counts: DataFrame | None = None,
    keep_salt: bool = False,
    hot_rows: int | None = None,
    force_salt: bool = False,
    measure: bool = True,
) -> DataFrame:
    """`big` joined to `small` on `keys` (`inner`, `left`, `left_semi` or `left_anti`).

    When Spark will broadcast `small`, `big` is not shuffled and no key can be hot; `measure=False`
    takes the estimate of `small` as its size, for plain tables. Beyond that size the hot keys of
    `big` are salted by `spread`. `counts` may hand over existing rows per key
    (columns `keys` and `n`) of `big` or of a superset of it. With `keep_salt` the result has the
    column `_salt`, a function of the keys and `spread`, so that a later grouping by keys, `_salt`
    and `spread` needs no further shuffle.
    """
    hot = None
    fits = not force_salt and fits_broadcast(small)
    if not fits and not force_salt and measure:
        small = materialize(small, "join-side")
        fits = fits_broadcast(small)
    if not fits:
        hot = hot_keys(counts if counts is not None else key_counts(big, keys), keys, hot_rows)
    if hot is None:
        joined = big.join(small, keys, how)
        return joined.withColumn("_salt", F.lit(0)) if keep_salt else joined

    side = F.broadcast(hot) if fits_broadcast(hot) else hot
    unmatched = F.lit(False)
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    salt = (
        F.when(unmatched, _salt(spread, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), _salt(spread, F.col("_salts")))
        .otherwise(F.lit(0))
    )
    salted_big = big.join(side, keys, "left").withColumn("_salt", salt).drop("_salts")
    every_salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    salted_small = small.join(side, keys, "left").withColumn("_salt", every_salt).drop("_salts")
    joined = salted_big.join(salted_small, [*keys, "_salt"], how)
    return joined if keep_salt else joined.drop("_salt")
