import pytest
from pyspark.sql import functions as F

from filetwin.operators import skew

from .conftest import rows


@pytest.fixture
def tables(spark):
    """A third of all rows under one key, some null keys."""
    big = spark.range(3000).select(
        F.col("id").cast("string").alias("path"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
    )
    small = spark.range(40).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"),
        F.col("id").alias("value"),
    )
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(tables, how):
    big, small = tables
    plain = big.join(small, ["key"], how)
    salted = skew.lookup(big, small, ["key"], how, force_salt=True, hot_rows=20)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)


def test_several_rows_per_key_on_the_small_side(tables):
    big, small = tables
    twice = small.unionByName(small.withColumn("value", F.col("value") + 100))
    salted = skew.lookup(big, twice, ["key"], "inner", force_salt=True, hot_rows=20)
    assert rows(salted) == rows(big.join(twice, ["key"]))


def test_hot_rows_are_spread(tables):
    big, small = tables
    salted = skew.lookup(big, small, ["key"], "inner", force_salt=True, hot_rows=50, keep_salt=True)
    hot = salted.where("key = 'hot'").groupBy("_salt").count().collect()
    assert len(hot) == 20 and max(r["count"] for r in hot) < 150
    assert salted.where("key <> 'hot'").select("_salt").distinct().count() == 1


def test_every_hot_key_is_split(spark):
    big = spark.range(60_000).select((F.col("id") % 1500).alias("key"), F.col("id").alias("path"))
    counts = skew.key_counts(big, ["key"])
    assert skew.hot_keys(counts, ["key"], hot_rows=10).count() == 1500
    assert skew.hot_keys(counts, ["key"], hot_rows=41) is None
    small = spark.range(1500).select(F.col("id").alias("key"))
    salted = skew.lookup(big, small, ["key"], force_salt=True, hot_rows=10, keep_salt=True)
    largest = salted.groupBy("key", "_salt").count().agg(F.max("count")).first()[0]
    assert salted.count() == 60_000 and largest < 40


def test_many_null_keys_are_spread(spark):
    big = spark.range(500).select(F.lit(None).cast("long").alias("key"), F.col("id").alias("path"))
    small = spark.range(3).select(F.col("id").alias("key"), F.lit(1).alias("value"))
    salted = skew.lookup(big, small, ["key"], "left", force_salt=True, hot_rows=100, keep_salt=True)
    assert salted.count() == 500 and salted.select("_salt").distinct().count() > 100


def test_broadcast_depends_on_the_estimate(spark):
    small = spark.range(3)
    assert skew.fits_broadcast(small)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not skew.fits_broadcast(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_an_overrated_side_is_measured_and_broadcast(spark, tables):
    big, small = tables
    overrated = small.join(small.select(F.col("key").alias("k2")), F.col("key") == F.col("k2")).groupBy("key").agg(F.max("value").alias("value"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
        assert not skew.fits_broadcast(overrated)
        joined = skew.lookup(big, overrated, ["key"])
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
        assert rows(joined) == rows(big.join(small, ["key"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
