"""Hubs of tiles, and what of the members is shuffled for them."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from filetwin.llm.jaccard import _hub_pairs


def members(spark, rows):
    return spark.createDataFrame(rows, "tokens array<long>, doc_id long, band int").repartition(5)


def test_members_meet_the_smallest_of_their_band_and_of_the_band_below(spark):
    dice = random.Random(3)
    rows = [([t for t in range(-20, 20) if dice.random() < 0.5], dice.randrange(10**6), dice.randrange(4)) for _ in range(150)]
    rows += [([1, 2], 7, 1), ([1, 2], 7, 2)]  # an id in two bands
    tiles = defaultdict(set)
    for tokens, doc_id, band in rows:
        for token in tokens:
            tiles[token, band].add(doc_id)
    wanted = set()
    for (token, band), ids in tiles.items():
        for hub in [min(tiles[token, b]) for b in (band, band - 1) if (token, b) in tiles]:
            wanted |= {(min(hub, x), max(hub, x)) for x in ids if x != hub}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (10_000, 7):  # tiles that are cut by batches too
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = [tuple(r) for r in _hub_pairs(members(spark, rows)).select("a", "b").collect()]
            assert len(found) == len(set(found)) and set(found) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_members_are_shuffled_once_for_their_hubs(spark):
    sets = members(spark, [([1, 2], 5, 1), ([1], 6, 1)])
    plan = _hub_pairs(sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1
    assert _hub_pairs(sets).where(F.col("a") == 5).count() == 1
