import random

from pyspark.sql import functions as F

from leafcast.llm import common


def test_components_of_stars_and_chains(spark):
    """Centres with thousands of links and a chain, against union-find; heavy keys dealt and joined with and without a broadcast."""
    rng = random.Random(4)
    links = [(5, 10_000 + i) for i in range(3000)] + [(10_000 + i, 7) for i in range(2900, 3100)] + [(50_000 + i, 50_001 + i) for i in range(300)]
    links += [(rng.randrange(60_000, 60_400), rng.randrange(60_000, 60_400)) for _ in range(150)] + [(9, 9), (5, 10_000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    want = {n: find(n) for n in parent}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in common.components(df).collect()} == want


def test_heavy_keys_are_dealt_evenly(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 7 * (F.col("id") < 500).cast("int")).alias("k"), "id")
    table = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for bound in (common.BROADCAST_KEYS, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", bound)
        heavy = common.heavy_keys(rows, "k")
        parts = common.dealt(rows, heavy, "k")
        assert parts.groupBy("k", "part").count().agg(F.max("count")).first()[0] < 2 * common.PART_ROWS
        joined = parts.join(common.copied(table, heavy, "k"), ["k", "part"])
        assert joined.count() == 5000 and joined.where("x <> k * 10").count() == 0
