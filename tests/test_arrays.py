import random
import time

import pytest
from pyspark.sql import functions as F

from leafcast.functions import arrays

SIZES = [0, 1, 2, 3, 4, 5, 9, 10, 16, 17, 99, 100, 101, 1000]


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(n, [rng.randrange(-9, 9) for _ in range(n)]) for n in SIZES]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    got = df.select("v", arrays.running_sums(F.col("v")).alias("sums"), arrays.running(F.col("v"), F.lit(0), F.greatest, "int").alias("most")).collect()
    for r in got:
        assert r.sums == [sum(r.v[:i]) for i in range(len(r.v))]
        assert r.most == [max([0, *r.v[:i]]) for i in range(len(r.v))]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 1000])
def test_n_below(spark, n):
    rng = random.Random(n)
    values = sorted(rng.randrange(50) for _ in range(n))
    df = spark.createDataFrame([(values, x) for x in range(-1, 52)], "v array<int>, x int")
    assert all(r.k == sum(v < r.x for v in values) for r in df.select("x", arrays.n_below(F.col("v"), F.col("x")).alias("k")).collect())


def test_pieces_and_spans(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab é\n😀") for _ in range(2000))
    edges = sorted(rng.sample(range(2001), 60) + [0, 256, 512, 2000])
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    df = spark.createDataFrame([(text, spans), ("", []), ("abc", [(0, 3)]), ("abc", [])], "t string, s array<struct<start:int,end:int>>")
    got = [r.out for r in df.select(arrays.without_spans(F.col("t"), F.col("s")).alias("out")).collect()]
    want, at = "", 0
    for a, b in spans:
        want, at = want + text[at:a], b
    assert got == [want + text[at:], "", "", "abc"]


def test_long_arrays_take_seconds(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.col("id") + 200_000).alias("v"))
    began = time.time()
    assert df.select(F.element_at(arrays.running_sums(F.col("v")), -1)).first()[0] == sum(range(200_000))
    assert time.time() - began < 20
