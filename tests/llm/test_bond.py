import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.llm import bond
from leafcast.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=5, n_pos=5, n_neg=3):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= bond.LIMIT for x in v):
            continue
        kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for j, other, w in kept if j != i)
        for minus, j, same in [s for s in scored if s[2]][:n_pos]:
            fit = [(n, k) for n, k, s in scored if not s and 50 * -minus <= 100 * -n <= 95 * -minus]
            out += [(i, j, rank, k, -minus, -n) for rank, (n, k) in enumerate(fit[:n_neg], 1)]
    return sorted(out)


def results(spark, rows, every=5, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in bond.hard_negatives(df, F.col("vec_id") % every == 0).collect())


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    return (out / np.linalg.norm(out, axis=1)[:, None]).astype(np.float32).tolist()


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bond, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(i, rng.randrange(4), v) for i, v in enumerate(vectors(260, 19, block, 0.6))]
    got = results(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_common_vector_ties_and_copies_of_a_label(spark, monkeypatch):
    monkeypatch.setattr(bond, "BLOCK_ROWS", 40)
    some = vectors(120, 8, 3)
    rows = [(i, 1, some[0]) for i in range(100, 220)] + [(i, i % 3, some[i]) for i in range(100)] + [(i, 2, [x * 0.8 for x in some[0]]) for i in range(300, 340)]
    assert results(spark, rows, 10) == brute(rows, 10)


def test_rows_that_take_no_part_and_uneven_lengths(spark):
    good = vectors(40, 6, 9)
    rows = [(i, i % 2, v) for i, v in enumerate(good)] + [
        (50, None, good[0]), (55, 1, None), (60, 0, [None] + good[1][1:]), (65, 1, [float("nan")] * 6), (70, 0, [float("inf")] + good[2][1:]),
        (None, 1, good[3]), (75, 0, [5000.0] * 6), (80, 0, []), (85, 1, good[4][:2]), (90, 0, good[5] + [0.5, -0.5]), (91, 1, [-x for x in good[0]]),
    ]
    assert results(spark, rows) == brute(rows)


def test_repeated_ids_are_not_each_others_partners(spark):
    some = vectors(30, 5, 4)
    rows = [(i, i % 2, v) for i, v in enumerate(some)] + [(10, 0, some[10]), (7, 1, some[3])]
    got = results(spark, rows)
    assert got == brute(rows) and all(a != p and a != n for a, p, _, n, *_ in got)


def test_few_rows_no_rows_and_clashing_columns(spark):
    assert results(spark, []) == []
    assert results(spark, [(5, 1, [1.0])]) == []
    wide = spark.createDataFrame([(5, 1, [1.0], 9, "r"), (6, 1, [0.5], 9, "r"), (7, 2, [0.4], 9, "r")], SCHEMA + ", row int, slot string")
    assert [tuple(r) for r in bond.hard_negatives(wide, F.col("vec_id") % 5 == 0).collect()] == [(5, 6, 1, 7, 256 * 128, 256 * 102)]


def test_long_vectors_are_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-bond.LIMIT + 1, bond.LIMIT, (9, bond.MAX_DIMS))
    block = bond.Block(np.arange(9), np.zeros(9, np.int64), np.full(9, bond.MAX_DIMS), v.reshape(-1).astype(np.int32))
    ids, scores = block.positives(v[0].astype(float), 0, 0, 5)
    exact = sorted(((-sum(int(a) * int(b) for a, b in zip(v[0], w, strict=True)), j) for j, w in enumerate(v) if j), key=lambda s: s)[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == exact


def test_bounds_shrink_the_bitmap():
    """Most candidates leave before all columns are read, where magnitudes differ."""
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(2000, 64)) * np.exp(-np.arange(64) / 6)).astype(np.int32)
    block = bond.Block(np.arange(2000), np.zeros(2000, np.int64), np.full(2000, 64), v.reshape(-1))
    left = []

    def stays(low, high):
        keep = high >= bond._nth(low, 5)
        left.append(int(keep.sum()))
        return keep

    block.scan(v[0].astype(float), np.ones(2000, bool), stays)
    assert left == sorted(left, reverse=True) and left[2] < 1000


def test_query_returns_whole_groups(spark):
    got = QUERIES["op11_bond_hard_negatives"](spark, SMALL).collect()
    assert got and max(r["rank"] for r in got) <= 3
