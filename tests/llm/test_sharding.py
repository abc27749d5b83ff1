from collections import defaultdict

import pytest

from conftest import SMALL
from leafcast.llm import sharding as sh
from leafcast.llm.queries import QUERIES, SHARD_BYTES


def split_one_by_one(rows, limit):
    """Extendible hashing by its own rules: an oversized bucket splits on the next bit. rows: (bits, size)."""
    done, todo = {}, [(0, 0, rows)]
    while todo:
        depth, prefix, members = todo.pop()
        if not members:
            continue
        total = sum(s for _, s in members)
        if total <= limit or depth == sh.BITS:
            done[depth, prefix] = total
            continue
        for bit in (0, 1):
            todo.append((depth + 1, 2 * prefix + bit, [(b, s) for b, s in members if b >> (sh.BITS - depth - 1) & 1 == bit]))
    return done


@pytest.mark.parametrize("limit", [1, 37, 200, 5000, 10**9])
def test_shards_equal_splitting_bit_by_bit(spark, limit):
    rows = [(i, "x" * (i * 37 % 61)) for i in range(500)] + [(None, None), (None, "n"), (7, ""), (7, None), (999, "y" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [(r.b, len(r.text or "")) for r in df.select(sh.hash_bits(df.doc_id, df.text).alias("b"), "text").collect()]
    got = sh.assign_shards(df, limit).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    want = split_one_by_one([(b, s) for b, s in bits if s <= limit], limit)
    small = {(r.depth, r.prefix): r.shard_bytes for r in got if r.n_bytes <= limit}
    assert small == want
    assert all(r.shard_bytes == r.n_bytes and r.depth == sh.BITS for r in got if r.n_bytes > limit)


def test_equal_rows_over_the_limit_are_cut_by_number(spark):
    rows = [(5, "abcdefghij")] * 1000 + [(i, "zz") for i in range(100, 150)]
    got = sh.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 95).collect()
    shards = defaultdict(int)
    for r in got:
        shards[r.depth, r.prefix, r.part] += r.n_bytes
    assert len(got) == 1050 and max(shards.values()) <= 95
    assert {(r.depth, r.prefix, r.part): r.shard_bytes for r in got} == dict(shards)
    assert sum(p > 0 or d == sh.BITS for d, _, p in shards) >= 112


def test_query_fits_and_empty_table(spark):
    got = QUERIES["op8_extendible_hash_shards"](spark, SMALL).collect()
    assert len(got) == 200 and all(r.shard_bytes <= SHARD_BYTES for r in got)
    assert sh.assign_shards(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


def test_extra_columns_and_a_very_long_text(spark):
    rows = [(1, "x" * 3_000_000, 5, "c"), (2, "y", 6, "d"), (2, "y", 6, "d")]
    got = sh.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, depth int, cell string"), 1000).collect()
    assert sorted((r.doc_id, r.n_bytes, r.shard_bytes) for r in got) == [(1, 3_000_000, 3_000_000), (2, 1, 2), (2, 1, 2)]
