from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafcast.operators.numbering import numbered, running_sum
from leafcast.session import materialize

ROWS = [("hot", i * 7919 % 400, i % 5) for i in range(400)] + [(None, i, None) for i in range(9)] + [("b", 3, 1)] * 30 + [("c", None, 2), ("c", 1, 4)]


def table(spark):
    return materialize(spark.createDataFrame(ROWS, "grp string, v int, size int").repartition(5), "test-rows")


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_places_equal_a_window(spark, partitions):
    got = numbered(table(spark), ["grp"], ["v"], "place", "whole", partitions).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.grp].append(r)
    assert len(got) == len(ROWS)
    for rows in groups.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows))) and {r.whole for r in rows} == {len(rows)}
        values = [(r.v is not None, r.v or 0) for r in rows]
        assert values == sorted(values)


def test_one_order_over_all_rows_and_descending(spark):
    got = numbered(table(spark).where("grp = 'hot'"), [], [F.col("v").desc()], partitions=6).collect()
    assert sorted((r.position, r.v) for r in got) == [(i, 399 - i) for i in range(400)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_running_sums(spark, partitions):
    got = running_sum(table(spark), ["grp"], ["v"], "size", "before", partitions).where("grp = 'hot'").orderBy("v").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.size
    assert {r.before for r in running_sum(table(spark), ["grp"], ["v"], "size", "before").where("grp is null").collect()} == {0}


def test_empty_table(spark):
    none = table(spark).where("v > 1000")
    assert numbered(none, ["grp"], ["v"]).collect() == [] and running_sum(none, ["grp"], ["v"], "size", "s").collect() == []


def test_no_window_over_a_group_of_rows(spark):
    """The only windows are over one row per task and group."""
    plan = numbered(table(spark), ["grp"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan[plan.index("Window"):]
