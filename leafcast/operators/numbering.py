"""Places of rows in their group and running sums, without a window over a whole group.

Rows are dealt by range over group and order, sorted where they are, and written. What each task holds of
each group is one row of counts; sums over those rows, at most one per task and group, tell where a task's
first row of the group stands. So a group may hold all rows of the table.

Cases: a null group is a group; nulls sort first; rows that tie are numbered in the order of the input, so
that is to be a table or a written result (the same again after a lost executor); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.session import materialize

#: Bits of monotonically_increasing_id that count the rows of one task (a fixed rule of Spark).
ROW_BITS = 33


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition on columns of the same names, null equal to null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "position", total: str | None = None,
             partitions: int = 0) -> DataFrame:
    """``df`` with the 0-based place of each row in its group, and the group's size as ``total`` if named.

    ``partitions`` is how many tasks share the rows; 0 takes ``spark.sql.shuffle.partitions``.
    """
    placed = _placed(df, groups, order, partitions)
    runs = placed.groupBy(*groups, "nb_task").agg(F.min("nb_at").alias("nb_first"), F.count("*").alias("nb_rows"))
    starts = runs.select(*groups, "nb_task", "nb_first", _before("nb_rows", groups), _whole("nb_rows", groups))
    out = _with_starts(placed, starts, groups)
    cols = [F.col(c) for c in df.columns]
    cols.append((F.col("nb_at") - F.col("nb_first") + F.col("nb_before")).alias(name))
    return out.select(*cols, F.col("nb_whole").alias(total)) if total else out.select(*cols)


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], value: str, name: str, partitions: int = 0) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group before this one; a null value counts as 0."""
    placed = _placed(df, groups, order, partitions).withColumn("nb_value", F.coalesce(F.col(value), F.lit(0)))
    runs = placed.groupBy(*groups, "nb_task").agg(F.sum("nb_value").alias("nb_rows"))
    starts = runs.select(*groups, "nb_task", _before("nb_rows", groups))
    inside = Window.partitionBy(*groups, "nb_task").orderBy("nb_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("nb_inside", F.coalesce(F.sum("nb_value").over(inside), F.lit(0)))
    return _with_starts(local, starts, groups).select(*df.columns, (F.col("nb_before") + F.col("nb_inside")).alias(name))


def _placed(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], partitions: int) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("nb_tie", F.monotonically_increasing_id())
    keys = [*groups, *order, "nb_tie"]
    dealt = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("nb_tie")
    placed = materialize(dealt.withColumn("nb_at", F.monotonically_increasing_id()), "placed-rows")
    return placed.withColumn("nb_task", F.shiftright("nb_at", ROW_BITS))


def _before(count: str, groups: Sequence[str]) -> Column:
    w = Window.partitionBy(*groups).orderBy("nb_task").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0)).alias("nb_before")


def _whole(count: str, groups: Sequence[str]) -> Column:
    return F.sum(count).over(Window.partitionBy(*groups)).alias("nb_whole")


def _with_starts(placed: DataFrame, starts: DataFrame, groups: Sequence[str]) -> DataFrame:
    names = [*groups, "nb_task"]
    return placed.join(starts, null_safe(placed, starts, names)).drop(*(starts[n] for n in names))
