"""Sharding by extendible hashing.

Every row has 60 hash bits of its id and text. The directory maps prefixes of these bits to buckets; a bucket
over the byte limit splits on its next bit, and only it, until every bucket fits. The same directory follows
without splitting one by one: a row's bucket is its shortest prefix whose bytes fit. So bytes are summed once per
cell (a prefix some bits longer than the shards need on average), from there upwards level by level, and
only cells that are still too large are looked into again, some bits deeper.

Rows equal in id and text share all bits; if their bucket is too large it is cut by their running number, with
no sort of the whole. A row larger than the limit is a shard of its own.

Cases: a null text has 0 bytes; a null id hashes as such; long texts count whole; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.session import materialize

BITS = 60
#: Bits by which a cell is longer than the average shard's prefix, and by which it grows each round.
EXTRA = 5


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits as a bigint."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(bits: Column, depth: Column) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def _fitting(cells: DataFrame, limit: int, low: int, depth: int) -> DataFrame:
    """Rows (cell, depth, prefix, shard_bytes): per cell the shortest prefix of ``low`` bits or more whose bytes fit; none for a cell too large.

    Bytes are added from the cells upwards, two children to a parent, one level a step: two rows per cell in all, and no key
    has more than two. A prefix that fits under a parent that does not is a bucket; its cells are those of its range.
    """
    level = cells.select(F.col("cell").alias("prefix"), "n_bytes")
    found = None
    for d in range(depth, low - 1, -1):
        level = materialize(level.withColumn("fits", F.col("n_bytes") <= limit), "level")
        parent = F.call_function("shiftright", "prefix", F.lit(1))
        if d > low:
            up = level.groupBy(parent.alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
            over = up.where(F.col("n_bytes") > limit).select(F.col("prefix").alias("over"))
            tops = level.where("fits").join(over, parent == F.col("over"), "left_semi")
        else:
            tops = level.where("fits")
        wide = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << depth - d) - 1).cast("bigint"))
        first = F.call_function("shiftleft", "prefix", F.lit(depth - d))
        here = tops.select(
            F.explode(F.transform(wide, lambda i: first + i)).alias("cell"), F.lit(d).alias("depth"), "prefix", F.col("n_bytes").alias("shard_bytes")
        )
        found = here if found is None else found.union(here)
        if d > low:
            level = up
    return cells.select("cell").join(found, "cell")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (cell, cell_depth, depth, prefix, shard_bytes) of rows (bits, n_bytes) of at most ``limit`` bytes each.

    Buckets that no bit can split any more keep depth 60 whatever their size.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, low = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + EXTRA), 0
    found, left = None, rows
    while True:
        cells = left.groupBy(_prefix(F.col("bits"), F.lit(depth)).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        cells = materialize(cells, "cells")
        best = _fitting(cells, limit, low, depth).select("cell", F.lit(depth).alias("cell_depth"), "depth", "prefix", "shard_bytes")
        if depth == BITS:
            stuck = cells.where(F.col("n_bytes") > limit)
            best = best.union(stuck.select("cell", F.lit(depth), F.lit(BITS), F.col("cell").alias("prefix"), F.col("n_bytes").alias("shard_bytes")))
        best = materialize(best, "directory")
        found = best if found is None else found.union(best)
        large = materialize(cells.join(best, "cell", "left_anti").select("cell"), "large-cells")
        if not large.limit(1).count():
            return found
        left = left.join(large, _prefix(F.col("bits"), F.lit(depth)) == F.col("cell"), "left_semi")
        low, depth = depth + 1, min(BITS, depth + EXTRA)


def assign_shards(docs: DataFrame, limit: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, part, shard_bytes.

    A shard is (depth, prefix, part); ``part`` is 0 but for buckets at full depth that were cut by number.
    """
    doc_id, text = docs[id_col].cast("bigint"), docs[text_col].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = materialize(docs.select(doc_id.alias("doc_id"), hash_bits(doc_id, text).alias("bits"), size.alias("n_bytes")), "shard-rows")
    known = directory(rows.where(F.col("n_bytes") <= limit).select("bits", "n_bytes"), limit)
    depths = [r[0] for r in known.select("cell_depth").distinct().collect()]  # one per round
    parts = []
    for depth in sorted(depths):
        of_depth = known.where(F.col("cell_depth") == depth).drop("cell_depth")
        here = rows.where(F.col("n_bytes") <= limit).withColumn("cell", _prefix(F.col("bits"), F.lit(depth)))
        parts.append(here.join(of_depth.hint("merge"), "cell").drop("cell"))
    huge = rows.where(F.col("n_bytes") > limit).select(
        "doc_id", "bits", "n_bytes", F.lit(BITS).alias("depth"), F.col("bits").alias("prefix"), F.col("n_bytes").alias("shard_bytes")
    )
    placed = huge
    for p in parts:
        placed = placed.unionByName(p)
    stuck = (F.col("depth") == BITS) & ((F.col("shard_bytes") > limit) | (F.col("n_bytes") > limit))
    placed = materialize(placed, "placed")
    done = placed.where(~stuck).withColumn("part", F.lit(0).cast("bigint"))
    cut = _numbered(placed.where(stuck), limit)
    names = ["doc_id", "n_bytes", "depth", "prefix", "part", "shard_bytes"]
    return done.select(*names).union(cut.select(*names))


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows cut into parts by a running number: counted per task first, then numbered from there."""
    with_task = rows.withColumn("task", F.spark_partition_id())
    counts = with_task.groupBy("prefix", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("prefix").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("prefix", "task", F.coalesce("before", F.lit(0)).alias("before"))
    local = with_task.withColumn("no", F.row_number().over(Window.partitionBy("prefix", "task").orderBy("doc_id")))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    numbered = local.join(before, ["prefix", "task"]).withColumn("part", F.floor((F.col("before") + F.col("no") - 1) / each))
    sizes = numbered.groupBy("prefix", "part").agg(F.sum("n_bytes").alias("part_bytes"))
    return numbered.join(sizes, ["prefix", "part"]).withColumn("shard_bytes", F.col("part_bytes"))
