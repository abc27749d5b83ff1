"""Helpers shared by the operators of this subpackage: word hashing over Arrow buffers and links to components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcast.session import materialize

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 2 * len(_POWERS)), 0xD6E8FEB86659FD93, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(factors)
    return _POWERS


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column, each about ``limit`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of A-Z-lowered texts.

    Returns (hashes, row of each word, first byte of each word, byte length of each word).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    chars = np.flatnonzero(solid)
    first = np.searchsorted(chars, starts)
    length = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        terms = _BYTE_CODE[data[chars]] * _powers(int(length.max()))[place]
        sums = np.add.reduceat(terms, first) + length.astype(np.uint64) * _STEP
    row = np.searchsorted(offsets, starts, side="right") - 1
    return mix(sums), row, starts, length


#: Rows of one key that a join leaves together; a key with more is dealt over parts.
PART_ROWS = 256
#: A table of keys with more rows than this is joined without a broadcast.
BROADCAST_KEYS = 500_000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """Rows (key, parts) of the keys that ``rows`` has more than ``PART_ROWS`` times; None if there are none."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS)
    heavy = materialize(counted.select(key, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "heavy-keys")
    n = heavy.limit(BROADCAST_KEYS + 1).count()
    return None if n == 0 else F.broadcast(heavy) if n <= BROADCAST_KEYS else heavy


def dealt(rows: DataFrame, heavy: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with ``part``, the share of a heavy key that a row belongs to, by a hash of the row."""
    if heavy is None:
        return rows.withColumn("part", F.lit(0))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")
    return rows.join(heavy, key, "left").withColumn("part", part).drop("parts")


def copied(table: DataFrame, heavy: DataFrame | None, key: str) -> DataFrame:
    """``table``, one row per key, with ``part``: a heavy key's row once for each of its parts."""
    if heavy is None:
        return table.withColumn("part", F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return table.join(heavy, key, "left").withColumn("part", F.explode(parts)).drop("parts")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node reachable.

    Minimum labels over the neighbours with a pointer jump per round, so chains shorten
    quickly; every round is a written table. A node with very many links, or a root of very many nodes, is
    dealt over parts in both joins, and what follows them are partial aggregates, so neither is a single task's work.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    hubs = heavy_keys(both, "b")
    edges = both if hubs is None else materialize(dealt(both, hubs, "b"), "edges")
    edges = edges.withColumn("part", F.lit(0)) if hubs is None else edges
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")),
        "labels",
    )
    while True:
        near = (
            edges.join(copied(labels.withColumnRenamed("node", "b"), hubs, "b"), ["b", "part"])
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        wide = heavy_keys(labels, "root")
        far = copied(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), wide, "root")
        moved = materialize(
            dealt(labels.join(near, "node"), wide, "root").join(far, ["root", "part"], "left").select(
                "node",
                F.least("root", "near", "far").alias("root"),
                (F.least("root", "near", "far") < F.col("root")).alias("moved"),
            ),
            "labels",
        )
        labels = moved.select("node", "root")
        if moved.where("moved").limit(1).count() == 0:
            return labels
