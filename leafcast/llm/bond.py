"""Hard negatives by a vertical scan with branch and bound over decomposed vectors.

Vectors lie in blocks, a column per dimension, with the least and greatest value of each. An anchor reads a block's
columns in the descending order of its own magnitudes, a few at a time, and adds their products to the partial
scores of the candidates in its bitmap. What the columns not yet read can add lies between sums of their least
and greatest contributions, so every candidate has a lower and an upper bound; those that cannot be
among the results any more leave the bitmap, and the rest read on until their scores are exact.

Two scans: first the best rows of the anchor's own label (positives), then, for the score window that each
positive sets, the best rows of other labels inside it (negatives). A block's results, a few per anchor, are
merged over blocks by rank.

Blocks hold about ``BLOCK_ROWS`` rows each, dealt by a hash of the row's number, so that no label, id or common
vector shares a block; the anchors, a stated query set, go to every block, one row at a time, so memory is bounded by
a block. Components are scaled and floored to integers and stay below ``LIMIT``, which makes every sum
exact in a double.

Cases: rows take no part if their id, label or vector is null, or if a component is null, not finite or ``LIMIT`` or more
in magnitude after scaling, or if there are over ``MAX_DIMS``; vectors of unequal length are compared as if the shorter one
ended in zeros, an empty vector scores 0; ties go to the smaller id; rows that repeat an id are rows of their own, but
neither positive nor negative of each other, and each is an anchor; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.session import materialize

#: LIMIT * LIMIT * MAX_DIMS is 2 ** 53: sums of products up to there are exact in a double.
LIMIT, MAX_DIMS = 1 << 20, 1 << 13
BLOCK_ROWS = 4096
#: Columns read between two looks at the bounds.
COLUMNS_AT_ONCE = 8
#: Partitions that the blocks share, at most.
MOST_PARTITIONS = 10_000


def scaled_vectors(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Rows (row, vec_id, label, v) that take part: ``v`` holds floor(scale * x), ``row`` numbers the rows."""
    vector = F.transform(rows[vector_col], lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    in_range = F.forall(rows[vector_col], lambda x: F.coalesce(F.lit(float(scale)) * F.abs(x.cast("double")) < float(LIMIT), F.lit(False)))
    kept = rows[id_col].isNotNull() & rows[label_col].isNotNull() & F.coalesce(in_range, F.lit(False)) & (F.size(rows[vector_col]) <= MAX_DIMS)
    return rows.where(kept).select(
        F.monotonically_increasing_id().alias("row"), rows[id_col].cast("bigint").alias("vec_id"), rows[label_col].cast("bigint").alias("label"),
        vector.cast("array<int>").alias("v"),
    )


class Block:
    """Rows by dimension: ``columns[d]`` holds component d of every row, ``least`` and ``greatest`` bound it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        self.ids, self.labels = ids, labels
        dims = int(lengths.max(initial=0))
        rows = np.zeros((len(ids), dims))
        rows[np.arange(dims) < lengths[:, None]] = values
        self.columns = np.ascontiguousarray(rows.T)
        self.least = self.columns.min(axis=1, initial=np.inf) if len(ids) else np.zeros(dims)
        self.greatest = self.columns.max(axis=1, initial=-np.inf) if len(ids) else np.zeros(dims)

    def scan(self, query: np.ndarray, bitmap: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows left in the bitmap, as places, and their exact scores; ``stays`` tells by lower and upper bounds who reads on."""
        dims = min(len(query), len(self.columns))
        order = np.argsort(-np.abs(query[:dims]), kind="stable")
        one, other = query[order] * self.least[order], query[order] * self.greatest[order]
        rest_least, rest_most = _tails(np.minimum(one, other)), _tails(np.maximum(one, other))
        places = np.flatnonzero(bitmap)
        scores = np.zeros(len(places))
        for at in range(0, dims, COLUMNS_AT_ONCE):
            if not len(places):
                break
            read = order[at:at + COLUMNS_AT_ONCE]
            part = self.columns[read] if len(places) == len(bitmap) else self.columns[read[:, None], places]
            scores += query[read] @ part
            end = at + len(read)
            left = stays(scores + rest_least[end], scores + rest_most[end])
            bitmap[places] = left
            places, scores = places[left], scores[left]
        return places, scores

    def best(self, places: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``n``: highest scores, ties to the smaller id."""
        if len(places) > n:
            high = scores >= np.partition(scores, len(scores) - n)[len(scores) - n]
            places, scores = places[high], scores[high]
        first = np.lexsort((self.ids[places], -scores))[:n]
        return self.ids[places[first]], scores[first].astype(np.int64)

    def positives(self, query: np.ndarray, vec_id: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        bitmap = (self.labels == label) & (self.ids != vec_id)
        return self.best(*self.scan(query, bitmap, lambda low, high: high >= _nth(low, n)), n)

    def negatives(self, query: np.ndarray, vec_id: int, label: int, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (least, greatest score, both included) the best ``n`` rows of other labels inside it."""

        def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            left = np.zeros(len(low), dtype=bool)
            for least, greatest in windows:
                may = (high >= least) & (low <= greatest)
                sure = low[(low >= least) & (high <= greatest)]
                left |= may & (high >= _nth(sure, n))
            return left

        bitmap = (self.labels != label) & (self.ids != vec_id)
        places, scores = self.scan(query, bitmap, stays)
        out = []
        for least, greatest in windows:
            inside = (scores >= least) & (scores <= greatest)
            out.append(self.best(places[inside], scores[inside], n))
        return out


def _tails(contributions: np.ndarray) -> np.ndarray:
    """Sums of what stands at and after each place, 0 at the end."""
    return np.append(np.cumsum(contributions[::-1])[::-1], 0.0)


def _nth(bounds: np.ndarray, n: int) -> float:
    """The ``n``-th greatest of lower bounds, which the results' scores reach; none if there are fewer."""
    return np.partition(bounds, len(bounds) - n)[len(bounds) - n] if len(bounds) >= n else -np.inf


def score_window(positive: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest integer score s with low[0] * positive <= low[1] * s and high[1] * s <= high[0] * positive."""
    return -(-low[0] * positive // low[1]), high[0] * positive // high[1]


FOUND = "row bigint, place int, other_id bigint, score bigint"


def _scanner(answer: Callable[[Block, dict], Iterator[tuple[int, np.ndarray, np.ndarray]]]):
    """Arrow function over rows sorted by (slot, is_anchor): a block's vectors come first, then every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, block = None, [], None
        for batch in batches:
            at_slot, anchor = batch.column("slot").to_numpy(), batch.column("is_anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(at_slot) != 0) | (np.diff(anchor.astype(np.int8)) != 0)) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                vectors = rows.column("v")
                lengths, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
                if at_slot[a] != slot:
                    slot, parts, block = at_slot[a], [], None
                if not anchor[a]:
                    parts.append((rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), lengths, values))
                    continue
                if block is None:
                    if not parts:
                        continue  # no vector has this slot
                    block, parts = Block(*map(np.concatenate, zip(*parts, strict=True))), []
                ends = np.cumsum(lengths)
                heads = rows.select(["row", "vec_id", "label", "bars"]).to_pylist()
                for head, length, end in zip(heads, lengths, ends, strict=True):
                    head["query"] = values[end - length:end].astype(np.float64)
                    for place, ids, scores in answer(block, head):
                        out.append((np.full(len(ids), head["row"]), np.full(len(ids), place, np.int32), ids, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(np.concatenate, zip(*out, strict=True))], ["row", "place", "other_id", "score"])

    return run


def _over_blocks(vectors: DataFrame, anchors: DataFrame, n_rows: int, answer) -> DataFrame:
    """Rows FOUND: what ``answer`` yields for every anchor (row, vec_id, label, v, bars) and block."""
    slots = max(1, -(-n_rows // BLOCK_ROWS))
    tasks = min(slots, MOST_PARTITIONS)
    stored = vectors.select(
        F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int").alias("slot"), F.lit(False).alias("is_anchor"), "row", "vec_id", "label", "v",
        F.lit(None).cast("array<bigint>").alias("bars"),
    )
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(True).alias("is_anchor"), "row", "vec_id", "label", "v", "bars")
    dealt = stored.union(asked).repartitionById(tasks, F.pmod("slot", F.lit(tasks)).cast("int")).sortWithinPartitions("slot", "is_anchor")
    return dealt.mapInArrow(_scanner(answer), FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of each (row, place), numbered from 1."""
    w = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A positive is one of the anchor's ``n_positives`` best rows of its label, a negative one of the ``n_negatives`` best rows of another
    label with a score from ``low`` to ``high`` (fractions) of the positive's. ``is_anchor`` is a condition on vec_id, label and v.
    """
    vectors = materialize(scaled_vectors(rows, scale, id_col, label_col, vector_col), "scaled-vectors")
    n_rows = vectors.count()
    none = F.lit(None).cast("array<bigint>")
    anchors = vectors.where(is_anchor).withColumn("bars", none)

    def own_label(block: Block, a: dict):
        yield 0, *block.positives(a["query"], a["vec_id"], a["label"], n_positives)

    def other_labels(block: Block, a: dict):
        windows = [score_window(score, low, high) for score in a["bars"]]
        for place, (ids, scores) in enumerate(block.negatives(a["query"], a["vec_id"], a["label"], windows, n_negatives)):
            yield place, ids, scores

    positives = materialize(_first(_over_blocks(vectors, anchors, n_rows, own_label), n_positives), "positives")
    # At most n_positives in a list.
    bars = positives.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("bars"))
    asked = anchors.drop("bars").join(bars, "row")
    found = _first(_over_blocks(vectors, asked, n_rows, other_labels), n_negatives)
    pairs = positives.select(
        "row", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.join(pairs, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
