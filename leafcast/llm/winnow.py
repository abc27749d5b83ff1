"""Document fingerprints by winnowing.

A text's fingerprint is chosen from the hashes of its k-grams of code points: the smallest hash of every
window of ``w`` consecutive k-grams, the rightmost one on ties, each with its position. Two texts that share a
stretch of ``w + k - 1`` code points share a chosen hash (the match guarantee), and the positions
say where. Hashes roll: each is the difference of two prefix sums, scaled back.

Cases: a null or empty text has no hash; a text shorter than k is one gram; with fewer than ``w`` k-grams all are
one window; long texts are taken whole; rows are taken each for itself; an empty table gives no rows;
further columns are ignored. Two texts without hashes have likeness 1, one of them 0. For neighbours, rows go by id (null
first), then text; equal rows follow each other; a single row follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcast.llm.common import CHUNK_BYTES, mix
from leafcast.session import bound_batches

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = _U(0xFFFFFFFF)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_TABLES.get(base, ())) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _TABLES[base] = np.multiply.accumulate(factors)
    return _TABLES[base][:n]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-grams of an array of code points."""
    n = len(points)
    with np.errstate(over="ignore"):
        terms = mix(points.astype(np.uint64) + _U(0x9E3779B97F4A7C15)) * _powers(_BASE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, n)[: n - k + 1]) >> _U(32)


def winnow(texts: list[str], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chosen hashes, their positions), by position, of each text."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= CHUNK_BYTES // 2):
            size += len(texts[end])
            end += 1
        out += _winnow(texts[first:end], k, w)
        first = end
    return out


def _winnow(texts: list[str], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    hashes = gram_hashes(points, k) if len(points) >= k else np.zeros(0, np.uint64)
    # Small hash first, then the larger position: the minimum is the rightmost of equals.
    keys = (hashes << _U(32)) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    least, reach = keys, 1
    while 2 * reach <= w:
        least = np.minimum(least[:-reach], least[reach:]) if len(least) > reach else least[:0]
        reach *= 2
    rest = w - reach
    if rest:
        least = np.minimum(least[:-rest], least[rest:]) if len(least) > rest else least[:0]
    out = []
    for i, n in enumerate(lengths):
        a, grams = int(bounds[i]), int(n) - k + 1
        if n == 0:
            out.append(none)
        elif grams <= 0:
            whole = gram_hashes(points[a:a + int(n)], int(n)).astype(np.uint32)
            out.append((whole, np.zeros(1, np.int64)))
        else:
            chosen = least[a:a + grams - w + 1] if grams >= w else keys[a:a + grams].min(keepdims=True)
            chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])]
            out.append(((chosen >> _U(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int64) - a))
    return out


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits per hash."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: set, b: set) -> float:
    """Share of the hashes of either that both have."""
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(docs: DataFrame, k: int = 16, w: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, hashes, positions): the fingerprint of every text, positions in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = winnow([t.as_py() or "" for t in batch.column(1)], k, w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in marks], pa.list_(pa.int64())),
                 pa.array([p for _, p in marks], pa.list_(pa.int64()))],
                ["doc_id", "hashes", "positions"],
            )

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return bound_batches(rows).mapInArrow(run, "doc_id bigint, hashes array<bigint>, positions array<bigint>")


def matches(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Positions in two texts of the hashes that both fingerprints hold."""
    at: dict[int, list[int]] = {}
    for h, p in zip(left[0].tolist(), left[1].tolist(), strict=True):
        at.setdefault(h, []).append(p)
    return [(p, q) for h, q in zip(right[0].tolist(), right[1].tolist(), strict=True) for p in at.get(h, ())]


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, bucket, peek), each partition by bucket, peek, id, text.

    Buckets are ranges of ids; every bucket ends with a copy (``peek``) of the first row of the next one that
    is not empty, the last with the first of all. So each row finds the next one in its own partition.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ids = rows.select(place.alias("place"))
    cuts = sorted({q for q in ids.where("place > double('-inf')").approxQuantile("place", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    rows = rows.withColumn("place", place)
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="b").transform(rows).withColumn("bucket", F.col("b").cast("int")).drop("b")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    heads = rows.groupBy("bucket").agg(F.min("place").alias("head"))
    found = sorted((r["bucket"], r["head"]) for r in heads.collect())  # a row per bucket, as many as partitions
    before = [(head, found[i - 1][0]) for i, (_, head) in enumerate(found)]
    if not before:
        return rows.select("doc_id", "text", "bucket", F.lit(False).alias("peek"))
    table = spark.createDataFrame(before, "head double, previous int")
    both = rows.join(F.broadcast(table), F.col("place") == F.col("head"), "left").select(
        "doc_id", "text",
        F.explode(F.filter(
            F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("peek")), F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("peek"))),
            lambda x: x["bucket"].isNotNull(),
        )).alias("x"),
    ).select("doc_id", "text", "x.bucket", "x.peek")
    return both.repartitionById(n, "bucket").sortWithinPartitions("bucket", "peek", "doc_id", "text")


def edit_neighbours(docs: DataFrame, k: int = 16, w: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with the fingerprints of every text and of its edit, and their likeness to each other and to the next text.

    The edit puts the first code points of the next text (by id) in the place of the last quarter.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + [
                (i, t or "", b, p) for i, t, b, p in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
            ]
            if len(rows) > 1:
                yield from _compared(rows, k, w)
            held = rows[-1:]

    kind = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return bound_batches(_in_order(docs, id_col, text_col)).mapInArrow(run, kind)


def _compared(rows: list[tuple], k: int, w: int, step: int = 256) -> Iterator[pa.RecordBatch]:
    """Results of the rows that have their next one in the same bucket; peeks only serve the row before."""
    for at in range(0, len(rows) - 1, step):
        part = rows[at:at + step + 1]
        texts = [t for _, t, _, _ in part]
        pairs = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
        edits = []
        for i in pairs:
            quarter = len(texts[i]) // 4
            edits.append(texts[i][:len(texts[i]) - quarter] + texts[i + 1][:quarter])
        marks, edited = winnow(texts, k, w), winnow(edits, k, w)
        sets = [set(h.tolist()) for h, _ in marks]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part[i][0] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array([as_text(marks[i][0]) for i in pairs], pa.string()), pa.array([as_text(h) for h, _ in edited], pa.string()),
                pa.array([likeness(sets[i], set(h.tolist())) for i, (h, _) in zip(pairs, edited, strict=True)], pa.float64()),
                pa.array([likeness(sets[i], sets[i + 1]) for i in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
