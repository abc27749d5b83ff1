"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (hashed, weighted by the square root of their counts, scaled to
length one), one bin for each statistic of its structure (sizes, shares of capitals, digits
and symbols, repeats, line lengths) and one for each metadata column. The score is the
logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairwise interactions cost time linear in the features. The model is fitted on a sample of
at most ``max_rows`` labelled rows (those with the smallest id hashes) by AdaGrad in one task; it has
a fixed size, comes back to the driver and goes to every scoring task. Scores are made in one pass without a shuffle.

Cases: a null or empty text has the bins of an empty text and a score; long texts are read whole;
a null or not finite metadata value has a bin of its own; rows are scored each for itself; unlabelled or null labels are not
learned from; with one label only, the score is that label's smoothed share, with none it is a half; an
empty table gives no rows; other columns never reach the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.llm.common import lowered, text_chunks, word_hashes
from leafcast.session import bound_batches

WORD_BITS = 16
BINS = 64
#: Weight of a structure or metadata bin beside the words, whose squares sum to one.
BIN_WEIGHT = 0.5

_U = np.uint64
_CLASSES = {
    "upper": (65, 91), "lower": (97, 123), "digit": (48, 58), "space": (32, 33), "line": (10, 11), "other": (128, 256),
}
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".,;:?'-"]] = True
STATISTICS = (
    "bytes", "words", "word_length", "upper", "digit", "marks", "odd_marks", "other", "lines", "line_length",
    "distinct", "top_word", "stuttering", "marked_words", "long_words", "upper_words",
)


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Bins of shares, finer near 0."""
    share = counts / np.maximum(total, 1)
    return np.where(total > 0, 1 + np.floor(np.sqrt(np.clip(share, 0, 1)) * 24), 0)


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(1 + np.maximum(x, 0)))


def features(data: np.ndarray, offsets: np.ndarray, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a slice of texts, sorted by row."""
    rows = len(offsets) - 1
    low = lowered(data)
    hashes, word_row, starts, length = word_hashes(low, offsets)
    feature = (hashes >> _U(64 - WORD_BITS)).astype(np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(word_row, weights=flags, minlength=rows)

    counts = {k: per_text((data >= a) & (data < b)) for k, (a, b) in _CLASSES.items()}
    size, n_words = np.diff(offsets), np.bincount(word_row, minlength=rows)
    letters = counts["upper"] + counts["lower"]
    marks = per_text(_MARKS[data])
    odd = marks - per_text(_STOPS[data])
    key, count = np.unique(word_row * (1 << WORD_BITS) + feature, return_counts=True)
    row, feat = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, count)
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    last = data[starts + length - 1] if len(starts) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    bins = {
        "bytes": _sizes(size), "words": _sizes(n_words), "word_length": np.minimum(30, per_words(length) // np.maximum(n_words, 1)),
        "upper": _shares(counts["upper"], letters), "digit": _shares(counts["digit"], size), "marks": _shares(marks, size),
        "odd_marks": _shares(odd, size), "other": _shares(counts["other"], size), "lines": _sizes(counts["line"]),
        "line_length": _sizes(size / (counts["line"] + 1)), "distinct": _shares(distinct, n_words), "top_word": _shares(top, n_words),
        "stuttering": _shares(per_words(again), n_words), "marked_words": _shares(per_words(_MARKS[last] & ~_STOPS[last]), n_words),
        "long_words": _shares(per_words(length > 20), n_words), "upper_words": _shares(per_words((first >= 65) & (first < 91)), n_words),
    }
    columns = [bins[s] for s in STATISTICS]
    for m in metadata:
        good = np.isfinite(m)
        columns.append(np.where(good, 1 + _sizes(np.abs(np.where(good, m, 0))), 0))
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=count, minlength=rows))
    value = value / np.maximum(norm[row], 1)
    all_row, all_feat, all_value = [row], [feat], [value]
    for field, c in enumerate(columns):
        all_row.append(np.arange(rows))
        all_feat.append((1 << WORD_BITS) + field * BINS + np.clip(c, 0, BINS - 1).astype(np.int64))
        all_value.append(np.full(rows, BIN_WEIGHT))
    all_row = np.concatenate(all_row)
    order = np.argsort(all_row, kind="stable")
    return all_row[order], np.concatenate(all_feat)[order].astype(np.int32), np.concatenate(all_value)[order].astype(np.float32)


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, begins: np.ndarray, feat: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, sums of v*x) of rows whose entries begin at ``begins``; every row has entries."""
        vx = self.v[feat] * value[:, None]
        sums = np.add.reduceat(vx, begins, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), begins)
        linear = np.add.reduceat(self.w[feat] * value, begins)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def size_of(n_metadata: int) -> int:
    return (1 << WORD_BITS) + (len(STATISTICS) + n_metadata) * BINS


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_metadata: int, rank: int = 8, epochs: int = 12,
        rate: float = 0.1, decay: float = 2e-5, batch: int = 256, seed: int = 13) -> FactorisationMachine:
    """Fits by AdaGrad on logistic loss; ``rows``: (features, values) of each text."""
    rng = np.random.default_rng(seed)
    dim = size_of(n_metadata)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(dim, np.float32), rng.normal(0, 0.02, (dim, rank)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    g0, gw, gv = 1e-6, np.full(dim, 1e-6, np.float32), np.full((dim, rank), 1e-6, np.float32)
    sizes = np.array([len(f) for f, _ in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            feat, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            begins = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            margin, sums = model.margins(begins, feat, value)
            err = ((1 / (1 + np.exp(-margin)) - labels[some]) / len(some)).astype(np.float32)
            g0 += float(err.sum()) ** 2
            model.w0 -= rate * float(err.sum()) / g0**0.5
            e = np.repeat(err, sizes[some]) * value
            used, where = np.unique(feat, return_inverse=True)
            dw = np.bincount(where, weights=e, minlength=len(used)).astype(np.float32) + decay * model.w[used]
            each = e[:, None] * (np.repeat(sums, sizes[some], axis=0) - model.v[feat] * value[:, None])
            dv = np.stack([np.bincount(where, weights=each[:, f], minlength=len(used)) for f in range(rank)], axis=1).astype(np.float32)
            dv += decay * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def _metadata(batch: pa.RecordBatch, first: int, start: int, end: int) -> list[np.ndarray]:
    return [
        batch.column(c).slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(first, batch.num_columns)
    ]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, values = [], []
        for start, end, data, offsets in text_chunks(batch.column(1)):
            row, feat, value = features(data, offsets, _metadata(batch, 3, start, end))
            cuts = np.searchsorted(row, np.arange(1, end - start))
            feats += np.split(feat, cuts)
            values += np.split(value, cuts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(feats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["label", "h", "feats", "values"],
        )


def _fitter(n_metadata: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            rows += [(f.values.to_numpy(), v.values.to_numpy()) for f, v in zip(batch.column(1), batch.column(2), strict=True)]
        model = fit(rows, np.array(labels), n_metadata)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.w0]), pa.array([model.w.tobytes()], pa.binary()), pa.array([model.v.tobytes()], pa.binary())], ["w0", "w", "v"]
        )

    return run


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), max_rows: int = 10_000,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Model of the labelled rows (``labels``: id and 0/1 label); ``max_rows`` bounds the sample collected."""
    kept = labels.select(labels[id_col].cast("bigint").alias("label_id"), (labels[label_col] == 1).cast("double").alias("label"))
    sample = kept.dropna().orderBy(F.xxhash64("label_id"), "label_id", "label").limit(max_rows)
    texts = docs.select(
        docs[id_col].cast("bigint").alias("label_id"), docs[text_col].cast("string").alias("text"),
        *(docs[m].cast("double").alias(f"m{i}") for i, m in enumerate(metadata)),
    )
    joined = texts.join(F.broadcast(sample), "label_id").withColumn("h", F.xxhash64("label_id", "text"))
    # Texts become features where they are; only features are ordered and reach the task that fits.
    rows = joined.select("label", "text", "h", *(f"m{i}" for i in range(len(metadata))))
    made = bound_batches(rows).mapInArrow(_featurise, "label double, h bigint, feats array<int>, values array<float>")
    ordered = made.orderBy("h", "label").limit(max_rows).repartition(1).sortWithinPartitions("h", "label").select("label", "feats", "values")
    found = ordered.mapInArrow(_fitter(len(metadata)), "w0 double, w binary, v binary").collect()
    if not found:
        return fit([], np.zeros(0), len(metadata))
    w, v = np.frombuffer(found[0]["w"], np.float32), np.frombuffer(found[0]["v"], np.float32)
    return FactorisationMachine(found[0]["w0"], w, v.reshape(len(w), -1))


def score(docs: DataFrame, model: FactorisationMachine, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 in the place of its text and metadata: id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, end, data, offsets in text_chunks(batch.column(1)):
                row, feat, value = features(data, offsets, _metadata(batch, 2, start, end))
                begins = np.searchsorted(row, np.arange(end - start))
                out[start:end] = 1 / (1 + np.exp(-np.clip(fm.margins(begins, feat, value)[0], -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        *(docs[m].cast("double").alias(f"m{i}") for i, m in enumerate(metadata)),
    )
    return bound_batches(rows).mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, model: FactorisationMachine, metadata: tuple[str, ...] = (), least: float = 0.5,
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = [names.index(text_col), *(names.index(m) for m in metadata)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            used = pa.RecordBatch.from_arrays([batch.column(i) for i in at], [str(i) for i in range(len(at))])
            out = np.zeros(batch.num_rows)
            for start, end, data, offsets in text_chunks(used.column(0)):
                row, feat, value = features(data, offsets, _metadata(used, 1, start, end))
                begins = np.searchsorted(row, np.arange(end - start))
                out[start:end] = 1 / (1 + np.exp(-np.clip(fm.margins(begins, feat, value)[0], -60, 60)))
            yield batch.filter(pa.array(out >= least))

    return bound_batches(docs).mapInArrow(run, docs.schema)
