import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.llm import quality_fm as fm
from leafcast.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"


def test_margin_equals_all_pairs_and_gradients_fit():
    rng = np.random.default_rng(1)
    model = fm.FactorisationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    feat, value = np.arange(12), rng.normal(size=12).astype(np.float32)
    margin, _ = model.margins(np.array([0, 5]), feat, value)
    for got, part in zip(margin, (slice(0, 5), slice(5, 12)), strict=True):
        f, x = feat[part], value[part]
        want = 0.3 + float(model.w[f] @ x) + sum(float(model.v[f[i]] @ model.v[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_interactions_are_learnt():
    """The label is the exclusive or of two features, which no linear score can tell."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (600, 2))
    rows = [(np.array([10 + b[0], 20 + b[1]], np.int32), np.ones(2, np.float32)) for b in bits]
    labels = (bits[:, 0] ^ bits[:, 1]).astype(float)
    model = fm.fit(rows, labels, 0, epochs=60, rate=0.2)
    margin, _ = model.margins(np.arange(0, 1200, 2), np.concatenate([f for f, _ in rows]), np.ones(1200, np.float32))
    assert ((margin > 0) == labels).mean() > 0.98


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_factorisation_machine_quality"](spark, LARGER).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98 and np.mean([s >= 0.5 for s in good]) > 0.99 and np.mean([s < 0.5 for s in bad]) > 0.9


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    learn = lambda t: fm.train(docs, t.where(~fm.held_out(F.col("doc_id"))), ("n_chars",))
    flipped = labels.withColumn("quality", F.when(fm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = learn(labels), learn(flipped)
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)
    renamed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 1000})
    one, two = (sorted(r.score for r in fm.score(d, a, ("n_chars",)).collect()) for d in (docs, renamed))
    assert one == two


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None, None, "l"), (1, None, None, "l"), (None, "", 0, "l"), (2, "word " * 100000, 5, None), (3, "Ünd 😀", -4, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label string")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 0), (3, 1)], "doc_id long, quality int")
    one_kind = fm.train(docs, labels, ("n_chars",))
    assert {round(r.score, 6) for r in fm.score(docs, one_kind, ("n_chars",)).collect()} == {0.75}
    none = fm.train(docs, labels.limit(0), ("n_chars",))
    got = fm.score(docs, none, ("n_chars",)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == 5
    assert fm.keep_good(docs, none, ("n_chars",)).count() == 5 and fm.keep_good(docs, none, ("n_chars",)).columns == docs.columns
    assert fm.score(docs.limit(0), one_kind, ("n_chars",)).count() == 0
