import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from leafcast.llm import pii, quality_fm
from test_jaccard_join import brute as brute_groups
from test_pii import base

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def contaminated(text, items, size=10):
    """Hit word positions and items by scanning every window."""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == v[i:i + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return hit, found


def pairwise_score(model, text, n_chars):
    """The score with every pair of features written out."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, feat, value = quality_fm.features(data, np.array([0, len(data)]), [np.array([np.nan if n_chars is None else float(n_chars)])])
    v = model.v[feat].astype(float) * value[:, None]
    gram = v @ v.T
    margin = model.w0 + float((model.w[feat] * value).sum()) + (gram.sum() - np.trace(gram)) / 2
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the input and of every stage's output."""
    out, docs = [], spark.read.parquet(f"{SMALL}/documents.parquet")
    out.append(docs.collect())
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        result = f(spark, docs, SMALL)
        if name != "packing":
            assert result.columns == docs.columns and [t for _, t in result.dtypes] == [t for _, t in docs.dtypes]
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_order_of_the_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_quality_stage_equals_pairwise_scores(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    learnt = [r.doc_id for r in labels.where(~quality_fm.held_out(F.col("doc_id"))).collect()]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in learnt)
    model = quality_fm.train(spark.read.parquet(f"{SMALL}/documents.parquet"), labels.where(~quality_fm.held_out(F.col("doc_id"))), ("n_chars",))
    want = sorted(r.doc_id for r in stages[0] if pairwise_score(model, r.text, r.n_chars) >= 0.5)
    assert sorted(r.doc_id for r in stages[1]) == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = set(want)
    assert all(i in kept for i, q in truth.items() if q == 1)
    assert sum(i in kept for i, q in truth.items() if q == 0) <= 0.1 * sum(q == 0 for q in truth.values()) + 1


def test_near_duplicate_stage_equals_brute_force(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages[1]], 5, 8, 10)
    assert sorted(r.doc_id for r in stages[2]) == sorted({c for _, _, c in groups})


def test_decontamination_stage_equals_brute_force(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in stages[3]) == sorted(r.doc_id for r in stages[2] if not contaminated(r.text, items)[0])


def test_personal_data_stage_redacts_every_base_span(stages):
    after = {r.doc_id: r for r in stages[4]}
    assert len(after) == len(stages[3])
    for r in stages[3]:
        spans = base(r.text or "")
        if spans:
            assert not [s for s in base(after[r.doc_id].text)]
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
            assert all(f"<{pii.KINDS[k].upper()}>" in after[r.doc_id].text for _, k, _ in spans)


def test_packing_stage_holds_every_token_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in stages[5]:
        pieces.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for r in stages[4]:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert [i for _, part in sorted(pieces[r.doc_id]) for i in part] == ids
    assert set(pieces) == {r.doc_id for r in stages[4]}


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SMALL).select("doc_id", "start", "length", "ids").collect()
    key = lambda rows: sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows)
    total = lambda rows: sum(r.length for r in rows)
    assert total(got) == total(stages[5]) and {r.doc_id for r in got} == {r.doc_id for r in stages[5]}
    assert len(key(got)) > 0


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, label int, h long"
    text = "Some plain words in a row that say nothing of note and end here. " * 4
    rows = [
        (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (1, "", None, None, 0, "x", 1, 1),
        (2, text, "en", None, None, "x", 1, 1), (2, text, "en", None, None, "x", 1, 1), (3, text + " a@b.cc", "en", "s", 5, "x", 1, 1),
        (4, "word " * 60000, "en", "s", 300000, "x", 1, 1),
    ]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, f in cp.STAGES:
            out = f(spark, docs, SMALL)
            got = out.collect()
            assert name == "packing" or out.columns == docs.columns
            if not table:
                assert got == []
            elif name in ("decontamination", "personal_data"):
                assert len(got) == len(rows)
