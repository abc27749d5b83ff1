import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from leafcast.llm import packing as pk
from leafcast.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "É", "ß", "1", "²", "½", "'s", "'", "_", "\xa0", "\x85", "!", "<|endoftext|>", "\x00", "漢", "😀", "İ", "the "]
    texts = ["", " ", "x" * 3000] + ["".join(rng.choice(parts) if rng.random() < 0.9 else chr(rng.randrange(0xD800)) for _ in range(rng.randrange(40))) for _ in range(800)]
    encode = pk.encoder(PATH)
    assert [encode.ids(t).tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_level_rule_is_the_least_sum_of_squares():
    rng = random.Random(4)
    bins = pk.SumOfSquares(20)
    for _ in range(2000):
        n = rng.randrange(1, 20)
        count = bins.count.copy()

        def cost(level, n=n, count=count):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + n < 20:
                c[level + n] += 1
            return (c * c).sum()

        options = [0, *(lv for lv in range(1, 21 - n) if count[lv])]
        least = min(map(cost, options))
        assert bins.level_for(n) == max(lv for lv in options if cost(lv) == least)
        bins.place((0, 0, np.zeros(n, "<u4"), n))
        assert bins.n_open == bins.count.sum() == sum(map(len, bins.open.values()))


def check(rows, pieces, tokenizer, window, partitions):
    """Whole ids once each, windows gapless and full but for one per partition."""
    docs, windows = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 and p.length > 0
        docs.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, texts in rows.items():
        want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts)
        parts = sorted(docs[doc], key=lambda p: p.start)
        assert sum(p.length for p in parts) == sum(map(len, want))
        if len(texts) == 1:
            assert [i for p in parts for i in np.frombuffer(p.ids, "<u4").tolist()] == want[0]
            assert all(p.doc_tokens == len(want[0]) for p in parts)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sum(sum(n for _, n in s) < window for s in windows.values()) <= partitions


@pytest.mark.parametrize(("window", "max_open"), [(16, 3), (64, 4096), (1024, 4096)])
def test_packing_keeps_every_id(spark, tokenizer, window, max_open):
    rng = random.Random(window)
    rows = {i: [" ".join(rng.choice(["alpha", "be", "gamma", "de lta"]) for _ in range(rng.randrange(60)))] for i in range(300)}
    rows |= {1000: [None], 1001: [""], 1002: ["word " * 20000], None: ["x"], 5: ["same", "same"]}
    flat = [(d, t, "extra") for d, ts in rows.items() for t in ts]
    df = spark.createDataFrame(flat, "doc_id long, text string, ids string").repartition(3)
    check(rows, pk.pack_documents(df, PATH, window, 0, max_open).collect(), tokenizer, window, 3)


def test_empty_table(spark):
    assert pk.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_digests(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op2_sum_of_squares_packing"](spark, SMALL).collect()
    seen = {}
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start:r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert all(seen[d] == len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items())
    filled = sum(r.length for r in got)
    assert filled >= 0.99 * 1024 * len({r.sequence_id for r in got})


@pytest.mark.parametrize("max_open", [1, 2, 3, 50])
def test_the_bound_on_open_windows_loses_no_id(max_open):
    """At, below and beyond ``max_open`` windows: every id stays in one piece, windows are never over-full, one is partial at most."""
    rng = random.Random(max_open)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    pieces = [r for out in pk._packer(PATH, 16, 0, max_open)(iter([batch])) for r in out.to_pylist()]
    fill, ids = {}, {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
        ids.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
    assert max(fill.values()) <= 16 and sum(n < 16 for n in fill.values()) <= 1
    encode = pk.encoder(PATH)
    for i, t in enumerate(texts):
        assert b"".join(x for _, x in sorted(ids[i])) == np.append(encode.ids(t), 0).astype("<u4").tobytes()
