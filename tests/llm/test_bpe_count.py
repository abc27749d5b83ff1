import random

import public_tokenizers
import pytest
import sentencepiece

from conftest import MEDIUM
from leafcast.llm import bpe_count as bc
from leafcast.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "the ", "ing", "É", "ß", "1", bc.MARK, "½", "\xa0", "<s>", "<unk>", "<0x41>", "漢", "😀", "\x00"]
    texts = ["", " ", "   ", bc.MARK, "</s>", "a" * 4000, " " * 300, bc.MARK * 40 + "x"]
    texts += ["".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.randrange(0xD800)) for _ in range(rng.randrange(40))) for _ in range(2500)]
    counter = bc.BpeCounter(PATH, memo_words=50)  # a memo that is emptied again and again
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    assert len(counter.memo) <= 50


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_bpe_token_counts"](spark, MEDIUM).collect()}
    want = {d: (len(t.encode()), len(library.encode(t))) for d, t in texts.items()}
    assert got == {d: (b, n, n > 4096) for d, (b, n) in want.items()}


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", None), (2, "", "y"), (3, "word " * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bc.token_counts(df, PATH).collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in rows], key=str)
    assert bc.token_counts(df.limit(0), PATH).count() == 0
