import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from leafcast.llm import forced_bpe
from leafcast.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = forced_bpe.coder(PATH)
HARD = [
    "", " ", "  ", "a", "a  b", " a\n\n b ", "don't we'll I'VE 'tis", "x y 　z w", "a\x1cb\x85c d", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c",
    " <|endoftext|>  <|endoftext|>\n", "<|endoftext", "本网站的内容仅供参考", "สงวนลิขสิทธิ์", "é́😀👩‍👩‍👧 ﬁ", "a" * 3000, " " * 2000 + "x", "0123456789" * 300, "=-=-" * 900,
    "\r\n\t \r\n", "١٢٣ ४५६", "​​ ﻿", "ÀÈ" * 500, "\x00\x01\x7f \x00",
]


def ids(text):
    return np.frombuffer(CODER.encode(text.encode()), "<u4").tolist()


@pytest.mark.parametrize("text", HARD)
def test_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert CODER.decode(np.array(want, "<u4").tobytes()) == LIBRARY.decode(want, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n'ablstdé0-<|>endoftx 本"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library_on_any_text(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decoding_any_ids_equals_the_library(tokens):
    assert CODER.decode(np.array(tokens, "<u4").tobytes()) == LIBRARY.decode(tokens, skip_special_tokens=False)


def test_no_token_spans_a_certain_cut():
    for token in random.Random(1).sample(sorted(CODER.bytes_of), 3000):
        if token not in CODER.special.values():
            assert not forced_bpe._cuts(CODER.bytes_of[token], CODER.certain).any()
    assert CODER.certain.reshape(256, 256)[ord("a"), ord(" ")] and not CODER.certain.reshape(256, 256)[ord("t"), ord("h")]
    assert 0.3 < CODER.certain.mean() < 1


def test_a_memo_of_one_fragment_gives_the_same():
    small = forced_bpe.ForcedBpe(PATH, 1)
    for text in HARD:
        assert small.encode(text.encode()) == CODER.encode(text.encode())


def test_rows_nulls_and_empty_tables(spark):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 6, "y"), (None, "", 7, None), (3, "z" * 200_000, 8, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = forced_bpe.decode_ids(forced_bpe.encode_texts(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert forced_bpe.decode_ids(forced_bpe.encode_texts(df.where("doc_id > 9"), PATH), PATH).count() == 0


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_forced_boundary_bpe"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = LIBRARY.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha256(np.array(want, "<u4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest())
