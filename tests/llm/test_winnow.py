import hashlib
import random

import numpy as np
import pytest

from conftest import SMALL
from leafcast.llm import winnow as wn
from leafcast.llm.queries import QUERIES


def brute(text, k, w):
    """Chosen (hash, position) by the definition, window by window."""
    if not text:
        return []
    grams = [text[i:i + k] for i in range(len(text) - k + 1)] or [text]
    hashes = [int(wn.gram_hashes(np.array([ord(c) for c in g], np.uint32), len(g))[0]) for g in grams]
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i:i + w]
        at = max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1] != (window[at], i + at):
            out.append((window[at], i + at))
    return out


TEXTS = ["", "a", "short", "x" * 200, "ab" * 100, "é😀" * 40, "".join(random.Random(1).choice("abcd é😀\n") for _ in range(900))]


@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 4), (5, 7), (16, 32), (4, 64)])
def test_chosen_hashes_equal_the_definition(k, w):
    got = wn.winnow(TEXTS, k, w)
    assert [list(zip(h.tolist(), p.tolist(), strict=True)) for h, p in got] == [brute(t, k, w) for t in TEXTS]


def test_match_guarantee_and_positions():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    for _ in range(200):
        shared, k, w = word(16 + 32 - 1), 16, 32
        a, b = word(rng.randrange(300)) + shared + word(rng.randrange(300)), word(rng.randrange(300)) + shared + word(rng.randrange(300))
        one, two = wn.winnow([a, b], k, w)
        hits = wn.matches(one, two)
        assert hits and all(a[p:p + k] == b[q:q + k] for p, q in hits)


def expected(rows, k=16, w=32):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        follower = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        edit = t[:len(t) - q] + follower[:q]
        marks = [[h for h, _ in brute(x, k, w)] for x in (t, edit, follower)]
        hexed = ["".join(f"{h:08x}" for h in m) for m in marks]
        near = [wn.likeness(set(marks[0]), set(m)) for m in marks[1:]]
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), hexed[0], hexed[1], *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [], [(5, "only one text of some length, longer than a gram")], [(1, None), (1, None), (2, "")],
    [(i * 7919 % 1000, f"text {i} " * (i % 23)) for i in range(120)] + [(None, "no id"), (None, None), (3, "é😀" * 50), (3, "é😀" * 50)],
])
def test_neighbours_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, wn.edit_neighbours(df).collect()), key=str) == expected(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_winnowing_fingerprints"](spark, SMALL).collect()
    assert {r.doc_id: tuple(r) for r in got} == {r[0]: r for r in expected(rows)}
    told = [r.near_edited > r.near_next for r in got if r.n_chars > 100 and r.near_next < 1]
    assert sum(told) >= 0.95 * len(told)


def test_operator_keeps_positions(spark):
    df = spark.createDataFrame([(1, TEXTS[-1]), (2, None)], "doc_id long, text string")
    got = {r.doc_id: list(zip(r.hashes, r.positions, strict=True)) for r in wn.fingerprints(df).collect()}
    assert got == {1: brute(TEXTS[-1], 16, 32), 2: []}
