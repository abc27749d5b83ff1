import random

import pytest

from leafcast.llm import jaccard_join as jj


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    """component and set size per row, by union-find over all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, sizes, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(12)]
    rows = [(100000, None), (100001, ""), (100002, " \n "), (100003, "One"), (100004, "one "), (100005, "one two"), (100006, "ONE\tTwo")]
    doc = 0
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(size)]
        if rng.random() < 0.3:
            base[: min(size, 12)] = passage[: min(size, 12)]
        for k in range(edits):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[at] = rng.choice(vocab)
                elif kind == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, rng.choice(vocab))
            rows.append((doc, " ".join(w) if k % 2 else " ".join(w).title()))
            doc += 1
    rows.append((doc, rows[-1][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "threshold", "seed"), [(3, (90, 100), 1), (5, (8, 10), 2), (1, (8, 10), 3)])
def test_components_equal_brute_force(spark, n, threshold, seed):
    rows = corpus(seed, [1, 2, 3, 4, 6, 9, 12, 14, 18, 22, 28, 33, 41, 50, 66, 80, 95, 120, 150, 190, 240, 310, 420, 700], 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df, n, threshold).collect())
    assert got == brute(rows, n, *threshold)


def test_hot_lists_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(jj, "HOT_SAMPLE_ROWS", 1)
    monkeypatch.setattr(jj, "SAMPLE", 0.5)
    rows = corpus(5, [60, 130, 300], 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df, 3, (90, 100)).collect())
    assert got == brute(rows, 3, 90, 100)


def test_every_similar_pair_shares_a_key():
    """The rule for who is compared at all, on sets at the very threshold."""
    import numpy as np

    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (8, 10), (6, 10)):
        for size in [*range(3, 70), 100, 137, 180, 250, 400, 1000, 3000]:
            for _ in range(6):
                both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * 2
                extra = size * (den - num) // num  # both / (both + extra) >= num / den
                more = rng.integers(0, 1 << 63, extra, dtype=np.uint64) * 2
                cut = rng.integers(0, extra + 1)
                a, b = np.unique(np.append(both, more[:cut])), np.unique(np.append(both, more[cut:]))
                assert den * len(both) >= num * (len(both) + extra)
                if len(a) == len(b) == len(both):
                    continue
                met = False
                for one, other in ((a, b), (b, a)):
                    theirs = {k for _, _, keys in jj.signatures(other, num, den) for k in keys.tolist()}
                    shared = [(len(theirs & set(keys.tolist())), need) for _, need, keys in jj.signatures(one, num, den)]
                    met = any(k >= need for k, need in shared)
                    assert met, (num, den, size, shared)


def test_keep_one_of_each_group(spark):
    text = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [
        (3, text, "x", 1), (1, text.upper(), None, 2), (1, text.upper(), None, 2), (5, other, "y", 3), (5, text + " z", "y", 3),
        (None, other, "q", None), (7, None, "e", 1), (7, None, "e", 1), (8, "", "e", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_h string, kept_id int")
    out = jj.keep_one(df)
    assert out.columns == df.columns
    want = [(1, text.upper(), None, 2), (5, other, "y", 3), (7, None, "e", 1), (7, None, "e", 1), (8, "", "e", 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(df).count() == 0
    assert jj.keep_one(df).count() == 0
