import hashlib
import random

from conftest import SMALL
from leafcast.llm import decontaminate as dc
from leafcast.llm.queries import QUERIES
from test_pipeline import contaminated, words


def results(df, items, **kw):
    out = dc.find_contamination(df, items, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out), key=str)


def brute(docs, items, size):
    out = []
    for i, t in docs:
        hit, found = contaminated(t, items, size)
        out.append((i, len(words(t)), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "a", "Ünd", "É1", "x9", "red", "blue", "in", "to"])
    items = [(n, " ".join(word() for _ in range(rng.randrange(0, 9)))) for n in range(20)]
    items += [(30, None), (31, "..."), (32, "single"), (33, "RED, blue!"), (None, "to to to to"), (34, "the the the the the the")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(70, None), (70, None), (71, ""), (72, "a SINGLE é"), (72, "a SINGLE é"), (None, "red Blue"), (73, "the " * 5000), (0, "red blue")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4, 10):
        assert results(df, it, size=size) == brute(docs, items, size)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert results(df, it, size=4, slop=2) == brute(docs, items, 4)


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, item.replace("delta", "delta very")), (3, " ".join(reversed(item.split()))), (4, "beta alpha " + item[11:]), (5, "alpha beta")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in dc.find_contamination(df, it, slop=2).collect()}
    assert got[1] == (1, 1) and got[2] == (0, 1) and got[5] == (0, 0)
    assert all(exact == (i == 1) for i, (exact, _) in got.items())


def near_brute(docs, items, size, slop):
    """Items per document with a window whose words are all around a place of its rarest word (by count, then place in the window)."""
    texts = {i: [w.lower() for w in words(t)] for i, t in docs}
    count = {}
    for w in (w for t in texts.values() for w in t):
        count[w] = count.get(w, 0) + 1
    out = {i: set() for i in texts}
    for item, t in items:
        w = [x.lower() for x in words(t)]
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            window = w[s : s + size]
            _, off = min((count.get(x, 0), n) for n, x in enumerate(window))
            reach = len(window) - 1 + slop
            for i, said in texts.items():
                if any(set(window) <= set(said[max(0, p - reach) : p + reach + 1]) for p, x in enumerate(said) if x == window[off]):
                    out[i].add(item)
    return {i: len(x) for i, x in out.items()}


def test_an_altered_passage_needs_no_intact_copy(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    it = spark.createDataFrame([(9, item)], "item_id long, text string")
    for text, near in ((item.replace("delta", "delta very"), 1), (" ".join(reversed(item.split())), 1), (item.replace("delta", "") + " x" * 12 + " delta", 0)):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [(r.n_items, r.n_near_items) for r in dc.find_contamination(df, it, slop=2).collect()] == [(0, near)], text


def test_proximity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abcdefghijklmn") * 2 for _ in range(n))
    items = [(n, some(rng.randrange(1, 14))) for n in range(30)] + [(40, "single"), (41, "nowhere aa bb")]
    docs = [(i, some(rng.randrange(0, 50))) for i in range(40)] + [(50, "a single word"), (51, "")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = near_brute(docs, items, 6, 2)
    assert sum(want.values()) > 50
    for bound in (dc.BROADCAST_ROWS, -1):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", bound)
        assert {r.doc_id: r.n_near_items for r in dc.find_contamination(df, it, size=6, slop=2).collect()} == want


def test_drop_keeps_clean_rows_and_columns(spark):
    docs, items = corpus()
    rows = [(i, t, "d", n, None) for n, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, h int, window_id string")
    out = dc.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), size=4)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in rows if not contaminated(r[1], items, 4)[0]), key=str)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_items, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert results(none, items) == [] and results(none, no_items) == []
    assert results(one, no_items) == [(1, 2, 0, ())] and results(one, items) == [(1, 2, 2, ("1",))]
    assert dc.drop_contaminated(one, no_items).count() == 1


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated, r.n_items) for r in QUERIES["op5_positional_index_contamination"](spark, SMALL).collect())
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert got == sorted((i, n, h, sha(ids), h > 0, len(ids)) for i, n, h, ids in brute(docs, items, 10))
