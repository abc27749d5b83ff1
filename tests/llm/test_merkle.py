import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.llm import merkle
from leafcast.llm.queries import QUERIES
from leafcast.session import materialize

SCHEMA = "grp string, doc_id long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and per node the siblings (side, digest) level by level, by the definition."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, sets = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            if len(run) == 2:
                for m in under[i]:
                    paths[m].append((1, run[1]))
                for m in under[i + 1]:
                    paths[m].append((0, run[0]))
            else:
                for m in under[i]:
                    paths[m].append((2, None))
            up.append(H(*run))
            sets.append([m for s in under[i:i + 2] for m in s])
        nodes, under = up, sets
    return nodes[0], paths


def brute(rows):
    """Sorted (grp, doc_id, leaf, subroot, root, path)."""
    groups = {}
    for g, i, t in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, H(field(i), field(t)), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for *_, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, i), path in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True):
            out.append((g, i, leaf, trees[g][0], root, path + top))
    return sorted(out, key=str)


def results(spark, rows, bits, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(4)
    leaves = df.select("grp", "doc_id", F.unhex(merkle.leaf_digest(F.col("doc_id"), F.col("text"))).alias("digest"))
    found = merkle.manifest(materialize(leaves, "test-leaves"), bits).select(
        "*", merkle.fold(merkle.hexed(F.col("digest")), F.col("steps")).alias("folded"), merkle.sibling_digests(F.col("steps")).alias("siblings")
    ).collect()
    out = []
    for r in found:
        raw = bytes(r.steps)
        path = [(raw[a], raw[a + 1:a + 33].hex() if raw[a] < 2 else None) for a in range(0, len(raw), 33)]
        assert r.siblings == [d for _, d in path if d]
        assert r.folded == r.root.hex()
        out.append((r.grp, r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), path))
    return sorted(out, key=str)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(g, rng.randrange(10**6), rng.choice(["a", "", "é😀", None])) for g, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_equals_the_definition(spark, bits):
    rows = rows_of({"en": 75, "de": 16, None: 5, "fr": 1, "é": 2, "z": 33, "": 8}) + [("en", 5, "same")] * 7 + [("en", None, "x"), ("en", None, None)]
    assert results(spark, rows, bits) == brute(rows)


@pytest.mark.parametrize("n", range(1, 18))
def test_every_size_of_a_tree(n):
    """The frontier alone, closed at the height that n leaves need."""
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    f = merkle.Frontier()
    for leaf in leaves:
        f.append(leaf)
    got = f.close((n - 1).bit_length())
    root, paths = tree([x.hex() for x in leaves])
    assert got.digest.hex() == root
    assert [[(w[a], w[a + 1:a + 33].hex() if w[a] < 2 else None) for a in range(0, len(w), 33)] for w in got.witnesses] == paths


def test_one_row_one_group_and_no_rows(spark):
    assert results(spark, [("en", 1, "x")], 10) == brute([("en", 1, "x")])
    assert results(spark, [(None, None, None)] * 3, 1) == brute([(None, None, None)] * 3)
    assert results(spark, [], 10) == []


def test_many_groups_and_a_very_long_text(spark):
    rows = [(f"g{i % 37}", i, "x") for i in range(120)] + [("g1", 500, "long é " * 300_000)]
    assert results(spark, rows, 2) == brute(rows)


def test_extra_columns_are_carried(spark):
    df = spark.createDataFrame([("a", 1, bytes(32), 7, "p"), ("a", 2, bytes(32), 8, "q")], "grp string, doc_id long, digest binary, nb int, name string")
    got = merkle.manifest(materialize(df, "test-leaves")).collect()
    assert sorted((r.doc_id, r.nb, r.name) for r in got) == [(1, 7, "p"), (2, 8, "q")]


def test_tampering_shows(spark):
    got = QUERIES["op13_incremental_merkle_manifest"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    from zlib import crc32

    assert len(got) == len(docs) and len({r.root for r in got}) == 1
    for r in got:
        touched = crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None
        assert r.verified == (not touched) and (r.folded_root == r.root) == r.verified
