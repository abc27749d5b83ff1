import hashlib
import re

from pyspark.sql import functions as F

from leafcast.llm import pii
from leafcast.llm.queries import QUERIES
from conftest import MEDIUM

# The base patterns as given.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    found = [
        (m.start(), no, m.end())
        for no, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m.group())
    ]
    return sorted(found)


HARD = [
    None, "", "plain", "a@b.cc a@b.c-d_e@f.gg @x.y a@b", "x.y+z@mail.example.com.", "é@b.cc ü.a@b.cc", "a@b..c a@b.c.", "a@b.c@d.e.f",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3.", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111" * 3,
    "+1 (743) 555-3824 +49.30.1234567 +1 ((((((", "+123456789 +12345678 +1234567890123456", "😀 a@b.cc 😀 1.2.3.4 😀 +1 743 555 3824",
    "9" * 30000, "a" * 30000 + "@", "1 " * 20000, "1." * 5000 + "1", "a@" * 3000 + "b.c", "+1" + " " * 5000 + "2",
]


def listed(rows):
    return [[(s["start"], s["kind_no"], s["end"]) for s in r] for r in rows]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert {i: listed([r.base_spans])[0] for i, r in got.items()} == {i: base(t or "") for i, t in enumerate(HARD)}
    for i, r in got.items():
        assert set(listed([r.base_spans])[0]) <= set(listed([r.spans])[0]), i


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    names = list(PATTERNS)
    rows = QUERIES["op10_candidate_boosted_pii"](spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == no for _, k, _ in spans) for no in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_trees_add_formats_that_the_rules_miss(spark):
    phones = [(i, f"word call +1 ({200 + i % 700}) 555-{1000 + i} word") for i in range(300)]
    numbers = [(1000 + i, f"order {10000000 + i * 37} of lot {i % 97}/{i % 13}") for i in range(300)]
    bare = [(5000, "word call (305) 555-7777 word")]
    df = spark.createDataFrame(phones + numbers + bare, "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert all(len(got[i]) == 1 for i, _ in phones)
    assert not any(got[i] for i, _ in numbers)
    assert got[5000] == [(10, 24)]


def test_spelt_addresses_are_added_and_redacted(spark):
    said = ["john (at) mail (dot) com", "john at mail dot com", "a.b+c [AT] x-y [Dot] example [dot] org"]
    rows = [(i, f"word {t} word") for i, t in enumerate(said)]
    noise = [(1000 + i, f"order {10000000 + i * 37} of lot {i % 97}/{i % 13}") for i in range(60)]
    for more in (noise, []):
        out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
        assert [out[i] for i in range(len(said))] == ["word <EMAIL> word"] * len(said)
        assert all(out[i] == t for i, t in more)


def test_a_flood_of_another_kind_does_not_crowd_out_a_rare_one(spark):
    phones = [(i, f"word call +1 ({200 + i % 700}) 555-{1000 + i} word") for i in range(90)]
    flood = [(1000 + i, f"item {10**15 + i * 7919} of many") for i in range(2500)]
    copies = [(9000, "item 1234567890123456 of many")] * 2500
    bare = [(5000, "word call (305) 555-7777 word")]
    df = spark.createDataFrame(phones + flood + copies + bare, "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in pii.find_pii(df, sample_rows=80).collect()}
    assert got[5000] == [(10, 24)]
    assert got[9000] == []


def test_redact_keeps_rows_columns_and_clean_texts(spark):
    rows = [(1, "mail a@b.cc or 1.2.3.4", "x", 5), (2, None, None, None), (None, "clean", "y", 6), (1, "mail a@b.cc or 1.2.3.4", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, pii_base int")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted([(i, t and t.replace("a@b.cc", "<EMAIL>").replace("1.2.3.4", "<IP>"), a, b) for i, t, a, b in rows], key=str)
    assert got == want


def test_redacted_overlaps_and_code_points(spark):
    spans = "array(named_struct('start',2,'kind_no',0,'end',5), named_struct('start',3,'kind_no',2,'end',8), named_struct('start',9,'kind_no',1,'end',10))"
    out = spark.range(1).select(pii.redacted(F.lit("😀é3456789ABC"), F.expr(spans)).alias("t")).first().t
    assert out == "😀é<EMAIL>9<IP>BC"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).count() == 0


def test_a_text_with_very_many_hits(spark):
    """100,000 numbers in one text: offsets, overlaps and redaction take seconds, not the square of that."""
    import time

    text = " ".join(f"+49 30 {i:07d}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = pii.find_candidates(df.withColumnRenamed("text", "pii_text")).select("pii_base", "pii_candidates").first()
    assert len(found.pii_base) == 100_000 and len(found.pii_candidates) >= 100_000
    assert all(c.label == 1.0 for c in found.pii_candidates if c.kind_no == pii.KINDS.index("phone"))
    spans = [(b.start, b.kind_no, b.end) for b in found.pii_base]
    one = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,kind_no:int,end:int>>")
    assert one.select(pii.redacted(one.t, one.s)).first()[0] == " ".join(["<PHONE>"] * 100_000)
    assert time.time() - began < 90


def test_best_of_overlapping_equals_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for n in range(60):
        cs = []
        for _ in range(rng.randrange(0, 30)):
            s = rng.randrange(80)
            cs.append((s, s + rng.randrange(1, 25), rng.randrange(4), float(rng.randrange(4))))
        rows.append((n, cs))
    df = spark.createDataFrame(rows, "n int, c array<struct<start:int,end:int,kind_no:int,score:double>>")
    rank = lambda c: (c[3], -c[0], c[1], -c[2])
    for r in df.select("n", pii._best(F.col("c")).alias("best")).collect():
        cs = rows[r.n][1]
        want = [c for c in cs if not any(d[0] < c[1] and c[0] < d[1] and rank(d) > rank(c) for d in cs)]
        assert sorted(tuple(b) for b in r.best) == sorted(want)
