import random
import re

import pytest

from conftest import SMALL
from leafcast.llm import line_dedup as ld
from leafcast.llm.queries import LEAST_UNIT, QUERIES


def brute(rows, min_words=5):
    """Per row (id, spans, rest) by one pass in rank order over a set of digests seen."""
    texts = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0))
    assert len({i for i, _ in texts}) == len(texts), "ranks of one id go by hash; not covered here"
    seen, spans = set(), {}
    for i, t in texts:
        for start, end, digest in ld.units(t, min_words):
            if digest is None:
                continue
            if digest in seen:
                spans.setdefault(i, []).append((start, end))
            seen.add(digest)
    out = []
    for i, t in rows:
        cut = spans.get(i, []) if t else []
        rest, at = [], 0
        for a, b in cut:
            rest.append(t[at:a])
            at = b
        out.append((i, cut, None if t is None else "".join(rest) + t[at:]))
    return sorted(out, key=str)


def results(df, **kw):
    return sorted(((r.doc_id, [(s["start"], s["end"]) for s in r.removed], r.text) for r in ld.deduplicate(df, **kw).collect()), key=str)


LINE = "This line is repeated in very many documents, again and again."
ROWS = [
    (9, f"First of mine é😀 only here.\n{LINE}\nTail words that are mine alone."),
    (2, f"{LINE}\nAnd my own long closing line of words.\n{LINE}"),
    (4, f"Other words come here first. THIS line is  repeated in very many documents, again and again!\nOk.\nSo it ends."),
    (5, f"New start of some words here. {LINE} Ok.\nSo it ends."),
    (6, f"{LINE}\nOk.\nNot so."), (1, "Ok."), (7, "Ok."), (8, None), (10, ""), (11, "\n \n.\n"), (None, LINE), (12, "a" * 50000), (13, "x " * 20000 + "\n" + "x " * 20000),
    (14, LINE), (14, LINE),
]


def test_units_cover_the_text_in_order():
    for _, t in ROWS:
        at = 0
        for start, end, _ in ld.units(t or "", 5):
            assert start >= at and end > start and not (t[at:start].strip())
            at = end
        assert not (t or "")[at:].strip()


def test_equals_brute_force_and_short_units_need_their_run(spark):
    got = results(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert got == brute(ROWS)
    cut = {i: s for i, s, _ in got}
    assert cut[2] == [(len(ROWS[1][1]) - len(LINE), len(ROWS[1][1]))]  # the first of its own stays
    assert cut[1] == cut[7] == []
    assert len(cut[5]) == 3 and len(cut[6]) == 2


def test_frequent_digests_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(ld, "SAMPLE", 0.5)
    monkeypatch.setattr(ld, "HOT_ROWS", 3)
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(6)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines[: 1 + rng.randrange(12)]) for _ in range(rng.randrange(6)))) for i in range(300)]
    assert results(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_text_without_spaces_is_compared(spark):
    lines = ["本网站的内容仅供参考，版权所有，未经许可不得转载", "このサイトの内容は無断で転載することを禁じます", "สงวนลิขสิทธิ์ห้ามทำซ้ำเนื้อหาของเว็บไซต์นี้", "QUJDREVG" * 20]
    for n, line in enumerate(lines):
        rows = [(1, f"First words of mine are here.\n{line}"), (2, f"{line}\nOther words of mine are here."), (3, "短"), (4, "短")]
        got = {i: (s, t) for i, s, t in results(spark.createDataFrame(rows, "doc_id long, text string"))}
        assert got[1][0] == [] and got[2][0] == [(0, len(line))], n
        assert got[3][0] == got[4][0] == []


def removed_from_second(first, second):
    seen = {d for *_, d in ld.units(first, 5) if d}
    return sum(e - s for s, e, d in ld.units(second, 5) if d in seen)


def test_sentences_of_other_scripts_are_units():
    said = "本网站的内容仅供参考版权所有。未经许可不得转载或者复制本页！"
    assert removed_from_second("天地玄黄宇宙洪荒日月盈昃。" + said, "云腾致雨露结为霜金生丽水。" + said) == len(said)


@pytest.mark.parametrize("mark", [", ", " "])
def test_a_passage_of_one_long_sentence_in_mid_line(mark):
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = mark.join(some(8) for _ in range(30))
    one, two = f"{some(7)} {passage} {some(6)}.", f"{some(4)} {passage} {some(9)}."
    assert removed_from_second(one, two) >= 0.75 * len(passage)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, LINE, "h", 3)], "doc_id long, text string, h string, removed int")
    assert results(df) == [(1, [], LINE)]
    assert results(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.removed, r.text) for r in QUERIES["op7_line_hash_dedup"](spark, SMALL).collect()), key=str)
    assert got == sorted(((i, ",".join(f"{a}:{b}" for a, b in s), t) for i, s, t in brute(rows, LEAST_UNIT)), key=str)


def plain_units(text, least):
    """(start, end, key) by the rules as documented, for short ASCII sentences; keys are the words themselves."""
    out, run, at = [], None, 0
    for line in text.split("\n"):
        sentences, pos = [], 0
        for part in re.split(r"(?<=[.!?]) +", line.strip(" ")):
            if part:
                start = line.index(part, pos)
                pos = start + len(part)
                sentences.append((at + start, at + pos, part.lower().split()))
        groups, held = [], []
        for one in sentences:
            if held and (sum(len(h[2]) for h in held) >= least or len(one[2]) >= least):
                groups.append(held)
                held = []
            held.append(one)
            if sum(len(h[2]) for h in held) >= least:
                groups.append(held)
                held = []
        for group in groups + ([held] if held else []):
            words = [w for _, _, ws in group for w in ws]
            key = " ".join(words).strip(ld.EDGE)
            if key and len(words) >= least:
                run = (key,)
            elif run is not None:
                run = (*run, key)
            out.append((group[0][0], group[-1][1], run))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("least", [5, 8])
def test_equals_a_brute_force_of_its_own(spark, least):
    """Cutting, normalising and keeping the first, checked against words instead of digests."""
    rng = random.Random(least)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"])
    pool = [" ".join(word() for _ in range(rng.randrange(1, 13))).capitalize() + rng.choice(".!?") for _ in range(25)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join(lines)))
    seen, want = set(), []
    for i, t in rows:
        cut = []
        for start, end, key in plain_units(t, least):
            if key is not None:
                if key in seen:
                    cut.append((start, end))
                seen.add(key)
        rest, at = "", 0
        for a, b in cut:
            rest, at = rest + t[at:a], b
        want.append((i, cut, rest + t[at:]))
    assert results(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least) == sorted(want, key=str)


def test_a_text_of_very_many_repeated_lines(spark):
    """50,000 removed units of one text are cut out in seconds."""
    import time

    text = "\n".join(f"This line number {i % 1000} is one of many others." for i in range(50_000))
    began = time.time()
    got = results(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert len(got[0][1]) == 49_000 and got[0][2].strip("\n").count("\n") == 49_999 - 49_000 and time.time() - began < 60


@pytest.mark.parametrize("embed", ["line", "middle"])
def test_long_passages_go_from_all_but_the_first(spark, embed):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(3, 14))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    own = [" ".join(sentence() for _ in range(8)) for _ in range(40)]
    glue = "\n" if embed == "line" else " "
    rows = [(i, o + glue + passage + glue + sentence() if i % 2 else o) for i, o in enumerate(own)]
    got = {r.doc_id: r for r in ld.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed == 0 for i in range(0, 40, 2)) and got[1].n_removed == 0
    assert all(got[i].removed_chars >= 0.9 * len(passage) for i in range(3, 40, 2))
