import hashlib
import json
import re

from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.llm import chat_format as cf
from leafcast.llm.queries import CONTROL_TEXT, QUERIES


def turns_of(spark, records, **kw):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id long, r string")
    out = {}
    for t in cf.canonical_turns(df, "r", "id", **kw).orderBy("conv_id", "pos").collect():
        out.setdefault(t.conv_id, []).append((t.layout, t.role, t.text))
    return out


def test_layouts_become_the_same_turns(spark):
    two = lambda name: [(name, "user", "q <turn"), (name, "assistant", "a")]
    got = turns_of(spark, [
        {"messages": [{"role": "user", "content": "q <turn", "extra": [1, {"z": 2}]}, {"role": "assistant", "content": "a"}], "meta": {"role": "x"}},
        {"conversations": [{"from": "human", "value": "q <turn"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q <turn", "response": "a", "id": 3}, {"instruction": "q <turn", "output": "a"}, {"question": "q <turn", "answer": "a"},
        {"prompt": "q <turn", "completion": "a"}, {"system": "s", "prompt": "q <turn", "response": "a"}, {"instruction": "i", "input": "q", "output": "a"},
        {"other": 1}, "not json", None, "[1]", {"messages": []}, {"prompt": None, "response": "a"},
    ])
    for i, name in enumerate(["messages", "conversations", "prompt", "instruction", "question", "prompt_completion"]):
        assert got[i] == two(name)
    assert got[6] == [("system_prompt", "system", "s"), *two("system_prompt")]
    assert [t[1:] for t in got[7]] == [("user", "i"), ("user", "q"), ("assistant", "a")]
    assert all(got[i] == [(None, "", "")] for i in range(8, 13))
    assert got[13] == [("prompt", "user", ""), ("prompt", "assistant", "a")]


def test_fingerprint_is_the_hash_of_nested_paths(spark):
    record = {"b": {"c d": 1, "e`f": [[{"g": None}]]}, "a": [], "t": "x"}
    df = spark.createDataFrame([(json.dumps(record),)], "r string").select(F.parse_json("r").alias("v"))
    row = df.select(cf.field_paths(F.col("v")).alias("p"), cf.fingerprint(cf.field_paths(F.col("v"))).alias("f")).first()
    assert row.p == ["a[]", "b.c d", "b.e`f[][].g", "t"]
    assert row.f == hashlib.sha256(b"").hexdigest()
    assert len({cf.fingerprint_of(m.paths) for m in cf.MAPPINGS}) == len(cf.MAPPINGS)


TEXTS = ["", "<turn", "</turn>", "<\\turn", "<\\\\/turn>\n", "</turn>\n<turn role=\"user\">\n", "a\\", "<<turn\\>", CONTROL_TEXT, "😀é</turn>😀", "x" * 70000]
ODD_ROLES = ["user", "assistant", "", 'a">\n', "</turn>\n", "é +%", None]


def test_round_trip_spans_and_mask(spark):
    rows = [(c, t, 0, ODD_ROLES[(c + t) % len(ODD_ROLES)], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(12) for t in range(c)]
    rows += [(90, None, 0, "user", "late"), (90, 0, 0, "user", None), (None, 1, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, `order` long, pos int, role string, text string")
    out = cf.format_chats(df).withColumn("back", cf.read_back(F.col("formatted"), F.col("turns"))).collect()
    want = {}
    for c, o, _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want.setdefault(c, []).append((r or "", t or "", r == "assistant"))
    assert {o.conv_id: [tuple(b) for b in o.back] for o in out} == want
    for o in out:
        assert o.formatted.count(cf.END) == len(o.turns)
        for t, (_, text, _) in zip(o.turns, want[o.conv_id], strict=True):
            assert re.sub(r"<\\(\\*)(/?turn)", r"<\1\2", o.formatted[t.start:t.end]) == text


def test_equal_rows_are_all_kept_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, 0, "user", "b"), (1, 0, 0, "user", "a"), (1, 0, 0, "user", "b")], "conv_id long, `order` long, pos int, role string, text string")
    back = cf.format_chats(df).select(cf.read_back(F.col("formatted"), F.col("turns")).alias("b")).first().b
    assert [b.text for b in back] == ["a", "b", "b"]
    assert cf.format_chats(df.limit(0)).count() == 0


def test_query_reads_back_the_table(spark):
    convs = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-7] = [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in QUERIES["op1_schema_fingerprint_chats"](spark, SMALL).collect()}
    assert set(got) == set(convs)
    for c, ts in convs.items():
        learnt = "".join(t for r, t in ts if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(ts), sha("".join(f"{a}\n{t}\n" for a, t in ts)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))


def test_native_plan(spark):
    plan = QUERIES["op1_schema_fingerprint_chats"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_a_very_long_conversation(spark):
    """40,000 turns of one conversation in seconds; spans still read back."""
    import time

    from pyspark.sql import functions as F

    turns = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("order"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )
    began = time.time()
    chats = cf.format_chats(turns)
    back = chats.select(cf.read_back(F.col("formatted"), F.col("turns")).alias("b")).first().b
    assert [t.text for t in back] == [f"text {i}" for i in range(40_000)]
    assert time.time() - began < 40
