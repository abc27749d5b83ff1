import pytest
from pyspark.sql import functions as F

from leafcast.functions import rules as fr
from leafcast.operators import rule_index as ri
from leafcast.session import materialize

RULES = [
    "Hello", "/^wp_/", "/Sale$/i", "(PROMO\\d+)", "/a(?:b|c)def?gh/", "~foo.*bar~", "/x|y/", "/[abc]+/", "{colou?r}", "/ab{2}cd/", "/ab*cde/", "/ab+cde/", "/(?:one(?:two)?)three/",
    "/\\p{Lu}\\x{43}abc/u", "/unclosed(/", "", "/", "//", "/ /", "#k\\.html$#", "/straße|weg/iu", "/Été sale/iu", "/KELVIN/iu", "/IDEA/iu", "/\\Qa.b\\E/", "/a b c/x", "/[]a]bcd/", "/ab(?!c)xyz/",
    "/(?<n>w)idget/", "/(?P<n>w)idget/", "/^$/", "/\\d{3}-\\d{4}/", "/abc{0}def/", "/abc{0,2}def/", "/abc{1,2}def/", "/a\\/bcd/", "@wp@im", "\\weird\\", "/sigma σς/iu", "/end\n/",
]
TITLES = [
    None, "", "Hello", "hello", "wp_block", "Summer SALE", "sale", "see PROMO77", "abdefgh", "acdegh", "foo and bar", "barfoo", "x", "colour", "color", "abbcd", "abcd", "acde", "abcde", "abbbcde",
    "onethree", "onetwothree", "XCabc", "/unclosed(/", "k.html", "khtml", "Straẞe", "STRASSE", "étÉ Sale", "Kelvin", "İdea", "ıdea", "a.b", "abc", "]bcd", "abxyz", "widget",
    "555-1234", "abdef", "abcdef", "abccdef", "a/bcd", "WP", "\\weird\\", "sigma ΣΣ", "end\n", " ",
]


def test_compiled_equals_the_driver_side_rules(spark):
    got = {r.rule: (r.pattern, r.problem) for r in ri.compiled(spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()}
    for rule in RULES:
        want = fr.compile_rule(rule)
        assert got[rule] == (want.regex, None), rule


@pytest.mark.parametrize("rule", ["/a(?|b)c/", "/(?R)/", "/abc/U"])
def test_rules_that_cannot_run_are_reported(spark, rule):
    r = ri.compiled(spark.createDataFrame([(rule,)], "rule string")).first()
    assert r.pattern is None and r.problem
    with pytest.raises(fr.RuleError):
        fr.compile_rule(rule)


@pytest.mark.parametrize("open_rules", [3, 500])
def test_equals_every_rule_on_every_title(spark, monkeypatch, open_rules):
    monkeypatch.setattr(ri, "OPEN_RULES", open_rules)
    titles = materialize(spark.createDataFrame(list(enumerate(TITLES)), "i int, title string").repartition(3), "titles")
    rules = spark.createDataFrame(list(enumerate(RULES)), "rule_id int, rule string")
    got = sorted((r.i, r.rule_id) for r in ri.rule_match(titles, rules).collect())
    want = []
    for n, rule in enumerate(RULES):
        want += [(r.i, n) for r in titles.where(fr.matches_any(F.col("title"), [fr.compile_rule(rule)])).collect()]
    assert got == sorted(want)


def test_no_cross_join_and_empty_tables(spark):
    titles = materialize(spark.createDataFrame(list(enumerate(TITLES)), "i int, title string"), "titles")
    rules = spark.createDataFrame(list(enumerate(RULES)), "rule_id int, rule string")
    plan = ri.rule_match(titles, rules)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ri.rule_match(titles, rules.where("rule_id < 0")).count() == 0 and ri.rule_match(titles.where("i < 0"), rules).count() == 0




def test_titles_of_one_file_are_dealt_and_folded_once(spark):
    """Titles cost some hundred steps each, so those of one small file become many tasks, and their folded form is made once."""
    titles = materialize(spark.createDataFrame([(i, f"Hello {i} abcdefgh") for i in range(2000)], "i int, title string").coalesce(1), "titles")
    rules = spark.createDataFrame([(0, "/Hello/"), (1, "/[0-9]5/")], "rule_id int, rule string")
    got = ri.rule_match(titles, rules)
    assert got.count() == 2000 + sum(f"{i}"[-2:].endswith("5") and i >= 10 or any(c.isdigit() and d == "5" for c, d in zip(str(i), str(i)[1:])) for i in range(2000))
    if spark.sparkContext.defaultParallelism > 2:
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    plan = titles.select(ri._trigrams(ri.folded(F.col("title"))).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
