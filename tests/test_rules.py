"""rule kinds and rule predicates."""

import pytest
from pyspark.sql import functions as F

from leafcast.functions import rules


@pytest.mark.parametrize(("value", "kind"), [
    ("~draft-\\d+~", True), ("%x|y%s", True), ("[ab]i", True), ("<t>", True), ("/\\p{Han}+/u", True), ("/\\x{3000}/u", True),
    ("/^a\\h/", True), ("/(?P<year>\\d{4})/", True), ("/(?<n>x)/", True), ("/\\P{^Greek}/u", True),
    ("plain", False), ("", False), ("~open", False), ("\\d\\", False), ("/a/q", False), ("/(/", False), ("/[z-a]/", False), ("/*/", False),
])
def test_kind(spark, value, kind):
    assert rules.is_regex(value) is kind


@pytest.mark.parametrize("value", ["~a~U", "/a/A", "/(?|a|b)/", "/a\\Kb/", "/(?R)/", "/(*ANYCRLF)a/"])
def test_what_java_lacks_is_rejected(spark, value):
    with pytest.raises(rules.RuleError):
        rules.compile_rule(value)


def test_rules_on_dataframe(spark):
    compiled = rules.compile_rules(["~^tmp-~", "feed", "%SALE%i", " /end$/ ", "/^\\p{Han}/u"], trim=True)
    values = ["tmp-1", "feed", "feeds", "big sale", "week-end", "漢字", "page", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.m for r in df.orderBy("i").select(rules.matches_any(F.col("v"), compiled).alias("m")).collect()]
    assert got == [True, True, False, True, True, True, False, False]
