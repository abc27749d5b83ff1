"""Scalars and lists of the front matter; a reader of YAML gets back the string that went in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafcast.functions.text import UNICODE_WS

# A string that matches one of these patterns is written in double quotes.
QUOTE_TRIGGERS = (
    UNICODE_WS,
    r":",
    r"(?:^|[ \t\n\x0B\f\r])#",
    r"""[\[\]{}&*!|>'"%@`,]""",
    r"^[-?:]",
    r"(?i)^(?:true|false|null|yes|no|on|off|~)$",
    r"^[+-]?(?:\d+\.?\d*|\.\d+)$",
)


def needs_quote(v: Column) -> Column:
    cond = v == ""
    for pattern in QUOTE_TRIGGERS:
        cond = cond | v.rlike(pattern)
    return cond


def yaml_scalar(v: Column) -> Column:
    """A string value: as is, or in double quotes with backslash and quote escaped."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(needs_quote(v), quoted).otherwise(v)


def yaml_int(v: Column) -> Column:
    """An integer value: its decimal digits, never quoted."""
    return v.cast("long").cast("string")


def yaml_list(arr: Column) -> Column:
    """A list of strings: '[ a, b ]', or '[]' when empty."""
    items = F.array_join(F.transform(arr, yaml_scalar), ", ")
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[ "), items, F.lit(" ]")))
