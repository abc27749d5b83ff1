"""exclusion rules -- a delimited regex such as '/^wp_/i' or an exact string.

Rules are a short list from the job options, so they are compiled once on the driver
into one Column predicate (an OR of ``rlike`` / equality tests); the data never leaves
the JVM.

A rule is a regex when it is non-empty, starts with an ASCII punctuation character and
parses as a delimited pattern: the same character closes it (or the matching bracket
for ``( [ { <``), only pattern modifiers follow, and the engine that will run it (Java's, through
``rlike``) compiles it. A pattern that no engine compiles is an exact string; one that
only another engine compiles, or that uses constructs Java lacks, is rejected loudly.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Bracket delimiters and the modifiers this compiler translates.
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}
INLINE_FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x", "u": "U"}
# Modifiers that are valid in a pattern but have no Java inline flag.
UNSUPPORTED = {"U": "ungreedy", "D": "dollar-end-only", "A": "anchored", "S": "", "X": "", "J": "", "n": ""}


# Constructs of delimited patterns that Java does not have.
FOREIGN = re.compile(r"\(\?(?:\||R|&|P>|\d)|\(\*|(?<!\\)(?:\\\\)*\\[Kg]")
# \p{Name} names a script or a category there; Java writes scripts \p{IsName}.
PROPERTY = re.compile(r"\\([pP])\{(\^?)([A-Z][a-z]{2,}(?:_[A-Za-z]+)*)\}")


class RuleError(ValueError):
    """A valid delimited pattern that cannot be expressed as a Java regex."""


@dataclass(frozen=True)
class Rule:
    text: str
    regex: str | None  # Java pattern when the rule is a regex, else None

    @property
    def is_regex(self) -> bool:
        return self.regex is not None


def _split_delimited(value: str) -> tuple[str, str] | None:
    if value == "" or value[0] not in string.punctuation or value[0] == "\\":
        return None
    opener = value[0]
    closer = BRACKETS.get(opener, opener)
    end = value.rfind(closer)
    if end <= 0:
        return None
    body, mods = value[1:end], value[end + 1:]
    if any(m not in INLINE_FLAGS and m not in UNSUPPORTED and m not in " \n" for m in mods):
        return None
    return body, mods


def compiles(pattern: str) -> bool:
    """Whether the engine behind ``rlike`` takes the pattern (a constant expression, so no job runs)."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except PySparkException:
        return False
    return True


def translated(body: str) -> str:
    """The same pattern in Java's spelling: script names and named groups."""
    body = PROPERTY.sub(lambda m: "\\" + ("P" if (m[1] == "P") != bool(m[2]) else "p") + "{Is" + m[3] + "}", body)
    return body.replace("(?P<", "(?<")


def is_regex(value: str) -> bool:
    """True when the value is a usable delimited pattern."""
    return compile_rule(value).is_regex


def compile_rule(value: str) -> Rule:
    parts = _split_delimited(value)
    if parts is None:
        return Rule(value, None)
    body, mods = parts
    if not compiles(body):
        body = translated(body)
    if FOREIGN.search(body):
        raise RuleError(f"rule {value!r}: the pattern uses a construct that Java's regex engine lacks")
    if not compiles(body):
        try:
            re.compile(body)
        except re.error:
            return Rule(value, None)
        raise RuleError(f"rule {value!r}: Java's regex engine does not compile the pattern")
    flags = "".join(INLINE_FLAGS[m] for m in mods if m in INLINE_FLAGS)
    bad = [UNSUPPORTED[m] or m for m in mods if m in UNSUPPORTED and UNSUPPORTED[m]]
    if bad:
        raise RuleError(f"rule {value!r}: modifier(s) {bad} have no Java equivalent")
    prefix = f"(?{flags})" if flags else ""
    return Rule(value, prefix + body)


def compile_rules(values: Iterable[str], trim: bool = False) -> list[Rule]:
    out = []
    for v in values or ():
        v = v.strip(" \t\n\r\x00\x0b") if trim else v
        out.append(compile_rule(v))
    return out


def matches_any(c: Column, rules: list[Rule]) -> Column:
    """OR of every rule on the column (NULL is matched as '')."""
    v = F.coalesce(c, F.lit(""))
    cond = F.lit(False)
    for r in rules:
        cond = cond | (v.rlike(r.regex) if r.is_regex else (v == F.lit(r.text)))
    return cond
