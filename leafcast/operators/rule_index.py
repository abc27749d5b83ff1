"""F7 with rules as a table: which titles match which rules, by an index of literals that the rules require.

A rule is an exact string or a delimited pattern (``functions.rules``); both are told apart by column expressions. Exact
strings are joined by equality. Of a pattern the literals are found that every match must hold: stretches of plain
characters outside groups, classes, alternations and optional parts. Each pattern is listed under the one of their
trigrams that the fewest titles hold, titles are looked up by their own trigrams, and the pairs that meet are verified by
the pattern itself. Patterns without such a literal are tested on every title, as no index can tell.

So the rules are never crossed with the titles. Trigrams are folded over upper and lower case, which only adds pairs to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.functions import arrays
from leafcast.functions import rules as fr
from leafcast.operators.html_jobs import spread
from leafcast.session import materialize

#: Tables of rules up to this many rows are marked for broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Patterns without a literal that one pass over the titles tests.
OPEN_RULES = 500

_BREAK = "\x01"
# Escapes with their arguments, and classes, which may begin with a closing bracket and hold escapes.
_ESCAPE = r"\\(?:x\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[pPN]\{[^}]*\}|[pP].|c.|0[0-7]{1,3}|k<[^>]*>|[0-9]+|.)"
_CLASS = r"\[\^?\]?(?:[^\]\[])*\]"
_GROUP = r"\([^()]*\)"
#: How deep groups may nest in a pattern whose literals are looked for.
_DEPTH = 6


def _punctuation(c: Column) -> Column:
    return c.rlike(r"^[!-/:-@\[\]^-`{-~]$")  # ASCII punctuation but for the backslash


def _compiles(pattern: Column) -> Column:
    """Whether Java's regex engine takes the pattern; null patterns do not."""
    return F.coalesce(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), F.lit(False))


def _translated(body: Column) -> Column:
    """Script names and named groups in Java's spelling."""
    name = r"([A-Z][a-z]{2,}(?:_[A-Za-z]+)*)\}"
    out = F.regexp_replace(body, r"\\p\{" + name, r"\\p{Is$1}")
    out = F.regexp_replace(out, r"\\P\{\^" + name, r"\\p{Is$1}")
    out = F.regexp_replace(out, r"\\(?:P\{|p\{\^)" + name, r"\\P{Is$1}")
    return F.replace(out, F.lit("(?P<"), F.lit("(?<"))


def compiled(rules: DataFrame, rule_col: str = "rule") -> DataFrame:
    """``rules`` with ``pattern`` (Java; null: an exact string), ``flags`` and ``problem`` (why a valid-looking rule cannot run, else null)."""
    value = F.col(rule_col)
    opener = F.substring(value, 1, 1)
    closer = opener
    for a, b in fr.BRACKETS.items():
        closer = F.when(opener == a, F.lit(b)).otherwise(closer)
    tail = F.call_function("substring_index", value, closer, F.lit(-1))  # what follows the last closer
    n_body = F.length(value) - F.length(tail) - 2
    mods = F.regexp_replace(tail, r"[ \n]", "")
    delimited = _punctuation(opener) & (n_body >= 0) & mods.rlike(f"^[{''.join(fr.INLINE_FLAGS)}{''.join(fr.UNSUPPORTED)}]*$")
    cut = rules.withColumns({"_body": F.when(delimited, F.substring(value, F.lit(2), n_body)), "_mods": F.when(delimited, mods)})
    cut = cut.withColumn("_body", F.when(_compiles(F.col("_body")), F.col("_body")).otherwise(_translated(F.col("_body"))))
    flags = F.concat(*(F.when(F.contains("_mods", F.lit(m)), F.lit(f)).otherwise("") for m, f in fr.INLINE_FLAGS.items()))
    unsupported = "".join(m for m, why in fr.UNSUPPORTED.items() if why)
    problem = (
        F.when(F.col("_body").rlike(fr.FOREIGN.pattern), F.lit("a construct that Java's regex engine lacks"))
        .when(F.col("_mods").rlike(f"[{unsupported}]"), F.lit("a modifier without a Java equivalent"))
    )
    ok = F.col("_body").isNotNull() & (_compiles(F.col("_body")) | F.col("_body").rlike(fr.FOREIGN.pattern))
    out = cut.withColumns({"problem": F.when(ok, problem), "flags": F.when(ok, flags)})
    prefix = F.when(F.col("flags") != "", F.concat(F.lit("(?"), F.col("flags"), F.lit(")"))).otherwise("")
    return out.withColumn("pattern", F.when(ok & F.col("problem").isNull(), F.concat(prefix, F.col("_body")))).drop("_mods").withColumnRenamed("_body", "body")


def folded(text: Column) -> Column:
    """One form for what any pattern may take as the same letter."""
    return F.translate(F.lower(F.upper(text)), "ςıſ\u212a\u0307", "σisk")


def _trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, which is evaluated once."""
    def cut(t: Column) -> Column:
        n = F.length(t) - 2
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    return arrays.bound(text, cut)


def required_trigrams(body: Column, flags: Column) -> Column:
    """Folded ASCII trigrams that every match of the pattern holds; empty where none is known."""
    plain = F.regexp_replace(body, _ESCAPE, _BREAK)
    plain = F.regexp_replace(plain, _CLASS, _BREAK)
    for _ in range(_DEPTH):
        plain = F.regexp_replace(plain, _GROUP, _BREAK)
    # An optional character is none; after a repeated one the run ends.
    plain = F.regexp_replace(plain, r"(?s).(?:[*?]|\{0?,[0-9]*\}|\{0\})[+?]?", _BREAK)
    plain = F.regexp_replace(plain, r"(?s)(.)(?:\+|\{[0-9]+(?:,[0-9]*)?\})[+?]?", "$1" + _BREAK)
    plain = F.regexp_replace(plain, r"[.^$]|[^\x00-\x7F]", _BREAK)
    unsure = F.contains(body, F.lit("\\Q")) | F.contains(flags, F.lit("x")) | plain.rlike(r"[|()\[\]{}*+?\\]")
    # Trigrams of the runs; those across a break are left out.
    grams = F.filter(_trigrams(folded(plain)), lambda g: ~F.contains(g, F.lit(_BREAK)))
    return F.when(unsure, F.array().cast("array<string>")).otherwise(grams)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows are within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rule_match(titles: DataFrame, rules: DataFrame, title_col: str = "title", rule_id: str = "rule_id", rule_col: str = "rule") -> DataFrame:
    """Rows of ``titles`` with a ``rule_id`` each, one per rule that matches the title (a null title counts as empty).

    Rules with a ``problem`` (see ``compiled``) match nothing; the caller reports them. ``titles`` is to be a table or a written result.
    """
    value = F.coalesce(F.col(title_col), F.lit(""))
    known = compiled(rules.select(F.col(rule_id).alias("rule_id"), F.col(rule_col).alias("_rule")), "_rule").where("_rule IS NOT NULL AND problem IS NULL")
    known = materialize(known.withColumn("grams", required_trigrams(F.col("body"), F.col("flags"))), "rules")
    columns = titles.columns
    titles = spread(titles, F.octet_length(value))  # a small file may hold many titles, and each costs some hundred steps
    exact = known.where("pattern IS NULL").select("rule_id", "_rule")
    parts = [titles.join(_small(exact), value == F.col("_rule")).select(*columns, "rule_id")]
    listed = known.where("size(grams) > 0 AND pattern IS NOT NULL")
    asked = materialize(listed.select(F.explode("grams").alias("gram")).distinct(), "rule-grams")
    if asked.limit(1).count():
        held = titles.select(F.explode(_trigrams(folded(value))).alias("gram")).join(_small(asked), "gram")
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        # A trigram that no title holds has no count: its rules match nothing.
        each = listed.select("rule_id", "pattern", F.explode("grams").alias("gram")).join(counts, "gram", "left")
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
        best = each.groupBy("rule_id", "pattern").agg(rarest.alias("r")).where("r.n > 0").select("rule_id", "pattern", F.col("r.gram").alias("gram"))
        best = _small(materialize(best, "rule-index"))
        met = titles.withColumn("gram", F.explode(_trigrams(folded(value)))).join(best, "gram")
        parts.append(met.where(F.rlike(value, F.col("pattern"))).select(*columns, "rule_id"))
    unlisted = known.where("size(grams) = 0 AND pattern IS NOT NULL").select("rule_id", "pattern").orderBy("rule_id").toLocalIterator()
    block: list = []
    for r in [*unlisted, None]:  # a pass over the titles per block of patterns
        if r is not None:
            block.append(r)
        if block and (r is None or len(block) == OPEN_RULES):
            hits = F.array_compact(F.array(*(F.when(value.rlike(b["pattern"]), F.lit(b["rule_id"])) for b in block)))
            parts.append(titles.withColumn("rule_id", F.explode(hits)).select(*columns, "rule_id"))
            block = []
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
