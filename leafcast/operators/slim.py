"""H1-H9: slimming HTML as column expressions, on tags and text as they stand in the source.

A document is cut at its ``pre`` and ``code`` blocks and, between them, into tags and text. Tags are
rewritten one by one: attributes filtered, ``rel`` completed, names lowered. Text outside the
blocks has its white space collapsed. Before that, elements are closed in order (``html_repair``);
text keeps its entities.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafcast.functions import arrays, text
from leafcast.operators.html_repair import balanced

# Pieces of HTML, attributes, and the white space that text collapses.
BLOCK = r"(?is)<pre\b[^>]*>.*?</pre\s*>|<code\b[^>]*>.*?</code\s*>"
PIECE = r"""(?s)<!--.*?-->|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
ATTRIBUTE = r"""([^\s=/>"'<]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
PROLOGUE = r"(?is)<!doctype[^>]*>|<\?[^>]*>|<head\b.*?</head\s*>"
SPACES = r"[\t\n\x0B\f\r\x{85}\x{180E}\p{Z}]"
#: Runs of white space other than one space, which stays as it is.
SPACE = rf"(?: {SPACES}+|(?! ){SPACES}{SPACES}*+)"
RAW_TEXT = ("script", "style")


def is_tag(piece: Column) -> Column:
    return F.startswith(piece, F.lit("<")) & F.rlike(piece, F.lit(r"^</?[A-Za-z]"))  # text is told by its first character


def tag_name(piece: Column) -> Column:
    """Lower-case name of a start or end tag, '' for text and comments."""
    return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))


def drop_elements(html: Column, tags: tuple[str, ...]) -> Column:
    """H3: elements of the given names, contents included.

    ``script`` and ``style`` hold plain text up to their end tag. Others nest: the text between
    their tags is kept where as many have been closed as opened, by running sums over these tags.
    """
    out = html
    for tag in (t.lower() for t in tags if t.lower() in RAW_TEXT):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)|</{tag}\s*>", "")
    nested = [t.lower() for t in tags if t.lower() not in RAW_TEXT]
    if not nested:
        return out
    pattern = r"(?is)</?(?:" + "|".join(nested) + r")\b[^>]*>"
    parts = F.arrays_zip(F.split(out, pattern, -1).alias("gap"), F.regexp_extract_all(out, F.lit(pattern), F.lit(0)).alias("tag"))

    def change(x: Column) -> Column:
        closes, empty = F.startswith(x["tag"], F.lit("</")), F.endswith(x["tag"], F.lit("/>"))
        return F.when(x["tag"].isNull() | empty, 0).when(closes, -1).otherwise(1)

    def kept(ps: Column) -> Column:
        # A depth that never falls below 0: the sum so far less the lowest sum so far.
        sums = arrays.running_sums(F.transform(ps, change))
        with_low = arrays.bound(sums, lambda s: F.zip_with(s, arrays.running(s, F.lit(0), F.least), lambda at, low: at - F.least(at, low)))
        return F.array_join(F.zip_with(ps, with_low, lambda p, depth: F.when(depth == 0, p["gap"]).otherwise("")), "")

    return arrays.bound(parts, kept)


def slim_tag(tag: Column, keep: tuple[str, ...]) -> Column:
    """H4 + H5 + H8: a start tag with the kept attributes only, ``rel`` with noreferrer beside an href, double quotes."""
    name = tag_name(tag)
    rest = F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*|/?>$", "")
    names = F.transform(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.transform(
        F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(2)),
        lambda v: F.replace(F.regexp_replace(v, r"""^["']|["']$""", ""), F.lit('"'), F.lit("&quot;")),
    )
    pairs = F.filter(
        F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), v.alias("v"))),
        lambda p: p["n"].isin([k.lower() for k in keep]) if keep else F.lit(False),
    )

    def written(ps: Column) -> Column:
        has = lambda n: F.exists(ps, lambda p: p["n"] == n)

        def one(p: Column) -> Column:
            words = F.filter(F.split(p["v"], r"\s+"), lambda w: w != "")
            full = F.when(F.array_contains(words, "noreferrer"), words).otherwise(F.array_append(words, F.lit("noreferrer")))
            value = F.when((p["n"] == "rel") & has("href"), F.array_join(full, " ")).otherwise(p["v"])
            return F.concat(F.lit(" "), p["n"], F.lit('="'), value, F.lit('"'))

        added = F.when(has("href") & ~has("rel"), F.lit(' rel="noreferrer"')).otherwise("")
        return F.concat(F.array_join(F.transform(ps, one), ""), added)

    # The pairs are bound as an element, so they are read from the tag once; a tag without attributes skips them.
    attributes = F.get(F.transform(F.array(pairs), written), F.lit(0))
    return F.concat(F.lit("<"), name, F.when(F.contains(tag, F.lit("=")) | F.rlike(tag, F.lit(r"\s")), attributes).otherwise(""), F.lit(">"))


def _rewritten(html: Column, keep: tuple[str, ...], unwrap: tuple[str, ...], collapse: bool) -> Column:
    """H4-H8 on one stretch of HTML."""
    pieces = F.regexp_extract_all(html, F.lit(PIECE), F.lit(0))
    if unwrap:
        pieces = F.filter(pieces, lambda p: ~(is_tag(p) & tag_name(p).isin([t.lower() for t in unwrap])))

    def piece(p: Column) -> Column:
        words = F.regexp_replace(p, SPACE, " ") if collapse else p
        return (
            F.when(~F.startswith(p, F.lit("<")) | (p == "<"), words)
            .when(~is_tag(p), p)
            .when(F.startswith(p, F.lit("</")), F.concat(F.lit("</"), tag_name(p), F.lit(">")))
            .otherwise(slim_tag(p, keep))
        )

    return F.array_join(F.transform(pieces, piece), "")


def slim(html: Column, keep: tuple[str, ...], drop: tuple[str, ...], unwrap: tuple[str, ...]) -> Column:
    """H3-H9 on HTML whose wrapper tags are gone already; blank input as it is."""
    source = drop_elements(F.regexp_replace(html, PROLOGUE, ""), drop)
    return F.when(text.php_trim(html) == "", html).otherwise(arrays.bound(balanced(source), lambda s: _slimmed(s, keep, unwrap)))


def _slimmed(source: Column, keep: tuple[str, ...], unwrap: tuple[str, ...]) -> Column:
    """H4-H9 on balanced HTML."""
    between = F.transform(F.split(source, BLOCK, -1), lambda s: _lines(_rewritten(s, keep, unwrap, True)))
    blocks = F.transform(F.regexp_extract_all(source, F.lit(BLOCK), F.lit(0)), lambda b: _rewritten(b, keep, unwrap, False))
    joined = F.zip_with(between, blocks, lambda s, b: F.concat(s, F.coalesce(b, F.lit(""))))
    return text.php_trim(F.array_join(joined, ""))


def _lines(html: Column) -> Column:
    """H9: no white space around line ends, no blank lines; blocks are not touched."""
    return arrays.bound(html, lambda h: F.when(F.contains(h, F.lit("\n")), F.regexp_replace(h, r"[ \t\r\x00\x0B]*\n[ \t\n\r\x00\x0B]*", "\n")).otherwise(h))
