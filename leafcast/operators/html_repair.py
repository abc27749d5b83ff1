"""H8: end tags put where a document leaves them out, stray ones taken away, as column expressions.

The tags of a document are folded with a stack of open elements, written as one string with the innermost name
first ("b/p/div/"). Rules, the same for every document:

  * void elements never open, and their end tags go; ``<x/>`` of another element is closed at once;
  * an end tag closes the nearest open element of its name and all that is open inside it. It goes if none is
    open, or if an element lies between that an end tag of this name does not reach through (``b`` through a cell);
  * a start tag first closes the open element it cannot stand in: a block a ``p``, an item, cell, row or option its
    sibling, with all that is open inside, unless a container of its own lies between;
  * what is open at the end is closed, innermost first.

Contents of ``script`` and ``style`` and comments are passed over whole. Work is linear in the tags, times the depth
of nesting: the fold runs over blocks of about the square root of the tags, so its output is not copied at each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafcast.functions import arrays

# Pieces of HTML, and elements by what they hold or close.
PIECE = (
    r"""(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>"""
    r"""|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
)
RAW_ELEMENT = r"(?is)^<(?:script|style)\b.*</(?:script|style)\s*>$"
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = tuple(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Start tags, the open elements they close, and the elements that keep these from being closed.
CLOSES = (
    (BLOCKS, ("p",), ("button", "caption", "table", "td", "th")),
    (("li",), ("li",), ("ol", "table", "ul")),
    (("dd", "dt"), ("dd", "dt"), ("dl", "table")),
    (("option",), ("option",), ("datalist", "select")),
    (("td", "th"), ("td", "th"), ("table", "tr")),
    (("tr",), ("tr",), ("table",)),
    (("tbody", "tfoot", "thead"), ("tbody", "tfoot", "thead"), ("table",)),
)
#: Elements by how far end tags reach: one closes nothing of a higher rank than its own.
RANKS = ((("div",), 1), (("td", "th"), 2), (("tr",), 3), (("tbody", "tfoot", "thead"), 4), (("table",), 5))

TEXT, START, END, EMPTY, STRAY = range(5)


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _listed(name: Column, cases) -> Column:
    """The array of names given for an element's name; no names if none are."""
    some = [(names, F.array(*map(F.lit, listed))) for names, listed in cases]
    return reduce(lambda out, c: out.when(name.isin(*c[0]), c[1]), some[1:], F.when(name.isin(*some[0][0]), some[0][1])).otherwise(_no_names())


def _token(p: Column) -> Column:
    """A piece with its element's name, what it is, the open elements it closes and those it does not reach through."""
    tag = F.startswith(p, F.lit("<")) & F.rlike(p, F.lit(r"^</?[A-Za-z]")) & ~F.rlike(p, F.lit(RAW_ELEMENT))
    name = F.when(tag, F.lower(F.regexp_extract(p, r"^</?([A-Za-z][^\s/>]*)", 1))).otherwise("")
    higher = tuple((names, tuple(n for ns, r in RANKS if r > rank for n in ns)) for names, rank in RANKS if rank < len(RANKS))
    ranked = tuple(n for names, _ in RANKS for n in names)

    def described(n: Column) -> Column:
        ends, void = F.startswith(p, F.lit("</")), n.isin(*VOID)
        kind = (
            F.when(n == "", TEXT).when(ends & void, STRAY).when(ends, END)
            .when(F.endswith(p, F.lit("/>")) & ~void, EMPTY).when(void, TEXT).otherwise(START)
        )
        closes = F.when(ends & void, _no_names()).when(ends, F.array(n)).otherwise(_listed(n, [(names, closed) for names, closed, _ in CLOSES]))
        kept = F.when(ends & ~n.isin(*ranked), F.array(*map(F.lit, ranked))).when(ends, _listed(n, higher))
        walls = kept.otherwise(_listed(n, [(names, w) for names, _, w in CLOSES]))
        return F.struct(p.alias("p"), n.alias("name"), kind.alias("kind"), closes.alias("closes"), walls.alias("walls"))

    return arrays.bound(name, described)


def _step(acc: Column, t: Column) -> Column:
    """The state (stack, out) after one token."""
    stack, ends = acc["stack"], t["kind"] == END
    # The innermost open element that the tag closes: its place in the stack, from 1; null if none is open.
    places = F.transform(t["closes"], lambda n: F.position(F.concat(F.lit("/"), n, F.lit("/")), F.concat(F.lit("/"), stack)))
    nearest = F.array_min(F.filter(places, lambda at: at > 0))

    def closing(at: Column) -> Column:
        """The inner elements, closed, the element's name and the stack below it; null if nothing is to be closed."""
        inner = F.when(at > 1, F.substring(stack, F.lit(1), at - 1)).otherwise("")
        rest = F.substring(stack, at, F.length(stack))
        name = F.substring_index(rest, "/", 1)
        return F.when(
            at.isNotNull() & ((at == 1) | ~F.arrays_overlap(t["walls"], F.split(inner, "/"))),
            F.struct(
                F.regexp_replace(inner, "([^/]+)/", "</$1>").alias("inner"), name.alias("name"),
                F.substring(rest, F.length(name) + 2, F.length(rest)).alias("stack"),
            ),
        )

    def after(c: Column) -> Column:
        below = F.coalesce(c["stack"], stack)
        closed = F.coalesce(F.concat(c["inner"], F.lit("</"), c["name"], F.lit(">")), F.lit(""))
        opened = F.when(t["kind"] == START, F.concat(t["name"], F.lit("/"), below)).otherwise(below)
        own = F.when(t["kind"] == EMPTY, F.concat(t["p"], F.lit("</"), t["name"], F.lit(">"))).otherwise(t["p"])
        piece = F.when(ends, closed).otherwise(F.concat(closed, own))
        return F.struct(opened.alias("stack"), F.array_append(acc["out"], piece).alias("out"))

    passed = F.struct(stack.alias("stack"), F.array_append(acc["out"], F.when(t["kind"] == STRAY, "").otherwise(t["p"])).alias("out"))
    done = F.when(t["kind"].isin(TEXT, STRAY) & (F.size(t["closes"]) == 0), passed)
    # The two common steps by themselves: a start tag that closes nothing, and the end tag of the innermost element.
    entered = F.struct(F.concat(t["name"], F.lit("/"), stack).alias("stack"), F.array_append(acc["out"], t["p"]).alias("out"))
    done = done.when((t["kind"] == START) & (F.size(t["closes"]) == 0), entered)
    left = F.struct(
        F.substring(stack, F.length(t["name"]) + 2, F.length(stack)).alias("stack"),
        F.array_append(acc["out"], F.concat(F.lit("</"), t["name"], F.lit(">"))).alias("out"),
    )
    done = done.when(ends & F.startswith(stack, F.concat(t["name"], F.lit("/"))), left)
    return done.otherwise(arrays.bound(arrays.bound(nearest, closing), after))


def balanced(html: Column) -> Column:
    """The document with every element closed in order and no stray end tags; NULL stays."""
    nothing = _no_names()

    def fold(tokens: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(tokens))).cast("int"), F.lit(1))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / size).cast("int")), lambda i: F.slice(tokens, i * size + 1, size)
        )

        def block(acc: Column, b: Column) -> Column:
            start = F.struct(acc["stack"].alias("stack"), nothing.alias("out"))
            done = F.aggregate(b, start, _step, lambda s: F.struct(s["stack"].alias("stack"), F.array_join(s["out"], "").alias("out")))
            return arrays.bound(done, lambda d: F.struct(d["stack"].alias("stack"), F.array_append(acc["out"], d["out"]).alias("out")))

        return F.aggregate(
            blocks, F.struct(F.lit("").alias("stack"), nothing.alias("out")), block,
            lambda s: F.concat(F.array_join(s["out"], ""), F.regexp_replace(s["stack"], "([^/]+)/", "</$1>")),
        )

    tokens = F.transform(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), _token)
    return arrays.bound(tokens, lambda ts: F.when(F.size(ts) > 0, fold(ts)).otherwise(html))
