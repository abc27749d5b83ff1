"""Array columns in far less than the square of their length: running values, searches, pieces of long texts.

Spark copies the state of a fold at every step, so a fold that appends to its result takes the square of the length. ``running``
folds over pieces of the array instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a text's pieces.
PIECE_CHARS = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of an expression that is evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, zero: Column, plus: Callable[[Column, Column], Column], item_type: str = "bigint") -> Column:
    """Array of what came before each element: ``plus`` over all elements before it, starting from ``zero``.

    ``plus`` is associative with ``zero`` as its neutral element. The array is cut into about as many pieces as a piece has
    elements: pieces are folded each for itself, then their totals, and both are put together.
    """
    none = F.array().cast(f"array<{item_type}>")

    def before(vs: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            return F.struct(plus(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        return F.aggregate(vs, F.struct(zero.cast(item_type).alias("at"), none.alias("out")), step)

    def whole(vs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(vs))).cast("int"), F.lit(1))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / size).cast("int")), lambda i: F.slice(vs, i * size + 1, size))
        return bound(
            F.transform(pieces, before),
            lambda done: F.flatten(F.zip_with(
                done, before(F.transform(done, lambda d: d["at"]))["out"], lambda d, start: F.transform(d["out"], lambda v: plus(start, v))
            )),
        )

    return bound(values, lambda vs: F.when(F.size(vs) > 0, whole(vs)).otherwise(none))


def running_sums(values: Column) -> Column:
    """Sums of the elements before each one, as bigint."""
    return running(values, F.lit(0), lambda a, b: a + b)


def n_below(ordered: Column, x: Column) -> Column:
    """How many elements of an array in ascending order are less than ``x``, by halving."""
    steps = F.ceil(F.log2(F.size(ordered) + F.lit(1.0))).cast("int")

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low, open_ = F.get(ordered, mid) < x, acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~low, mid).otherwise(acc["hi"]).alias("hi")
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))
    return F.when(F.size(ordered) > 0, F.aggregate(F.sequence(F.lit(1), steps), start, half, lambda acc: acc["lo"])).otherwise(F.lit(0))


def text_pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE_CHARS`` code points, for ``cut_from``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))


def cut_from(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (excluded) of a text given in pieces; reads only the pieces that hold them."""
    n = PIECE_CHARS
    first, last = F.floor(start / n).cast("int"), F.floor((end - 1) / n).cast("int")
    head = F.substring(F.get(pieces, first), F.pmod(start, F.lit(n)).cast("int") + 1, F.least(end - start, F.lit(n)).cast("int"))
    tail = F.substring(F.get(pieces, last), F.lit(1), F.pmod(end - 1, F.lit(n)).cast("int") + 1)
    inner = F.when(last - first > 1, F.array_join(F.slice(pieces, first + 2, last - first - 1), "")).otherwise("")
    return F.when(end <= start, F.lit("")).when(first == last, head).otherwise(F.concat(head, inner, tail))


def without_spans(text: Column, spans: Column) -> Column:
    """Text without the spans (start, end), which are in order and do not overlap."""
    froms = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    tos = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return bound(text_pieces(text), lambda p: F.array_join(F.zip_with(froms, tos, lambda a, b: cut_from(p, a, b)), ""))
