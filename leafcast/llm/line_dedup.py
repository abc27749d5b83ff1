"""Substring deduplication by hashing lines and sentences.

A text is cut into units at line ends and after sentence ends; short sentences of a line that follow
each other are taken together. A sentence of over ``LONG_WORDS`` words is cut at commas as well, and
before words chosen by their hash where there are none, so that a passage within it has units of its own.
In scripts without spaces and in long runs, characters count as words. Units are normalised (lower case,
white space made one space, the edges stripped of marks) and digested to 128 bits; over all documents
the earliest occurrence of a digest stays (by document id, null last, then hash of the text, then
offset), and the others are removed. A unit of fewer than ``min_words`` words repeats by chance, so it counts
together with the units before it, back to the last one that is long enough: it goes only where
this whole run is a repetition. Offsets of what was removed are kept, in code points of the original.

Texts are cut once, into a written table of units. Very frequent digests, which a sample of it shows, are found by
an aggregate and looked up in every task; the others by a window over their digest. Both rules are the same and cover
all units.

Cases: a null text stays null, an empty one empty; long texts are cut whole; of rows with one id and text
all get what the first gets, as if they were one document; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.functions import arrays
from leafcast.session import bound_batches, materialize

CUT = re.compile(r"[^\S\n]*\n\s*|(?<=[.!?])[^\S\n]+")
#: Sentence ends that need no space after them, and the cut of texts that have any.
ENDS = "。！？｡؟۔।॥"
WIDE = re.compile(f"[{ENDS}]")
CUT_WIDE = re.compile(rf"{CUT.pattern}|(?<=[{ENDS}])(?![{ENDS}])[^\S\n]*")
#: A sentence of more words is cut at commas, and where a part is still longer before the words whose hash is 0 modulo HASH_CUT.
LONG_WORDS, HASH_CUT = 50, 12
COMMA = re.compile(r"(?<=[,;:])[^\S\n]+|(?<=[、，；：،])[^\S\n]*")
WORD = re.compile(r"\S+")
#: Characters of scripts written without spaces; so many count as a word, as do so many of any other run.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNSPACED_WORD, LONG_RUN = 2, 20
EDGE = " \t.,;:!?\"'()[]-*#$%&|"
#: Share of the units sampled for frequent digests, and the rows there that make one frequent.
SAMPLE, HOT_ROWS = 0.02, 100
#: Frequent digests are looked up in a broadcast table up to this many.
BROADCAST_ROWS = 500_000

UNIT_SCHEMA = "doc_id bigint, h bigint, start int, end int, digest binary"


def n_words(said: list[str], enough: int) -> int:
    """Words of a unit: exact below ``enough``, else at least that."""
    if len(said) >= enough:
        return len(said)
    n = 0
    for w in said:
        wide = 0 if w.isascii() else len(UNSPACED.findall(w))
        n += max(1, wide // UNSPACED_WORD + (len(w) - wide) // LONG_RUN)
    return n


def _pieces(text: str, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentence, or of its parts if it is a very long one; white space between parts is left out."""
    if stop - at <= 2 * LONG_WORDS or n_words(text[at:stop].split(), LONG_WORDS + 1) <= LONG_WORDS:
        yield at, stop
        return
    for m in [*COMMA.finditer(text, at, stop), None]:
        end, after = (m.start(), m.end()) if m else (stop, stop)
        if end > at:
            if n_words(text[at:end].split(), LONG_WORDS + 1) > LONG_WORDS:
                yield from _hashed(text, at, end)
            else:
                yield at, end
        at = after


def _hashed(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a long run of words, cut before the words whose hash says so: the same words give the same cuts anywhere."""
    last = at
    for m in WORD.finditer(text, at, end):
        word = m.group()
        if crc32(word.lower().strip(EDGE).encode("utf-8", "surrogatepass")) % HASH_CUT == 0 and m.start() > at:
            yield at, last
            at = m.start()
        if not word.isascii() and len(UNSPACED.findall(word)) > LONG_WORDS:  # unspaced: cut before such characters
            for i in range(m.start() + 1, m.end()):
                if crc32(text[i - 1 : i + 1].encode("utf-8", "surrogatepass")) % HASH_CUT == 0 and i > at:
                    yield at, i
                    at = i
        last = m.end()
    if end > at:
        yield at, end


def units(text: str, min_words: int) -> list[tuple[int, int, bytes | None]]:
    """(start, end, digest) of each unit; no digest for a short unit without a longer one before it.

    A unit is a sentence, or several short ones of a line that come together to ``min_words``.
    """
    out: list[tuple[int, int, bytes | None]] = []
    run = None
    first, words = 0, []  # short sentences gathered so far

    def put(start: int, end: int, said: list[str]) -> None:
        nonlocal run
        plain = " ".join(said).strip(EDGE).encode()
        if plain and n_words(said, min_words) >= min_words:
            run = blake2b(plain, digest_size=16)
        elif run is not None:
            run.update(b"\n" + plain)
        out.append((start, end, run and run.digest()))

    at = last = 0
    cut = CUT if text.isascii() or not WIDE.search(text) else CUT_WIDE
    for m in [*cut.finditer(text), None]:
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        for start, end in _pieces(text, at, stop) if stop > at else ():
            said = text[start:end].lower().split()
            if words and (n_words(words, min_words) >= min_words or n_words(said, min_words) >= min_words):
                put(first, last, words)
                words = []
            first = first if words else start
            words, last = words + said, end
        line_ends = m is None or "\n" in m.group()
        if last > first and (line_ends or n_words(words, min_words) >= min_words):
            put(first, last, words)
            words = []
            first = last
        at = after
    return out


def _cutter(min_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "h", "start", "end", "digest"])  # noqa: B023
                for c in cols:  # noqa: B023
                    c.clear()
                return out

            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for start, end, digest in units(text.as_py() or "", min_words):
                    if digest is not None:
                        for c, v in zip(cols, (doc, h, start, end, digest), strict=True):
                            c.append(v)
                if len(cols[0]) > 20_000:
                    yield flush()
            yield flush()

    return cut


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "start")


def repeated_spans(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, h, start, end): the units that are not the earliest of their digest; h is the hash of the text."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # The texts are read and cut once; what follows works on the written units, a few dozen bytes each.
    every = materialize(bound_batches(rows).mapInArrow(_cutter(min_words), UNIT_SCHEMA), "units")
    frequent = every.select("digest").sample(SAMPLE, seed=5).groupBy("digest").count().where(F.col("count") >= HOT_ROWS).select("digest")
    frequent = materialize(frequent, "frequent-digests")
    n_frequent = frequent.limit(BROADCAST_ROWS + 1).count()
    found = None
    if n_frequent:
        names = F.broadcast(frequent) if n_frequent <= BROADCAST_ROWS else frequent
        first = materialize(every.join(names, "digest").groupBy("digest").agg(F.min(_rank()).alias("first")), "frequent-firsts")
        table = F.broadcast(first) if n_frequent <= BROADCAST_ROWS else first
        later = every.join(table, "digest").where(_rank() > F.col("first"))
        found = later.select("doc_id", "h", "start", "end").distinct()
        every = every.join(names, "digest", "left_anti")
    w = Window.partitionBy("digest").orderBy(F.col("doc_id").isNull(), "doc_id", "h", "start")
    # Equal rows share a rank, so that none of them counts as the later one.
    rare = every.withColumn("place", F.rank().over(w)).where("place > 1").select("doc_id", "h", "start", "end").distinct()
    return rare if found is None else rare.union(found)


def deduplicate(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, n_removed (units), removed_chars, removed (array of start, end), text (what stays)."""
    spans = materialize(repeated_spans(docs, min_words, id_col, text_col), "repeated-spans")
    # A document's spans are bounded by its own text.
    lists = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("h").alias("span_h")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    out = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("h") == F.col("span_h")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = out.select("doc_id", "text", F.coalesce("removed", none).alias("removed"))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.size("removed").cast("bigint").alias("n_removed"),
        size.alias("removed_chars"), "removed", F.when(F.size("removed") > 0, arrays.without_spans(F.col("text"), F.col("removed"))).otherwise(F.col("text")).alias("text"),
    )
