"""Benchmark decontamination over a distributed positional inverted index.

The index is a written table of postings of the training texts: a term with its position and
the term after it, kept where the benchmark has these two side by side, and one closing posting per
document that carries its word count. Each benchmark window looks up its rarest pair of neighbours
first: that list, shifted by the pair's offset, gives the places where the window could begin;
the shifted lists of the other pairs are then intersected there, in the documents left over only.
Windows with a pair that no document has cannot occur and are dropped at once.

Near matches need no intact pair: they are anchored on each window's rarest word. Every place of such a word is
looked up with the words around it, which must hold all words of the window, in any order.

A window is ``size`` consecutive words of an item, or all of them if it has fewer. Words are
runs of letters, digits and characters beyond ASCII, with A-Z lowered.

Cases: a null or empty text has no words and is clean; an item without words has no
window; a long text is indexed whole; rows are kept apart by id and text, and equal rows
come out as often as they came in; an empty table on either side gives clean documents
or no rows; further columns are ignored here and kept by ``drop_contaminated``; a null item
id counts for hits but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.session import materialize

# Characters of a word, before lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The closing posting's term; no word is empty.
CLOSE = ""
#: A table with more rows than this is joined without a broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def lower_az(text: Column) -> Column:
    """A-Z lowered and nothing else; plain ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its row count is within bounds."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, window): the distinct windows of each item, as arrays of words."""
    w = words(lower_az(F.coalesce(items[text_col].cast("string"), F.lit(""))))
    rows = items.select(items[id_col].cast("string").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, d, h, w): (d, h) names a document by its id and a hash of id and text; w are its words, lowered, and the closing mark."""
    text, doc_id = docs[text_col].cast("string"), docs[id_col].cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("d"), F.xxhash64(doc_id, text).alias("h"),
        F.concat(words(lower_az(F.coalesce(text, F.lit("")))), F.array(F.lit(CLOSE))).alias("w"),
    )


def _pair_key(term: Column, after: Column) -> Column:
    return F.xxhash64(term, after)


def window_pairs(windows: DataFrame) -> DataFrame:
    """Rows (window_id, length, off, term, after, pair) of the neighbours in each window of two words or more."""
    parts = windows.where(F.size("window") > 1).select(
        "window_id", F.size("window").alias("length"),
        F.posexplode(F.arrays_zip(F.slice("window", 1, F.size("window") - 1).alias("term"), F.slice("window", 2, F.size("window")).alias("after"))).alias("off", "p"),
    )
    return parts.select("window_id", "length", "off", "p.term", "p.after", _pair_key(F.col("p.term"), F.col("p.after")).alias("pair"))


def build_index(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings (doc_id, d, h, pos, pair) of the given pairs (term, after, pair), and a null pair at each document's word count.

    ``rows``: as from ``_documents``.
    """
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    tokens = rows.select("doc_id", "d", "h", F.posexplode(zipped).alias("pos", "t"))
    tokens = tokens.select("doc_id", "d", "h", "pos", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    close = rows.sparkSession.range(1).select(F.lit(CLOSE).alias("term"), F.lit(None).cast("string").alias("after"), F.lit(None).cast("bigint").alias("pair"))
    wanted = pairs.select("term", "after", "pair").union(close).withColumn("key", _pair_key(F.col("term"), F.col("after")))
    return tokens.withColumn("key", _pair_key(F.col("a"), F.col("b"))).join(_small(materialize(wanted, "pairs")), "key").where(
        (F.col("a") == F.col("term")) & F.col("b").eqNullSafe(F.col("after"))
    ).select("doc_id", "d", "h", "pos", "pair")


def single_matches(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Matches of the windows of one word, which have no pair."""
    one = _small(materialize(windows.where(F.size("window") == 1).select("window_id", F.get("window", F.lit(0)).alias("term")), "single-windows"))
    rows = _documents(docs, id_col, text_col).select("d", "h", F.posexplode("w").alias("start", "term"))
    found = rows.join(one, "term")
    return found.select("d", "h", "window_id", "start", F.lit(1).alias("length")).distinct()


def phrase_matches(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact matches (d, h, window_id, start, length); ``pairs``: the pairs of the windows."""
    frequency = index.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.count("*").alias("df"))
    ranked = materialize(pairs.join(frequency, "pair", "left"), "window-pairs")
    alive = (
        ranked.groupBy("window_id", "length")
        .agg(F.min(F.struct("df", "off", "pair")).alias("rarest"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
        .where("least > 0").select("window_id", "length", "rarest.off", "rarest.pair")
    )
    alive = materialize(alive, "alive")
    places = index.join(_small(alive), "pair").select(
        "d", "h", "window_id", "length", (F.col("pos") - F.col("off")).alias("start")
    )
    places = materialize(places.distinct(), "places")
    held = _small(materialize(places.select("d", "h").distinct(), "held"))
    local = index.where(F.col("pair").isNotNull()).join(held, ["d", "h"], "left_semi").select("d", "h", "pos", "pair")
    local = materialize(local.distinct(), "local-postings")
    expected = places.where("start >= 0").join(ranked.select("window_id", "off", "pair"), "window_id")
    return (
        expected.withColumn("pos", F.col("start") + F.col("off")).join(local, ["d", "h", "pos", "pair"])
        .groupBy("d", "h", "window_id", "start", "length").agg(F.count("*").alias("n")).where("n = length - 1").drop("n")
    )


def near_matches(rows: DataFrame, windows: DataFrame, size: int, slop: int) -> DataFrame:
    """Near matches (d, h, window_id): every word of the window is within ``length - 1 + slop`` words of a place of its rarest word.

    ``rows``: written documents with their words lowered. The order of the words does not count, nor do words between them.
    """
    terms = materialize(windows.select("window_id", F.size("window").alias("length"), F.posexplode("window").alias("off", "term")), "window-terms")
    tokens = rows.select("d", "h", "w", F.posexplode("w").alias("pos", "term"))
    wanted = _small(materialize(terms.select("term").distinct(), "terms"))
    frequency = tokens.select("term").join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"))
    anchors = (
        terms.join(frequency, "term", "left").groupBy("window_id", "length")
        .agg(F.min(F.struct("df", "off", "term")).alias("rarest"), F.collect_set("term").alias("asked"))
        .where("rarest.df > 0").select("window_id", "length", "asked", F.col("rarest.term").alias("term"))
    )  # the rarest word of a window comes without a frequency if no document has it
    reach = size - 1 + slop
    at = F.least(F.col("pos"), F.lit(reach))
    around = tokens.select("d", "h", "term", at.alias("at"), F.slice("w", F.col("pos") - at + 1, at + reach + 1).alias("near"))
    span = F.col("length") - 1 + slop
    first = F.greatest(F.col("at") - span, F.lit(0))
    held = F.slice("near", first + 1, F.col("at") - first + span + 1)
    found = around.join(_small(materialize(anchors, "anchors")), "term").where(F.size(F.array_except("asked", held)) == 0)
    return found.select("d", "h", "window_id").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, d, h, n_words, n_hit, n_items, item_ids (sorted strings), and n_near_items with ``slop``."""
    of_items = materialize(
        benchmark_windows(items, size).select("item_id", "window", F.sha2(F.to_json(F.array("window")), 256).alias("window_id")), "windows"
    )
    windows = of_items.select("window_id", "window").dropDuplicates(["window_id"])
    pairs = materialize(window_pairs(windows), "benchmark-pairs")
    rows = _documents(docs, id_col, text_col)
    if slop is not None:
        rows = materialize(rows, "words")  # read three times
    index = materialize(build_index(rows, pairs.select("term", "after", "pair").distinct()), "postings")
    exact = phrase_matches(index, pairs)
    if windows.where(F.size("window") == 1).limit(1).count():
        exact = exact.union(single_matches(docs, windows, id_col, text_col))
    exact = materialize(exact, "matches")
    words_hit = (
        exact.select("d", "h", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    )
    names = of_items.select("window_id", "item_id").distinct()
    items_hit = (
        exact.select("d", "h", "window_id").distinct().join(names, "window_id").groupBy("d", "h")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )  # at most the benchmark's items
    whole = index.where(F.col("pair").isNull()).groupBy("d", "h").agg(F.any_value("doc_id").alias("doc_id"), F.max("pos").alias("n_words"), F.count("*").alias("m"))
    out = whole.join(words_hit, ["d", "h"], "left").join(items_hit, ["d", "h"], "left")
    columns = [
        "doc_id", "d", "h", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    ]
    if slop is not None:
        near = near_matches(rows, windows, size, slop)
        near_items = near.join(names, "window_id").groupBy("d", "h").agg(F.count_distinct("item_id").alias("n_near_items"))
        out = out.join(near_items, ["d", "h"], "left")
        columns.append(F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select(*columns).withColumn("n_items", F.size("item_ids").cast("bigint"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs."""
    bad = find_contamination(docs, items, size, None, id_col, text_col).where("n_hit > 0").select("d", "h").distinct()
    bad = _small(materialize(bad, "contaminated"))
    doc_id, text = docs[id_col].cast("bigint"), docs[text_col].cast("string")
    same = (F.coalesce(doc_id, F.lit(0)) == bad["d"]) & (F.xxhash64(doc_id, text) == bad["h"])
    return docs.join(bad, same, "left_anti")
