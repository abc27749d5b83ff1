"""N-gram Jaccard join by vertical partitioning.

A global order of the n-grams, that of their 64-bit hashes, is cut into fragments, and every
document's set into the segments that fall into them. A pair's overlap is counted in each
fragment by itself, and the partial overlaps are summed per pair.

The fragments also tell which documents can have a partner at all. Sets of sizes a and b with Jaccard
similarity t or more differ in at most D = (1-t)/(1+t)*(a+b) n-grams. With k > D fragments, some segments
must be equal; k leaves room for empty segments, which are not used (a set with more empty segments
than that room is also listed under a key for such sets). k depends on the size class of the
larger set, so a set is listed for its own class and those of its possible larger partners. Small
sets, whose segments would be too short, are listed by the triples or pairs among their first n-grams, of
which two similar sets must share one. Documents that are alone in all their lists drop out.

Pairs of the others come from their rarest n-grams: similar sets share one among the first
of the order by frequency, and where the first one they share stands bounds the overlap. So a copy
with many n-grams of its own meets nobody. These rules are exact: no pair is lost.

Documents with equal sets are one node from the start. The nodes of a list are first compared
with its centre, the node with the fewest n-grams of its own, then those left over with a centre among
them; only nodes that are still in different components are compared pair by pair. So a large group of
near copies costs about as many comparisons as it has members, and components come out as if all pairs
had been compared.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; with
fewer words than n, the whole sequence is the one n-gram; long texts are taken whole; equal rows
are linked; an empty table gives no rows; further columns are ignored; a row with a null id
takes part, its component being the smallest id that is not null, if any. Sets are known by a
64-bit hash with their size, n-grams by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafcast.llm.common import components, lowered, mix, text_chunks, word_hashes
from leafcast.session import bound_batches, materialize

#: A size class spans lo..lo * CLASS_RATIO.
CLASS_RATIO = 1.45
#: Fragments in which overlaps are counted.
COUNT_FRAGMENTS = 8
#: A table with more rows than this is joined without a broadcast.
BROADCAST_ROWS = 2_000_000
#: A list of which so many rows turn up in a sample of SAMPLE is sought by an aggregate, not a window.
HOT_SAMPLE_ROWS, SAMPLE = 200, 0.02

_U = np.uint64
_CLASS = _U(127)


@dataclass(frozen=True)
class SizeClass:
    no: int
    lo: int
    hi: int
    fragments: int  # 0: listed by combinations of the first n-grams
    empties: int
    together: int


@lru_cache(maxsize=64)
def size_classes(num: int, den: int, upto: int) -> tuple[SizeClass, ...]:
    """Classes of sizes from 1 to ``upto`` and beyond, for the threshold num/den."""
    out, lo = [], 1
    while lo <= upto:
        hi = max(lo, int(lo * CLASS_RATIO))
        differ = (den - num) * 2 * hi // (den + num)
        fragments = empties = 0
        for room in range(2, 3 * differ + 3):
            k = differ + 1 + room
            expected = k * float(np.exp(-lo / k))
            if expected + 4 * expected**0.5 + 1 <= room:
                fragments, empties = k, room
                break
        least = -(-num * lo // den)  # the smallest partner
        free = hi - (-(-num * hi // den))
        together = 3 if comb(free + 3, 3) <= 60 else 2
        together = max(1, min(together, -(-num * least // den)))
        out.append(SizeClass(len(out), lo, hi, fragments, empties, together))
        lo = hi + 1
    return tuple(out)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text, in order."""
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    for first, end, data, offsets in text_chunks(column):
        hashes, row, _, _ = word_hashes(lowered(data), offsets)
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
            for i in range(n):
                whole += mix(hashes[i:len(hashes) - n + 1 + i] + factors[i]) * factors[i]
        whole = mix(whole)
        for i in range(end - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield first + i, np.unique(whole[a:b - n + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    few = sum((mix(hashes[a + j:a + j + 1] + factors[j]) * factors[j] for j in range(b - a)), np.full(1, b - a, np.uint64))
                yield first + i, mix(few)
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_digest(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(h ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64).reshape(1) + _U(len(h)))[0].astype(np.int64))


def signatures(h: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, need, keys) under which a set of sorted hashes is listed: a similar set shares ``need`` of the keys of one class.

    The class is held in the low bits of its keys.
    """
    n = len(h)
    largest = n * den // num
    out: list[tuple[int, int, np.ndarray]] = []
    if n <= 2:
        return out
    for c in size_classes(num, den, 1 << max(4, largest.bit_length())):
        if c.hi < n or c.lo > largest:
            continue
        tag, need = _U(c.no + 1) << _U(40), 1
        with np.errstate(over="ignore"):
            if c.fragments:
                frag = ((h >> _U(32)) * _U(c.fragments)) >> _U(32)
                starts = np.flatnonzero(np.append(True, frag[1:] != frag[:-1]))
                sums = np.add.reduceat(mix(h ^ _U(0xE7037ED1A0B428DB)), starts)
                keys = mix(sums + mix(frag[starts] + tag))
                empty = c.fragments - len(starts)
                differ = (den - num) * (n + min(c.hi, largest)) // (den + num)
                need = max(1, c.fragments - differ - empty)
                if empty > c.empties:
                    keys = np.append(keys, mix(np.full(1, tag, np.uint64)))
            else:
                m = min(c.together, n)
                first = h[:n - (-(-num * n // den)) + m]
                picks = np.array(list(combinations(range(len(first)), m)))
                keys = mix(mix(first[picks]).sum(axis=1, dtype=np.uint64) + mix(np.full(1, tag, np.uint64)))
        out.append((c.no, need, ((keys & ~_CLASS) | _U(c.no)).view(np.int64)))
    return out


def _profiler(n: int, num: int, den: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size, needs = [], [], []
            for _, h in shingle_sets(batch.column(1), n):
                v.append(set_digest(h) if len(h) else None)
                size.append(len(h))
                needs.append([{"c": c, "need": need} for c, need, _ in signatures(h, num, den)])
            kind = pa.list_(pa.struct([("c", pa.int32()), ("need", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(v, pa.int64()), pa.array(size, pa.int64()), pa.array(needs, kind)],
                ["doc_id", "h", "v", "n", "needs"],
            )

    return profile


def _lister(n: int, num: int, den: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, parts, held = [], [], 0
            for _, h in shingle_sets(batch.column(0), n):
                for _, _, k in signatures(h, num, den):
                    v.append(np.full(len(k), set_digest(h), np.int64))
                    parts.append(k)
                    held += len(k)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(v))], ["key", "v"])
                    v, parts, held = [], [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(v))], ["key", "v"])

    return keys


def _segmenter(n: int, fragments: int):
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, frag, parts = [], [], []
            for _, h in shingle_sets(batch.column(0), n):
                if not len(h):
                    continue
                cuts = np.searchsorted(((h >> _U(32)) * _U(fragments)) >> _U(32), np.arange(fragments + 1, dtype=np.uint64))
                for f in range(fragments):
                    if cuts[f] < cuts[f + 1]:
                        v.append(set_digest(h))
                        frag.append(f)
                        parts.append(h[cuts[f]:cuts[f + 1]].view(np.int64))
                if len(v) >= 4096:
                    yield _segments(v, frag, parts)
                    v, frag, parts = [], [], []
            if v:
                yield _segments(v, frag, parts)

    return segment


def _segments(v, frag, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.int64()), pa.array(frag, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["v", "fragment", "segment"]
    )


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its row count is within bounds."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def listed_together(texts: DataFrame, needs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The sets v that share as many keys with others as a similar set must share with them.

    ``texts``: one text per set; ``needs``: (v, c, need). One shuffle by key finds the keys that are shared, with a
    window. A key that a sample shows to be very frequent is left out of the window, so that no such list is one
    task's sort: it has more sets than one.
    """
    listed = lambda t: t.mapInArrow(_lister(n, num, den), "key bigint, v bigint")
    rows = listed(texts)
    hot = listed(texts.sample(SAMPLE, seed=11)).groupBy("key").count().where(F.col("count") >= HOT_SAMPLE_ROWS).select("key")
    hot = materialize(hot, "hot-keys")
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    cold = rows
    if n_hot:
        keys = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        cold = rows.join(keys, "key", "left_anti")
    w = Window.partitionBy("key").orderBy("v")
    found = cold.select("key", "v", F.lag("v").over(w).alias("last"), F.lead("v").over(w).alias("next")).where("last IS NOT NULL OR next IS NOT NULL")
    found = found.select("key", "v")
    if n_hot:
        found = found.union(rows.join(keys, "key", "left_semi").select("key", "v"))
    shared = found.groupBy("v", F.col("key").bitwiseAND(F.lit(int(_CLASS))).cast("int").alias("c")).agg(F.count("*").alias("shared"))
    return materialize(shared.join(needs, ["v", "c"]).where("shared >= need").select("v").distinct(), "listed")


def rare_lists(segments: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, v, pos, n, own): the n-grams under which the sets are compared.

    They are the first of each set in the order by frequency among the sets given; ``pos`` is the place in that
    order, ``n`` the set's size and ``own`` its n-grams that no other set has.
    """
    grams = segments.select("v", F.explode("segment").alias("key"))
    counts = grams.groupBy("key").agg(F.count("*").alias("sets"))
    whole = Window.partitionBy("v")
    ranked = grams.join(counts, "key").select(
        "key", "v", "sets", (F.row_number().over(whole.orderBy("sets", "key")) - 1).alias("pos"),
        F.count("*").over(whole).alias("n"), F.sum((F.col("sets") == 1).cast("int")).over(whole).alias("own"),
    )
    first = (F.col("pos") <= F.floor(F.col("n") * (den - num) / den)) & (F.col("sets") > 1)
    return materialize(ranked.where(first).select("key", "v", "pos", "n", "own"), "lists")


def verified(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose overlap, counted per fragment and summed, reaches the threshold."""
    left = segments.select(F.col("v").alias("a"), "fragment", F.col("segment").alias("s"))
    right = segments.select(F.col("v").alias("b"), "fragment", F.col("segment").alias("t"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"], "left").select(
        "a", "b", F.coalesce(F.size(F.array_intersect("s", "t")), F.lit(0)).alias("both"),
    )
    sums = partial.groupBy("a", "b").agg(F.sum("both").alias("both"))
    sizes = segments.groupBy("v").agg(F.sum(F.size("segment")).alias("n"))
    sized = sums.join(sizes.select(F.col("v").alias("a"), F.col("n").alias("n_a")), "a").join(
        sizes.select(F.col("v").alias("b"), F.col("n").alias("n_b")), "b"
    )
    return sized.where(den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10),
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), h, root.

    ``threshold`` is a fraction of at least a half: documents link when the Jaccard similarity of their
    sets of ``n``-word shingles reaches it. ``h`` hashes the text; ``root`` names the component (null: empty set).
    """
    num, den = threshold
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    profiles = materialize(
        bound_batches(rows).mapInArrow(_profiler(n, num, den), "doc_id bigint, h bigint, v bigint, n bigint, needs array<struct<c:int,need:int>>"), "profiles"
    )
    # Of equal sets, one row stands for all; the smallest id names them.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "needs")).alias("one")
    reps = profiles.where("v IS NOT NULL").groupBy("v").agg(one)
    reps = materialize(reps.select("v", F.col("one.doc_id").alias("rep"), F.col("one.h").alias("rep_h"), "one.needs"), "sets")
    able = reps.where(F.size("needs") > 0)
    needs = able.select("v", F.explode("needs").alias("x")).select("v", "x.c", "x.need")
    repeated = profiles.groupBy("doc_id", "h").count().where("count > 1").limit(1).count() > 0

    def texts_of(sets: DataFrame) -> DataFrame:
        chosen = _small(materialize(sets.select("rep", "rep_h"), "chosen"))
        found = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")), "left_semi")
        return (found.dropDuplicates(["doc_id", "h"]) if repeated else found).select("text")

    wanted = listed_together(texts_of(able), needs, n, num, den)
    segments = materialize(
        texts_of(reps.join(wanted, "v"))
        .mapInArrow(_segmenter(n, COUNT_FRAGMENTS), "v bigint, fragment int, segment array<bigint>").dropDuplicates(["v", "fragment"]),
        "segments",
    )
    lists = rare_lists(segments, num, den)
    roots = None
    seen: DataFrame | None = None
    # The first common n-gram's places bound the overlap from above.
    possible = f"least(n - pos, c_n - c_pos) * {den + num} >= {num} * (n + c_n)"
    for last in (False, False, True):
        if roots is None:
            members = lists.withColumn("root", F.col("v"))
        else:
            members = lists.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        live = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        members = members.join(live, "key")
        centre = F.struct("own", "v", "root", "n", "pos")
        if roots is not None and not last:
            head = members.groupBy("key").agg(F.min(centre).alias("c")).select("key", F.col("c.root").alias("head"))
            members = members.join(head, "key").where("root <> head").drop("head")
        members = materialize(members.select("key", "v", "root", "n", "pos", "own"), "live")
        if last:
            centres = members.select("key", F.struct(*(F.col(c).alias(c) for c in ("own", "v", "root", "n", "pos"))).alias("c"))
        else:
            centres = members.groupBy("key").agg(F.min(centre).alias("c"))
        centres = centres.select("key", F.col("c.v").alias("c_v"), F.col("c.root").alias("c_root"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"))
        other = "root <> c_root AND v < c_v" if last else "root <> c_root"
        pairs = members.join(centres, (members["key"] == centres["key"]) & F.expr(f"{other} AND {possible}"))
        pairs = pairs.select(F.least("v", "c_v").alias("a"), F.greatest("v", "c_v").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        seen = pairs if seen is None else seen.union(pairs)
        links = verified(pairs, segments, num, den)
        if roots is not None:
            for side in ("a", "b"):
                to = roots.select(F.col("node").alias(side), F.col("root").alias("r"))
                links = links.join(to, side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
        links = materialize(links, "links")
        joined = components(links)
        if roots is None:
            roots = joined
        else:
            step = joined.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = roots.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            new = joined.join(roots.select("node"), "node", "left_anti")
            roots = materialize(known.union(new), "roots")
    classes = reps if roots is None else reps.join(roots.withColumnRenamed("node", "v"), "v", "left")
    classes = classes.withColumn("root", F.col("v") if roots is None else F.coalesce("root", "v"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_sets = classes.join(least, "root").select("v", "root", "component_id")
    return profiles.select("doc_id", "h", "v", "n").join(of_sets, "v", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "root",
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), then the smallest hash of the text.

    Rows with an empty set are linked with nothing and all stay.
    """
    rows = materialize(jaccard_components(docs, n, threshold, id_col, text_col), "components")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"), F.count("*").alias("m")
    )
    keys = first.select("k.doc_id", "k.h").union(rows.where("root IS NULL").select("doc_id", "h").distinct())
    keys = keys.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"))
    copies = rows.where("root IS NOT NULL").groupBy("doc_id", "h").count().where("count > 1")
    copies = copies.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"))

    def among(table: DataFrame) -> DataFrame:
        same = docs[id_col].cast("bigint").eqNullSafe(table["kept_id"]) & (F.xxhash64(docs[text_col].cast("string")) == table["kept_h"])
        return docs.join(table, same, "left_semi")

    both = F.col("kept_id").eqNullSafe(F.col("copy_id")) & (F.col("kept_h") == F.col("copy_h"))
    renamed = copies.select(F.col("kept_id").alias("copy_id"), F.col("kept_h").alias("copy_h"))
    single = _small(materialize(keys.join(renamed, both, "left_anti"), "kept"))
    kept = among(single)
    repeated = materialize(keys.join(renamed, both, "left_semi"), "kept-copies")
    if repeated.limit(1).count():
        kept = kept.unionByName(among(_small(repeated)).dropDuplicates([id_col, text_col]))
    return kept
