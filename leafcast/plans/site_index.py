"""Entry A: types -> capped listing -> parents -> exclusions -> order -> authors.

``from_tables`` builds the index from the adapter views over a table folder; the
operators themselves only need DataFrames with the documented columns, so the same
functions run on captured responses (``leafcast.sources.captures``). Results bounded by the
listing cap are written while the plan is built (``materialize``) and shared by the branches
that follow; those branches stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafcast.functions import terms as fterms
from leafcast.operators import index as idx
from leafcast.operators import types as ty
from leafcast.options import Options
from leafcast.session import materialize, reuse
from leafcast.sources import adapters


@dataclass
class SiteIndex:
    types: DataFrame      # kept types with section order
    fetched: DataFrame    # capped listing with terms, before exclusions
    listed: DataFrame     # listing after exclusions, ranked, with display fields
    authors: DataFrame
    rows: DataFrame       # W3 rows
    summary: DataFrame    # G3 per type


def kept_types(spark: SparkSession, base: str, opts: Options) -> DataFrame:
    return ty.with_type_pos(ty.filter_types(adapters.types_v(spark, base), opts))


def fetched_posts(spark: SparkSession, base: str, opts: Options, types: DataFrame | None = None) -> DataFrame:
    """K1 over the kept types, then the embedded terms of the fetched posts only.

    The capped listing is bounded (cap x types per site), so it is materialized once
    in the checkpoint folder; terms, parents, authors and the summary all read it.
    """
    types = (types if types is not None else kept_types(spark, base, opts)).select("site", "type_key", "type_pos")
    posts = adapters.posts_v(spark, base).join(types, ["site", "type_key"], "inner")
    capped = materialize(idx.newest_per_type(posts, opts), "capped_listing")
    terms = adapters.terms_v(spark, base, ids=capped.select("id"))
    return capped.join(terms, "id", "left").withColumn("terms_flat", fterms.terms_flat(F.col("terms")))


def from_tables(spark: SparkSession, base: str, opts: Options, agent: bool = False) -> SiteIndex:
    """The whole site index. Every intermediate result here is bounded by the listing cap
    (or by the number of types), so each is materialized once and shared by all branches
    (rows, authors, summary, index lines) instead of being recomputed per branch."""
    counted = reuse(adapters.type_counts_v(spark, base))
    types = reuse(ty.with_type_pos(ty.filter_types(counted.drop("total_found"), opts)))
    fetched = fetched_posts(spark, base, opts, types)
    listed = reuse(idx.listing(fetched, opts, capped=True))
    authors = reuse(idx.authors(listed, adapters.users_v(spark, base)))
    rows = idx.index_rows(listed, authors, agent=agent)
    totals = adapters_totals(counted, opts)
    summary = reuse(ty.type_summary(types, totals, listed))
    return SiteIndex(types, fetched, listed, authors, rows, summary)


def adapters_totals(counts: DataFrame, opts: Options) -> DataFrame:
    """G2 for adapter posts: what the first page's headers would say (count, page count), from counted types."""
    pages = F.greatest(F.ceil(F.col("total_found") / F.lit(opts.per_page)), F.lit(1)).cast("bigint")
    return counts.select(
        "site", "type_key", F.col("total_found").cast("bigint").alias("total_found"), pages.alias("total_pages"),
        (pages > F.lit(int(opts.max_pages_per_type))).alias("truncated"),
    )


@dataclass
class CapturedIndex:
    index: SiteIndex
    types: DataFrame       # per kept type: class (readable / unreadable / fatal), error
    errors: DataFrame      # fatal fetch failures (the reference aborts; here they are rows)


def from_captures(spark: SparkSession, types_capture: DataFrame, collections: DataFrame, user_chunks: DataFrame,
                  opts: Options) -> CapturedIndex:
    """Entry A over captured responses: S1 -> F1-F4 -> F10/G2 on first pages -> P2 pages
    -> S2 -> listing -> S3/J2 authors -> summary.

    ``collections`` holds collection captures keyed ``type_key|page`` with ``type_key``
    and ``page`` columns. A type whose first page answered 401/404 is unreadable (listed
    by name); any other failed first page, or a failed / missing planned page, makes the
    type fatal: it is left out of the index and reported in ``errors``, as is a site whose
    types response failed. Every join is by site, and of several captures of one key the
    latest counts.
    """
    from leafcast.operators import types as ty
    from leafcast.plans import requests as rq
    from leafcast.sources import captures as cap

    collections = cap.latest_per_key(collections)
    types_capture = cap.latest_per_key(types_capture)
    types = reuse(ty.filter_types(ty.parse_type_map(types_capture), opts))
    first = types.join(collections.where(F.col("page") == 1).drop("site_name"), ["site", "type_key"], "left")
    readability = ty.type_readability(first.select("site", "type_pos", "type_key", "name", "status", "error"))
    totals = ty.type_totals(first, opts)
    readable = readability.where(F.col("class") == "readable").select("site", "type_key")
    planned = rq.next_pages(types, totals, readable, opts).select("site", "type_key", "page", "request_key")
    later = cap.keyed_results(planned, collections.select("site", "request_key", "status", "headers_raw", "body", "error"))
    failed_later = later.where(~F.col("success")).groupBy("site", "type_key").agg(
        F.min_by(F.concat(F.lit("slug: "), F.col("type_key"), F.lit(", page "), F.col("page").cast("string"), F.lit(", "),
                          F.col("error")), F.col("page")).alias("later_error"))
    report = reuse(
        readability.join(failed_later, ["site", "type_key"], "left").select(
            "site", "type_pos", "type_key", "name", "status",
            F.when(F.col("later_error").isNotNull(), F.lit("fatal")).otherwise(F.col("class")).alias("class"),
            F.coalesce(F.nullif(F.col("error"), F.lit("")), F.col("later_error"), F.lit("")).alias("error"),
        ))
    listable = report.where(F.col("class") == "readable").select("site", "type_key")
    pages = collections.join(planned.select("site", "type_key", "page").unionByName(
        types.select("site", "type_key", F.lit(1).alias("page"))), ["site", "type_key", "page"], "left_semi")
    posts = cap.collection_posts(cap.with_outcome(pages)).join(listable, ["site", "type_key"], "left_semi")
    posts = posts.join(types.select("site", "type_key", "type_pos", "slug", "rest_base"), ["site", "type_key"], "inner")
    fetched = materialize(posts.withColumn("terms_flat", fterms.terms_flat(F.col("terms"))), "captured_listing")
    listed = reuse(idx.listing(fetched, opts, capped=True))
    users = cap.users_from_chunks(user_chunks)
    authors = reuse(idx.authors(listed, users))
    rows = idx.index_rows(listed, authors)
    kept = types.join(listable, ["site", "type_key"], "left_semi")
    summary = reuse(ty.type_summary(kept, totals, listed))
    errors = report.where(F.col("class") == "fatal").select("site", "type_key", "error").unionByName(ty.type_map_errors(types_capture))
    return CapturedIndex(SiteIndex(kept, fetched, listed, authors, rows, summary), report, errors)
