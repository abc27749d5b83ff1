"""Request planning as data (P1-P4): the URLs the reference would fetch, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafcast.functions import dates
from leafcast.options import Options

# The fields a collection query asks for.
COLLECTION_FIELDS = "&_fields=id,title,link,date,date_gmt,parent,author,_links.wp:term,_embedded.wp:term"
USERS_PER_REQUEST = 100


def collection_url(site, rest_base, page, per_page: int):
    """Collection endpoint URL; per_page clamped to 1..100."""
    pp = max(1, min(100, int(per_page)))
    return F.concat(
        site, F.lit("/wp-json/wp/v2/"), rest_base, F.lit(f"?per_page={pp}&page="), page.cast("string"),
        F.lit("&orderby=date&order=desc&_embed=wp:term" + COLLECTION_FIELDS),
    )


def first_pages(types: DataFrame, opts: Options) -> DataFrame:
    """One first-page request per kept type, keyed by the type key."""
    return types.select(
        "site", "type_key", F.col("type_key").alias("request_key"),
        collection_url(F.col("site"), F.col("rest_base"), F.lit(1), opts.posts_per_page).alias("url"),
    )


def next_pages(types: DataFrame, totals: DataFrame, readable: DataFrame, opts: Options) -> DataFrame:
    """Pages 2..min(total_pages, cap) of readable types, keyed 'type|page'."""
    t = types.join(totals, ["site", "type_key"], "inner").join(readable.select("site", "type_key"), ["site", "type_key"], "left_semi")
    end = F.least(F.col("total_pages"), F.lit(int(opts.max_pages_per_type))).cast("int")
    # sequence(2, 1) counts down, so keep only pages up to the end.
    pages = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), end)), lambda p: p <= end)
    return t.select("site", "type_key", "rest_base", F.explode(pages).alias("page")).select(
        "site", "type_key", "page",
        F.concat(F.col("type_key"), F.lit("|"), F.col("page").cast("string")).alias("request_key"),
        collection_url(F.col("site"), F.col("rest_base"), F.col("page"), opts.posts_per_page).alias("url"),
    )


def user_chunks(author_latest: DataFrame) -> DataFrame:
    """User lookup URLs, ids in newest-author order, 100 per request.

    ``author_latest`` has ``site, author_id, latest_gmt, first_seen``; the order is
    latest post desc, first seen on ties. Each chunk holds at most 100 ids.
    """
    w = Window.partitionBy("site").orderBy(dates.gmt_sort_key(F.col("latest_gmt")).desc(), F.col("first_seen").asc())
    ranked = author_latest.withColumn("_rn", F.row_number().over(w))
    chunked = ranked.withColumn("chunk", ((F.col("_rn") - 1) / USERS_PER_REQUEST).cast("int"))
    g = chunked.groupBy("site", "chunk").agg(F.sort_array(F.collect_list(F.struct("_rn", "author_id"))).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda x: x["author_id"].cast("string")), ",")
    return g.select(
        "site", "chunk", F.size("ids").alias("n_ids"),
        F.concat(F.col("site"), F.lit("/wp-json/wp/v2/users?include="), ids, F.lit("&per_page=100&_fields=id,name,description")).alias("url"),
    )


def post_url(site, rest_base, post_id):
    """Single-post endpoint with embedded author and terms."""
    return F.concat(site, F.lit("/wp-json/wp/v2/"), rest_base, F.lit("/"), post_id.cast("string"), F.lit("?_embed=author,wp:term"))
