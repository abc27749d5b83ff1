"""Entry C data side: page URL -> post (X1, J5, J6, F15) and batch admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.functions import http, urls

# What is no element (comments, scripts, styles), <link> tags and attributes.
NO_ELEMENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINK_TAG = r"""(?i)<link\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def elements(html: Column) -> Column:
    """HTML without the text that only looks like elements."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), NO_ELEMENT, "")


def tag_attr(tag: Column, name: str) -> Column:
    """Value of one attribute of a start tag ('' when absent): quoted or bare, entities decoded.

    Attributes are read one after the other, so a name inside another's value is not one.
    """
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    at = F.array_position(names, F.lit(name)).cast("int")
    value = F.coalesce(F.when(at > 0, F.try_element_at(values, at)), F.lit(""))
    value = F.regexp_replace(value, r"""^["']|["']$""", "")
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def alternate_link(html: Column) -> Column:
    """X1 + K4: href of the first <link rel="alternate" title="JSON"> whose href is an API path."""
    links = F.regexp_extract_all(elements(html), F.lit(LINK_TAG), 0)
    ok = F.filter(
        links,
        lambda l: (tag_attr(l, "rel") == "alternate") & (tag_attr(l, "title") == "JSON")
        & tag_attr(l, "href").rlike(urls.API_PATH),
    )
    return tag_attr(F.try_element_at(ok, F.lit(1)), "href")


def resolve_targets(pages: DataFrame) -> DataFrame:
    """X1 + C12: (rest_base, id) from each page's alternate link; '' / 0 when there is none.

    The link is computed once per row, and the HTML is not carried on.
    """
    links = pages.withColumn("alt_href", F.coalesce(alternate_link(F.col("html")), F.lit(""))).drop("html")
    return links.withColumns({"rest_base": urls.api_rest_base(F.col("alt_href")), "id": urls.api_post_id(F.col("alt_href"))})


def valid_target(rest_base: Column, post_id: Column) -> Column:
    """a target needs a non-empty rest_base and an id above 0."""
    return (F.coalesce(rest_base, F.lit("")) != "") & (F.coalesce(post_id, F.lit(0)) > 0)


def resolve_pages(targets: DataFrame, posts: DataFrame) -> DataFrame:
    """Valid (rest_base, id) targets joined to the posts they name (misses kept).

    Invalid targets would all share one key ('', 0) -- possibly a large share of the pages.
    They get surrogate ids below 0, which no post has, spread by hash: one left join over one
    pass of the pages, and no hot key.
    """
    p = posts.select(
        F.col("site").alias("_psite"), F.col("rest_base").alias("_prb"), F.col("id").alias("_pid"),
        F.col("title").alias("post_title"),
    )
    t = targets.withColumn("valid", valid_target(F.col("rest_base"), F.col("id")))
    spread = -1 - F.pmod(F.xxhash64(*targets.columns), F.lit(1 << 40))
    t = t.withColumn("_jid", F.when(F.col("valid"), F.col("id")).otherwise(spread))
    return t.join(
        p, (F.col("site") == F.col("_psite")) & (F.col("rest_base") == F.col("_prb")) & (F.col("_jid") == F.col("_pid")), "left",
    ).withColumn("resolved", F.col("_pid").isNotNull()).drop("_psite", "_prb", "_pid", "_jid")


def redirect_once(captures: DataFrame) -> DataFrame:
    """A failed capture with a Location header follows it once, to a capture of that URL.

    The target must be on the capture's site (its whole base, path included); targets
    outside it are rejected; a target that was not captured counts as a failed fetch.
    No recursion: the target's own Location is ignored. Of several captures of a target the
    one with the smallest key counts, and only locations asked for enter the join.
    """
    c = captures.withColumn("_loc", F.try_element_at(http.header_map(F.col("headers_raw")), F.lit("location")))
    c = c.withColumn("success", http.is_success(F.coalesce(F.col("status"), F.lit(0))))
    hop = c.where(~F.col("success") & F.col("_loc").isNotNull())
    asked = hop.select(F.col("_loc").alias("url")).distinct()
    targets = (
        captures.select("url", "request_key", "status").join(asked, "url", "left_semi")
        .groupBy("url").agg(F.min(F.struct("request_key", "status")).alias("t"))
        .select(F.col("url").alias("_turl"), F.col("t.request_key").alias("target_key"), F.col("t.status").alias("target_status"))
    )
    j = hop.join(targets, F.col("_loc") == F.col("_turl"), "left")
    internal = urls.same_site(F.col("site"), F.col("_loc"))
    t_ok = http.is_success(F.coalesce(F.col("target_status"), F.lit(0)))
    outcome = (
        F.when(~internal, F.lit("url_must_be_internal"))
        .when(F.col("target_key").isNull(), F.lit("page_fetch_failed"))
        .when(~t_ok, F.lit("page_fetch_failed"))
        .otherwise(F.lit(""))
    )
    return j.select(
        "request_key", "status", F.col("_loc").alias("location"), internal.alias("internal"),
        F.when(internal, F.col("target_key")).alias("target_key"),
        F.when(internal, F.col("target_status")).alias("target_status"),
        outcome.alias("error"),
    )


def batch_admission(requests: DataFrame) -> DataFrame:
    """a batch runs only when every URL in it is on its site; else nothing in it runs.

    ``requests`` has ``batch_id, base, request_key, url``. Returns one row per batch
    with its verdict; the rejected URLs are available with ``rejected_urls``.
    """
    ok = urls.same_site(F.col("base"), F.col("url"))
    return requests.withColumn("_ok", ok).groupBy("batch_id").agg(
        F.bool_and("_ok").alias("admitted"),
        F.count(F.lit(1)).alias("n_urls"),
        F.sum(F.when(F.col("_ok"), 0).otherwise(1)).alias("n_rejected"),
    )


def rejected_urls(requests: DataFrame) -> DataFrame:
    """F9 quarantine: the offending rows themselves (for an error report)."""
    return requests.where(~urls.same_site(F.col("base"), F.col("url")))
