"""Sources over captured HTTP responses.

A capture row is one fetched URL: ``site, request_key, kind, url, status, headers_raw,
body, error``. Bodies are JSON text and are parsed with ``from_json`` against explicit
schemas (no schema inference over the corpus).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast import schemas
from leafcast.functions import http, urls
from leafcast.session import materialize

TERM_T = schemas.TERMS
POST_SCHEMA = schemas.POST_JSON
USER_SCHEMA = schemas.USER_JSON


def with_outcome(captures: DataFrame) -> DataFrame:
    """Success flag, body only on success, error text ('' / 'HTTP <status>' / transport error)."""
    st = F.coalesce(F.col("status"), F.lit(0))
    return captures.withColumns({
        "success": http.is_success(st),
        "body": http.outcome_body(st, F.col("body")),
        "error": http.outcome_error(st, F.col("error")),
    })


def collection_posts(collections: DataFrame) -> DataFrame:
    """S2 + G6: posts of captured collection pages, one JSON array per page.

    Unparseable or non-array bodies count as an empty page. ``pos`` is the position in
    the page; (page, pos) is the fetch order used for stable ordering downstream.
    """
    parsed = collections.select(
        "site", "type_key", "page",
        F.coalesce(F.from_json("body", "array<" + POST_SCHEMA + ">"), F.array().cast("array<" + POST_SCHEMA + ">")).alias("items"),
    )
    exploded = parsed.select("site", "type_key", "page", F.posexplode("items").alias("pos", "p"))
    return exploded.select(
        "site", "type_key", "page", "pos",
        F.col("p.id").alias("id"),
        F.col("p.title.rendered").alias("title_raw"),
        F.col("p.link").alias("link"),
        F.col("p.date").alias("date"),
        F.col("p.date_gmt").alias("date_gmt"),
        F.coalesce(F.col("p.parent"), F.lit(0).cast("long")).alias("parent"),
        F.col("p.author").alias("author"),
        F.col("p._embedded.`wp:term`").alias("terms"),
    )


def users_from_chunks(user_captures: DataFrame) -> DataFrame:
    """S3 + J7: users from chunked lookups; failed chunks skipped; last record per id wins.

    ``chunk`` orders the responses (request order); within a body, array order. Of a chunk fetched again the last capture counts.
    """
    ok = with_outcome(latest_per_key(user_captures, ("site", "chunk"))).where(F.col("success"))
    items = ok.select(
        "site", "chunk",
        F.posexplode(F.coalesce(F.from_json("body", "array<" + USER_SCHEMA + ">"), F.array().cast("array<" + USER_SCHEMA + ">"))).alias("pos", "u"),
    ).where(F.col("u.id").isNotNull())
    return items.groupBy("site", F.col("u.id").alias("id")).agg(
        F.max_by(F.col("u"), F.struct("chunk", "pos")).alias("u")
    ).select("site", "id", F.col("u.name").alias("name"), F.col("u.description").alias("description"))


def full_post(post_captures: DataFrame) -> DataFrame:
    """One full post per capture; a failed fetch or an empty body is an error row under the capture's own id.

    A body that is no JSON object, or an empty one, is a failure; an object without an id is a post with id 0. Of captures of
    one key take the last first (``latest_per_key``).
    """
    c = with_outcome(post_captures)
    p = F.from_json("body", POST_SCHEMA)
    parsed = c.withColumn("p", p)
    has_keys = F.coalesce(F.size(F.json_object_keys("body")), F.lit(0)) > 0  # of a JSON object; null for anything else
    err = (
        F.when(~F.col("success"), F.lit("post_fetch_failed"))
        .when(~has_keys, F.lit("post_parse_failed"))
        .otherwise(F.lit(""))
    )
    return parsed.select(
        "site", "request_key", "rest_base",
        F.when(err == "", F.coalesce(F.col("p.id"), F.lit(0))).otherwise(F.col("id")).alias("id"),
        F.col("p.title.rendered").alias("title_raw"),
        F.coalesce(F.col("p.content.rendered"), F.lit("")).alias("content"),
        F.col("p.link").alias("link"),
        F.col("p.date_gmt").alias("date_gmt"),
        F.coalesce(F.try_element_at(F.col("p._embedded.author"), F.lit(1))["name"], F.lit("")).alias("author_name"),
        F.col("p._embedded.`wp:term`").alias("terms"),
        err.alias("error"),
    )


def site_name(root_captures: DataFrame) -> DataFrame:
    """The site's own name as its last root capture has it, else the host of the site URL."""
    c = with_outcome(latest_per_key(root_captures, ("site",)))
    name = F.when(F.col("success"), F.get_json_object("body", "$.name"))
    host = urls.url_host(F.col("site"))
    return c.select("site", F.coalesce(F.nullif(name, F.lit("")), host).alias("site_name"))


def _order(captures: DataFrame, keys: tuple[str, ...]) -> Column:
    """What ranks captures of one key: the time of the fetch, a success before a failure, the status, a hash of the row."""
    known = captures.columns
    at = F.coalesce(F.col("fetched_at"), F.lit(0)) if "fetched_at" in known else F.lit(0)
    status = F.coalesce(F.col("status"), F.lit(0)) if "status" in known else F.lit(0)
    others = [F.col(c) for c in known if c not in keys]
    return F.struct(
        at.cast("bigint").alias("at"), http.is_success(status).alias("ok"), status.cast("int").alias("status"), F.xxhash64(*others).alias("h")
    )


#: Keys with several captures up to this many are joined with the captures as they stand.
REFETCHED_KEYS = 100_000


def latest_per_key(captures: DataFrame, keys: tuple[str, ...] = ("site", "request_key")) -> DataFrame:
    """One capture per key: the one fetched last (``fetched_at``); at one time a success, then the greater status.

    Only keys are shuffled to find those that have several captures, and these are written. Up to ``REFETCHED_KEYS`` of them are
    joined with the captures as they stand: a body is moved only where a capture is there twice as it is. With more of them
    the captures are dealt by key, once, and each key's last one is taken where it is.
    """
    many = captures.groupBy(*keys).agg(F.count("*").alias("_all")).where("_all > 1")
    many = materialize(many.select(*(F.col(k).alias(f"_k_{k}") for k in keys)), "refetched")
    found = many.limit(REFETCHED_KEYS + 1).count()
    if not found:
        return captures
    if found > REFETCHED_KEYS:
        newest = Window.partitionBy(*keys).orderBy(F.col("_order").desc())
        dealt = captures.withColumn("_order", _order(captures, keys)).repartition(*keys)
        return dealt.withColumn("_place", F.row_number().over(newest)).where("_place = 1").select(*captures.columns)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    some = captures.join(F.broadcast(many), same, "left_semi")
    each = some.withColumn("_order", _order(captures, keys)).groupBy(*keys, "_order").agg(F.count("*").alias("_n"))
    tops = each.groupBy(*keys).agg(F.max(F.struct("_order", "_n")).alias("_t"))
    tops = materialize(tops.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_t._order").alias("_top"), F.col("_t._n").alias("_copies")), "last-captures")
    several = tops.agg(F.max("_copies")).first()[0]
    ranked = captures.withColumn("_order", _order(captures, keys))
    kept = ranked.join(F.broadcast(tops), same, "left").where(F.col("_top").isNull() | (F.col("_order") == F.col("_top")))
    if several == 1:
        return kept.select(*captures.columns)
    once = kept.where(F.coalesce("_copies", F.lit(1)) == 1)
    return once.select(*captures.columns).union(kept.where("_copies > 1").dropDuplicates([*keys]).select(*captures.columns))


def keyed_results(plan: DataFrame, captures: DataFrame) -> DataFrame:
    """One result per planned (site, request key), kept even when nothing was captured.

    ``captures`` holds one capture per key (``latest_per_key``).
    """
    c = with_outcome(captures).select(
        F.col("site").alias("_s"), F.col("request_key").alias("_k"), "status", "success", "error", "headers_raw", "body"
    )
    j = plan.join(c, (plan.site == c._s) & (plan.request_key == c._k), "left").drop("_s", "_k")
    return j.withColumns({
        "status": F.coalesce(F.col("status"), F.lit(0)),
        "success": F.coalesce(F.col("success"), F.lit(False)),
        "error": F.coalesce(F.col("error"), F.lit("not captured")),
    })
