"""Site index operators: newest-N listing, parent titles, exclusions, ordering, authors.

Inputs follow ``leafcast.schemas``: ``posts`` rows carry ``site, type_key, id,
title_raw, link, date, date_gmt, parent, author`` (plus ``page, pos`` when they come
from captured collection pages). Every operator is a DataFrame -> DataFrame function;
the plan stays lazy until the caller writes or collects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.functions import dates, rules, text, urls
from leafcast.operators.numbering import numbered
from leafcast.options import Options



def newest_per_type(posts: DataFrame, opts: Options) -> DataFrame:
    """K1 + K5: newest ``per_page x max_pages`` posts per (site, type) by (date desc, id desc).

    Two-level top-N: per (site, type, partition group), then per (site, type) over the
    survivors. The first level groups rows by the partition that holds them
    (``spark_partition_id``, stable when a task is retried) modulo ``listing_fanout``, so
    the second level sees at most fan-out x cap rows per type however large the type is. Both windows are filtered on their row number, which Catalyst plans as a
    ``WindowGroupLimit`` on each side of the shuffle (partial top-N before it).
    Adds ``page`` (1-based) and ``pos`` (0-based), the fetch position of each post.
    """
    cap = opts.listing_cap
    order = [F.col("date").desc_nulls_last(), F.col("id").desc_nulls_last()]
    grouped = posts.withColumn("_grp", F.spark_partition_id() % int(opts.listing_fanout))
    w1 = Window.partitionBy("site", "type_key", "_grp").orderBy(*order)
    stage1 = grouped.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= cap)
    w2 = Window.partitionBy("site", "type_key").orderBy(*order)
    rn = F.col("_rn")
    kept = [c for c in posts.columns if c not in ("page", "pos")]
    return stage1.withColumn("_rn", F.row_number().over(w2)).where(rn <= cap).select(
        *kept,
        (((rn - 1) / opts.per_page).cast("int") + 1).alias("page"),
        ((rn - 1) % opts.per_page).cast("int").alias("pos"),
    )


def page_of_post(posts: DataFrame, opts: Options) -> DataFrame:
    """K5 for all posts: ``page`` (1-based) and ``pos`` (0-based) in the newest-first order of their type, whatever its size.

    Places come from ranges of the order and counts per range; no task and no window holds a type.
    """
    order = [F.col("date").desc_nulls_last(), F.col("id").desc_nulls_last()]
    placed = numbered(posts, ["site", "type_key"], order, "_place")
    place = F.col("_place")
    return placed.select(*posts.columns, (F.floor(place / opts.per_page) + 1).cast("bigint").alias("page"), (place % opts.per_page).alias("pos"))


def with_flat_titles(posts: DataFrame) -> DataFrame:
    """C3 on every fetched post."""
    return posts.withColumn("title", text.title_flat(F.col("title_raw")))


def with_parent_titles(fetched: DataFrame) -> DataFrame:
    """Parent id -> parent title within the same (site, type), over fetched posts.

    Runs before exclusions, so an excluded post still names its children's parent.
    A duplicate id keeps the title fetched last (highest page, pos). A parent id that
    was not fetched gives ''. Posts without a parent (parent <= 0) get ''.
    """
    titles = fetched.groupBy("site", "type_key", "id").agg(
        F.max_by("title", F.struct("page", "pos")).alias("_ptitle")
    ).select(F.col("site").alias("_tsite"), F.col("type_key").alias("_ttype"), F.col("id").alias("_pid"), "_ptitle")
    joined = fetched.join(
        titles,
        (F.col("site") == F.col("_tsite")) & (F.col("type_key") == F.col("_ttype")) & (F.col("parent") == F.col("_pid")),
        "left",
    ).drop("_tsite", "_ttype")
    parent_title = F.when(F.coalesce(F.col("parent"), F.lit(0)) > 0, F.coalesce("_ptitle", F.lit(""))).otherwise(F.lit(""))
    return joined.withColumn("parent_title", parent_title).drop("_pid", "_ptitle")


def exclude_posts(posts: DataFrame, opts: Options, excluded: DataFrame | None = None) -> DataFrame:
    """F5 + F6: drop posts whose flat title matches a (trimmed) rule or whose id is listed.

    ``excluded`` lists further ids in a table (column ``id``) of any size; its ids never pass through the driver.
    """
    title_rules = rules.compile_rules(opts.exclude_titles, trim=True)
    out = posts.where(~rules.matches_any(F.col("title"), title_rules))
    ids = sorted({int(i) for i in opts.exclude_ids})
    if ids:
        table = posts.sparkSession.createDataFrame([(i,) for i in ids], "_xid bigint")
        out = out.join(table, F.col("id") == F.col("_xid"), "left_anti")
    if excluded is not None:
        out = out.join(excluded.select(F.col("id").alias("_xid")), F.col("id") == F.col("_xid"), "left_anti")
    return out


def with_listing_rank(posts: DataFrame) -> DataFrame:
    """K2: rank within (site, type) by date_gmt desc ('' counts as epoch 0), fetch order on ties."""
    w = Window.partitionBy("site", "type_key").orderBy(
        dates.gmt_sort_key(F.col("date_gmt")).desc(), F.col("page").asc(), F.col("pos").asc()
    )
    return posts.withColumn("rank", F.row_number().over(w))


def with_display_fields(posts: DataFrame, opts: Options) -> DataFrame:
    """Local date, date label, flat term list, link target."""
    # date_local is projected first: the label reads it, so it is computed once per row.
    with_date = posts.withColumn("date_local", dates.format_datetime(F.col("date_gmt"), opts.zone))
    return with_date.withColumns({
        "date_label": dates.date_label(F.col("date_local"), opts.show_date),
        "link": F.coalesce(F.col("link"), F.lit("")),
        "author_id": F.coalesce(F.col("author").cast("long"), F.lit(0).cast("long")),
        "href": F.concat(urls.raw_url_encode(F.col("rest_base")), F.lit("/"), F.col("id").cast("string")),
    })


def listing(posts: DataFrame, opts: Options, capped: bool = False) -> DataFrame:
    """Entry A up to the listing: K1 -> C3 -> J1 -> F5/F6 -> K2 -> display fields."""
    fetched = posts if capped else newest_per_type(posts, opts)
    fetched = with_flat_titles(fetched)
    with_parents = with_parent_titles(fetched)
    kept = exclude_posts(with_parents, opts)
    return with_display_fields(with_listing_rank(kept), opts)


def author_latest(listed: DataFrame) -> DataFrame:
    """G1: latest date_gmt per author (author > 0) over listed posts, with first-seen position."""
    return (
        listed.where(F.col("author_id") > 0)
        .groupBy("site", "author_id")
        .agg(
            F.max(F.coalesce(F.col("date_gmt"), F.lit(""))).alias("latest_gmt"),
            F.min(F.struct("type_pos", "rank")).alias("first_seen"),
        )
    )


def authors(listed: DataFrame, users: DataFrame) -> DataFrame:
    """K3 + J2: authors with a non-blank user name, newest poster first (first seen on ties).

    ``users`` holds ``site, id, name, description`` (one row per id). The author set is
    bounded by the listing, so the join's small side is decided by AQE at run time.
    """
    latest = author_latest(listed)
    u = users.select(
        F.col("site").alias("_usite"), F.col("id").alias("_uid"),
        text.php_trim(F.coalesce(F.col("name"), F.lit(""))).alias("name"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )
    joined = latest.join(u, (F.col("site") == F.col("_usite")) & (F.col("author_id") == F.col("_uid")), "inner").where(
        F.col("name") != ""
    )
    w = Window.partitionBy("site").orderBy(
        dates.gmt_sort_key(F.col("latest_gmt")).desc(), F.col("first_seen").asc()
    )
    return joined.select(
        "site", F.row_number().over(w).alias("rank"), "author_id", "name", "description", "latest_gmt"
    )


def index_rows(listed: DataFrame, authors_df: DataFrame, agent: bool = False, html_links: bool = False) -> DataFrame:
    """J3 + W3: one listing line per post with its author name and details."""
    a = authors_df.select(F.col("site").alias("_asite"), F.col("author_id").alias("_aid"), F.col("name").alias("author_name"))
    j = listed.join(a, (F.col("site") == F.col("_asite")) & (F.col("author_id") == F.col("_aid")), "left").drop("_asite", "_aid")
    terms_arr = F.coalesce(F.col("terms_flat"), F.array().cast("array<string>"))
    href = F.concat(F.col("href"), F.lit("?html")) if html_links else F.col("href")
    permalink = F.col("link") if agent else urls.prettify_url(F.col("link"))
    return j.select(
        "site", "type_key", "slug", "rank", "id", "title", "parent_title",
        F.array_join(terms_arr, "|").alias("terms"),
        F.col("date_local").alias("date"), "date_label", "author_id",
        F.coalesce("author_name", F.lit("")).alias("author_name"), "link", permalink.alias("permalink"),
        href.alias("href"),
        listing_line(F.col("title"), terms_arr, F.col("date_label"), F.col("parent_title"), href, agent).alias("line"),
    )


def listing_line(title: Column, terms: Column, label: Column, parent: Column, href: Column, agent: bool) -> Column:
    """The visible text of one listing entry: parent prefix, title, [term] labels, (date)."""
    labels = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("["), text.php_trim(t), F.lit("]"))), "")
    show_terms = F.size(terms) > 0
    show_date = F.lit(False) if agent else (label != "")
    small = F.concat(
        F.when(show_terms, labels).otherwise(F.lit("")),
        F.when(show_terms & show_date, F.lit(" ")).otherwise(F.lit("")),
        F.when(show_date, F.concat(F.lit("("), label, F.lit(")"))).otherwise(F.lit("")),
    )
    shown = F.when(show_terms | show_date, F.concat(title, F.lit(" "), small)).otherwise(title)
    prefix = F.when(parent != "", F.concat(parent, F.lit(" ›› "))).otherwise(F.lit(""))
    return F.concat(prefix, F.lit("["), shown, F.lit("]("), href, F.lit(")"))
