"""Adapter views: the driver's tables shaped as captured CMS data.

The input tables are a TPC-H-like star schema plus web pages. These views give them
the shapes of captured site data (post types, posts with embedded terms, users,
HTTP captures, collection pages, alternate links, post fragments, an access log).
Every view is a deterministic function of whole tables, so work grows with the data.
The SQL twins in ``leafcast.checks.oracle`` define the same views independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafcast.functions.dates import ntz_iso
from leafcast.session import materialize
from leafcast.sources.tables import read_table

SITE = "https://example.com"
CRLF = "\r\n"


def _slug(priority):
    return F.lower(F.regexp_replace(priority, "[^A-Za-z0-9]", "_"))


def _rest_base(priority):
    return F.when(priority != "4-NOT SPECIFIED", F.concat(_slug(priority), F.lit("s")))


def type_counts_v(spark: SparkSession, base: str) -> DataFrame:
    """One post type per order priority, with its posts counted; '4-NOT SPECIFIED' has no rest_base."""
    p = F.col("o_orderpriority")
    counted = read_table(spark, base, "orders", "o_orderpriority").groupBy(p).agg(F.count("*").alias("total_found"))
    return counted.select(
        F.lit(SITE).alias("site"), p.alias("type_key"), _slug(p).alias("slug"),
        p.alias("name"), _rest_base(p).alias("rest_base"), "total_found",
    )


def types_v(spark: SparkSession, base: str) -> DataFrame:
    """The post types alone."""
    return type_counts_v(spark, base).drop("total_found")


def posts_v(spark: SparkSession, base: str) -> DataFrame:
    """One post per order (uncapped; the newest-N cap is the job's first step)."""
    return _posts(_orders(spark, base))


def _orders(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


def _posts(o: DataFrame, *others: str) -> DataFrame:
    """Posts of orders, with other columns as they are."""
    k = F.col("o_orderkey")
    # Parents follow from the key alone, so a scan of posts needs no shuffle.
    parent = F.when(k % 9 == 0, k - k % 100).when(k % 3 == 0, k - k % 10 + 1).otherwise(F.lit(0).cast("long"))
    gmt = F.when(k % 97 == 0, F.lit("")).otherwise(ntz_iso(F.col("o_orderdate")))
    return o.select(
        F.lit(SITE).alias("site"),
        F.col("o_orderpriority").alias("type_key"),
        _slug(F.col("o_orderpriority")).alias("slug"),
        _rest_base(F.col("o_orderpriority")).alias("rest_base"),
        k.alias("id"),
        F.concat(F.lit("  Order\t"), k.cast("string"), F.lit("\n"), F.col("o_orderstatus")).alias("title_raw"),
        F.concat(F.lit(SITE + "/"), _slug(F.col("o_orderpriority")), F.lit("/"), k.cast("string")).alias("link"),
        gmt.alias("date"),
        gmt.alias("date_gmt"),
        parent.alias("parent"),
        F.col("o_custkey").alias("author"),
        *others,
    )


TERM_T = "array<array<struct<taxonomy:string,name:string>>>"


def terms_v(spark: SparkSession, base: str, ids: DataFrame | None = None) -> DataFrame:
    """Embedded terms per post: a 'brand' group and a 'type' group from its line items.

    ``ids`` (a DataFrame with column ``id``) restricts the line items to those posts
    before the join with ``part``; pass the capped listing so only its terms are built.
    """
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    if ids is not None:
        li = li.join(ids.select(F.col("id").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    part = read_table(spark, base, "part", "p_partkey", "p_brand", "p_type")
    ln = F.col("l_linenumber")
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    # Taxonomies and names follow from these columns, so they are made below the shuffle.
    line = F.struct(ln.alias("ln"), F.col("l_partkey").alias("pk"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    grouped = joined.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("ts"))

    def term(t, taxonomy: str, name: str):
        return F.struct(
            F.when(t["ln"] % 7 == 0, F.lit("")).otherwise(F.lit(taxonomy)).alias("taxonomy"), F.when(t["ln"] % 5 != 0, t[name]).alias("name"),
        )

    return grouped.select(
        "id",
        F.array(F.transform("ts", lambda t: term(t, "brand", "brand")), F.transform("ts", lambda t: term(t, "type", "type"))).cast(TERM_T).alias("terms"),
    )


# Users whose id no post uses (so their posts' authors are "not returned by the lookup").
UNREFERENCED_ID_OFFSET = 1_000_000_000


def users_v(spark: SparkSession, base: str) -> DataFrame:
    """Site users, one per customer: customers with key % 40 = 1 get an id no post refers to
    (their posts' authors are missing), key % 50 = 0 a blank name."""
    c = read_table(spark, base, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    return c.select(
        F.lit(SITE).alias("site"), F.when(k % 40 == 1, k + UNREFERENCED_ID_OFFSET).otherwise(k).alias("id"),
        F.when(k % 50 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("description"),
    )


def _status_for(page_id):
    m = page_id % 10
    return (
        F.when(m == 0, 404).when(m == 1, 401).when(m == 2, 301).when(m == 3, 500).when(m == 4, 0).otherwise(200)
    )


#: Some totals are beyond 32 bits.
LARGE_TOTAL = 3_000_000_000


def captures_v(spark: SparkSession, base: str) -> DataFrame:
    """Captured page fetches: status by page_id % 10, headers with totals, a redirect target."""
    pages = read_table(spark, base, "pages", "page_id", "url", "html")
    nxt = read_table(spark, base, "pages", "page_id", "url").select(
        (F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url")
    )
    pid = F.col("page_id")
    status = _status_for(pid)
    headers = F.concat(
        F.lit("HTTP/1.1 "), status.cast("string"), F.lit(CRLF),
        F.lit("X-WP-Total: "), F.when(pid % 50 == 7, pid + LARGE_TOTAL).otherwise(pid * 7).cast("string"), F.lit(CRLF),
        F.lit("x-wp-totalpages: "), (pid % 6).cast("string"),
        F.when(status == 301, F.concat(F.lit(CRLF + "Location: "), F.coalesce("next_url", F.lit(""))))
        .otherwise(F.lit("")),
        F.when(pid % 8 == 0, F.concat(F.lit(CRLF + "X-WP-TOTAL:  "), (pid * 7 + 1).cast("string")))
        .otherwise(F.lit("")),
        F.lit(CRLF),
    )
    return pages.join(nxt, "page_id", "left").select(
        F.lit(SITE).alias("site"),
        F.concat(F.lit("pages|"), pid.cast("string")).alias("request_key"),
        F.lit("page").alias("kind"),
        pid.alias("page_id"),
        F.col("url"),
        status.alias("status"),
        F.when(status == 0, F.lit("")).otherwise(headers).alias("headers_raw"),
        F.col("html").alias("body"),
        F.when(status == 0, F.lit("Operation timed out")).otherwise(F.lit("")).alias("error"),
    )


def _alt_links(pid, rest_base):
    matching = F.concat(
        F.lit('<link rel="alternate" type="application/json" title="JSON" href="' + SITE + "/wp-json/wp/v2/"),
        F.coalesce(rest_base, F.lit("posts")), F.lit("/"), pid.cast("string"), F.lit('" />'),
    )
    decoy_feed = F.lit('<link rel="alternate" title="JSON" href="' + SITE + '/feed/" />')
    # No elements: a comment and a script that only look like links; and a value that holds an attribute.
    hidden = F.concat(F.lit("<!-- old: "), F.replace(matching, pid.cast("string"), F.lit("1")), F.lit(' --><script>var s = \'<link rel="alternate" title="JSON" href="/wp-json/wp/v2/posts/2">\';</script>'))
    quoted = F.lit('<link data-note=\'rel="alternate" title="JSON"\' href="/wp-json/wp/v2/posts/3" />')
    encoded = F.concat(F.lit("<LINK title='JSON' rel=alternate href=\""), F.lit(SITE + "/wp-json/wp/v2/"), F.coalesce(rest_base, F.lit("posts")), F.lit("/"), pid.cast("string"), F.lit('?a=1&amp;b=2">'))
    decoy_rss = F.lit('<link rel="alternate" title="RSS" href="' + SITE + '/wp-json/wp/v2/posts/1" />')
    return F.concat(
        F.when(pid % 6 == 0, decoy_rss).otherwise(F.lit("")),
        F.when(pid % 4 == 0, decoy_feed).otherwise(F.lit("")),
        F.when(pid % 5 == 0, hidden).otherwise(F.lit("")),
        F.when(pid % 7 == 0, quoted).otherwise(F.lit("")),
        F.when(pid % 2 == 0, F.when(pid % 3 == 0, encoded).otherwise(matching)).otherwise(F.lit("")),
    )


def alt_pages_v(spark: SparkSession, base: str) -> DataFrame:
    """Pages with alternate links in the head (even page_id: one pointing at order page_id)."""
    pages = read_table(spark, base, "pages", "page_id", "url", "html")
    orders = read_table(spark, base, "orders", "o_orderkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("page_id"), _rest_base(F.col("o_orderpriority")).alias("rest_base")
    )
    j = pages.join(orders, "page_id", "left")
    links = _alt_links(F.col("page_id"), F.col("rest_base"))
    return j.select(
        F.lit(SITE).alias("site"), "page_id", "url",
        F.replace(F.col("html"), F.lit("</head>"), F.concat(links, F.lit("</head>"))).alias("html"),
    )


# Fixed test blocks appended to fragments, chosen by page_id % 5.
RICH_BLOCKS = (
    '<table class="t"><caption>Cap</caption><colgroup><col></colgroup><thead><tr><th colspan="2">H</th>'
    '</tr></thead>\n<tbody><tr><td rowspan="1">a</td><td>b<br>c</td></tr></tbody></table>',
    '<pre class="language-python"><code>for tide in range(3):\n    print(tide)\n</code></pre>'
    '<pre class="mermaid">flowchart LR; tide--&gt;moon;</pre>',
    '<form action="/x"><p>Name</p><input name="name"></form>',
    '<figure><img src="https://example.com/a.png" alt="A" width="9"><figcaption>Fig</figcaption></figure>'
    '<details><summary>More</summary><p>Body</p></details>',
    '<p><i class="fa fa-star"></i> <a href="https://xn--wgv71a119e.example/a%20b" target="_blank">IDN link</a></p>',
)


def fragments_v(spark: SparkSession, base: str) -> DataFrame:
    """Post HTML fragments: each whole page plus one rich block."""
    pages = read_table(spark, base, "pages", "page_id", "html")
    pid = F.col("page_id")
    block = F.element_at(F.array(*[F.lit(b) for b in RICH_BLOCKS]), (pid % 5 + 1).cast("int"))
    return pages.select(pid, F.concat(F.col("html"), F.lit("\n"), block).alias("fragment"))


# User agents by event type and Accept-Language headers by user.
USER_AGENTS = {
    "view": "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "click": "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "error": "curl/8.0",
    "signup": "-",
    "purchase": " Google ",
}
ACCEPT_LANGUAGES = ("ja,en;q=0.8", "en-US", "fr", "", "fr;q=1,en;q=0.5,ja;q=0.5", "ja;q=0.2, en-GB;q=0.7")


def access_v(spark: SparkSession, base: str) -> DataFrame:
    """An access log: one request per event."""
    ev = read_table(spark, base, "events", "event_id", "user_id", "event_type")
    ua = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in USER_AGENTS.items()], F.lit(""))
    langs = F.array(*[F.lit(v) for v in ACCEPT_LANGUAGES])
    return ev.select(
        "event_id",
        ua.alias("user_agent"),
        F.element_at(langs, (F.col("user_id") % len(ACCEPT_LANGUAGES) + 1).cast("int")).alias("accept_language"),
        (F.col("event_id") % 3 == 0).alias("raw"),
        (F.col("event_id") % 3 == 1).alias("html"),
    )


# ---- captured API responses built from the views above -----------------------------------

#: Captured sites: the first as its pages say; the second answers 401 and 500 to some requests; the types of
#: the third and fifth failed; the fourth was asked again for a page that had failed.
SECOND_SITE, THIRD_SITE = "https://two.example.com/blog", "https://three.example.com"
FOURTH_SITE, FIFTH_SITE = "https://four.example.com", "https://five.example.com"
CAPTURED_SITES = (SITE, SECOND_SITE, THIRD_SITE, FOURTH_SITE, FIFTH_SITE)
UNREADABLE_PAGE = ("1-URGENT", 1)  # 401 on the second site
FAILED_PAGE = ("3-MEDIUM", 2)  # 500 on the second site
REPEATED_PAGE = ("5-LOW", 2)  # failed once on the fourth site, then fetched
BROKEN_PAGE = ("3-MEDIUM", 2)  # this collection page's body is cut off (empty-list rule)
MISSING_PAGE = ("5-LOW", 2)  # this collection page was never captured
TIMED_OUT = "Operation timed out"
FAILED_USER_CHUNK_MOD = (7, 3)  # user chunks with chunk % 7 = 3 failed (HTTP 500)


def types_capture_v(spark: SparkSession, base: str) -> DataFrame:
    """Each site's types responses: one JSON object keyed by type, keys in type_key order.

    The second site's is there twice as it is; the third's was fine once, then its fetch failed; the fourth's failed first; the
    fifth's is no JSON object.
    """
    t = types_v(spark, base)
    entry = F.struct(F.col("type_key").alias("k"), F.struct("slug", "name", "rest_base").alias("v"))
    per_site = t.groupBy("site").agg(F.sort_array(F.collect_list(entry)).alias("es"))
    body = F.to_json(F.map_from_entries(F.transform("es", lambda e: F.struct(e["k"], e["v"]))))
    site = F.col("site")
    last = per_site.select(_each_site(CAPTURED_SITES), body.alias("body")).select(
        "site", F.lit("types").alias("request_key"), F.lit("types").alias("kind"),
        F.when(site == THIRD_SITE, 0).otherwise(200).alias("status"),
        F.when(site == FIFTH_SITE, F.lit("<html>")).when(site == THIRD_SITE, F.lit("")).otherwise(F.col("body")).alias("body"),
        F.when(site == THIRD_SITE, F.lit(TIMED_OUT)).otherwise(F.lit("")).alias("error"), F.lit(2).cast("long").alias("fetched_at"), F.col("body").alias("_good"),
    )
    first = last.where(site.isin(THIRD_SITE, FOURTH_SITE)).withColumns({
        "status": F.when(site == FOURTH_SITE, 503).otherwise(200), "body": F.col("_good"), "error": F.lit(""), "fetched_at": F.lit(1).cast("long"),
    })
    return last.unionByName(first).unionByName(last.where(site == SECOND_SITE)).drop("_good")


def _each_site(sites):
    return F.explode(F.array(*(F.lit(s) for s in sites))).alias("site")


def collections_v(spark: SparkSession, base: str, per_page: int = 100, max_pages: int = 2) -> DataFrame:
    """Captured collection pages: newest-first pages 1..max_pages of every post type.

    Headers carry X-WP-Total / X-WP-TotalPages as the server would send them. Pages are
    built from a capped, salted top-N (never a whole type in one task) and each body
    holds at most ``per_page`` posts.
    """
    from leafcast.operators.index import newest_per_type
    from leafcast.options import Options

    opts = Options(posts_per_page=per_page, max_pages_per_type=max_pages)
    posts = posts_v(spark, base)
    counts = posts.groupBy("site", "type_key").agg(F.count(F.lit(1)).alias("total"))
    top = materialize(newest_per_type(posts, opts), "collection_pages")  # bounded: cap x types
    terms = terms_v(spark, base, ids=top.select("id"))
    item = F.struct(
        F.col("pos").alias("_pos"), "id", F.struct(F.col("title_raw").alias("rendered")).alias("title"),
        "link", "date", "date_gmt", "parent", "author",
        F.struct(F.col("terms").alias("wp:term")).alias("_embedded"),
    )
    pages = top.join(terms, "id", "left").groupBy("site", "type_key", "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.to_json(F.transform("items", lambda i: i.dropFields("_pos")))
    broken = (F.col("type_key") == BROKEN_PAGE[0]) & (F.col("page") == BROKEN_PAGE[1])
    missing = (F.col("type_key") == MISSING_PAGE[0]) & (F.col("page") == MISSING_PAGE[1])
    j = pages.join(counts, ["site", "type_key"], "inner")
    total_pages = F.ceil(F.col("total") / F.lit(per_page)).cast("int")
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "X-WP-Total: "), F.col("total").cast("string"),
        F.lit(CRLF + "X-WP-TotalPages: "), total_pages.cast("string"), F.lit(CRLF),
    )
    first = j.select(
        _each_site((SITE, SECOND_SITE, FOURTH_SITE)),
        F.concat(F.col("type_key"), F.lit("|"), F.col("page").cast("string")).alias("request_key"),
        F.lit("collection").alias("kind"), "type_key", "page", missing.alias("_missing"), headers.alias("headers_raw"),
        F.when(broken, F.lit('[{"id": 1, "title": ')).otherwise(body).alias("body"),
        F.lit("").alias("error"), F.lit(2).cast("long").alias("fetched_at"),
    ).where(~((F.col("site") == SITE) & F.col("_missing")))
    is_page = lambda p: (F.col("type_key") == p[0]) & (F.col("page") == p[1])
    second = F.col("site") == SECOND_SITE
    status = F.when(second & is_page(UNREADABLE_PAGE), 401).when(second & is_page(FAILED_PAGE), 500).otherwise(200)
    rows = first.withColumn("status", status)
    again = rows.where((F.col("site") == FOURTH_SITE) & is_page(REPEATED_PAGE)).withColumns({
        "status": F.lit(500), "body": F.lit("failed"), "fetched_at": F.lit(1).cast("long"),
    })
    captured = rows.unionByName(again).select(
        "site", "request_key", "kind", "type_key", "page", "status", "headers_raw", "body", "error", "fetched_at"
    )
    return materialize(captured, "collections")  # a table, as captures are


def user_chunks_v(spark: SparkSession, base: str) -> DataFrame:
    """Captured user lookups in chunks of 100 ids; some chunks failed; ids % 10 = 0 repeat in the next chunk.

    Chunks % 5 = 1 were fetched before, with other names; all of them succeeded then.
    """
    u = users_v(spark, base)
    chunk = (F.col("id") / 100).cast("long")
    first = u.select("site", chunk.alias("chunk"), "id", "name", "description")
    again = u.where(F.col("id") % 10 == 0).select(
        "site", (chunk + 1).alias("chunk"), "id", F.concat(F.col("name"), F.lit(" (2)")).alias("name"), "description"
    )
    allu = first.unionByName(again)
    grouped = allu.groupBy("site", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("id", "name", "description"))).alias("us")
    )
    failed = F.col("chunk") % FAILED_USER_CHUNK_MOD[0] == FAILED_USER_CHUNK_MOD[1]
    last = grouped.select(
        _each_site((SITE, SECOND_SITE, FOURTH_SITE)), "chunk", F.concat(F.lit("users|"), F.col("chunk").cast("string")).alias("request_key"),
        F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.to_json("us").alias("body"), F.lit("").alias("error"), F.lit(2).cast("long").alias("fetched_at"),
    )
    before = last.where(F.col("chunk") % 5 == 1).withColumns({
        "status": F.lit(200), "body": F.replace("body", F.lit('"name":"'), F.lit('"name":"Old ')), "fetched_at": F.lit(1).cast("long"),
    })
    return last.unionByName(before)


def full_posts_capture_v(spark: SparkSession, base: str) -> DataFrame:
    """Captured single-post responses (``?_embed=author,wp:term``) of all orders.

    The post's content is the page's fragment, or a paragraph of its title where the order has no page; its author is the customer. Some fetches
    failed (page_id % 23 = 0: 404), some bodies are the JSON ``null`` (page_id % 29 = 0) or an empty object (37), and some
    have no id (31). Ids % 11 = 0 were fetched before, with other content; ids % 13 = 0 are there twice as they are.
    """
    frags = fragments_v(spark, base).withColumnRenamed("page_id", "o_orderkey")
    cust = read_table(spark, base, "customer", "c_custkey", "c_name").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author_name")
    )
    # Customers are joined while the orders are narrow; terms and fragments meet them by the post's id, and nothing is moved again.
    whole = _orders(spark, base).join(cust, "o_custkey", "left").join(terms_v(spark, base).withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left")
    said = F.concat(F.lit("<p>"), F.col("title_raw"), F.lit("</p>"))
    j = _posts(whole.join(frags, "o_orderkey", "left"), "author_name", "terms", "fragment").withColumn("fragment", F.coalesce("fragment", said))
    post = F.struct(
        "id", F.struct(F.col("title_raw").alias("rendered")).alias("title"), "link", "date", "date_gmt", "parent", "author",
        F.struct(F.col("fragment").alias("rendered")).alias("content"),
        F.struct(
            F.col("terms").alias("wp:term"),
            F.when(F.col("author_name").isNotNull(),
                   F.array(F.struct(F.col("author").alias("id"), F.col("author_name").alias("name")))).alias("author"),
        ).alias("_embedded"),
    )
    k = F.col("id")
    # A post's captures in one pass over the joins: the last one, one from before, and the last one once more.
    now, before, again = range(3)
    captured = F.explode(F.array_compact(F.array(F.lit(now), F.when(k % 11 == 0, F.lit(before)), F.when(k % 13 == 0, F.lit(again)))))
    old = F.col("_captured") == before
    return j.withColumn("_captured", captured).select(
        "site", "rest_base", "id",
        F.concat(F.lit("post|"), F.coalesce(F.col("rest_base"), F.lit("")), F.lit("|"), k.cast("string")).alias("request_key"),
        F.lit("post").alias("kind"), F.when(~old & (k % 23 == 0), F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(old, F.lit('{"id": 1, "content": {"rendered": "old"}}'))
        .when(k % 29 == 0, F.lit("null")).when(k % 37 == 0, F.lit(" {} ")).when(k % 31 == 0, F.to_json(post.dropFields("id")))
        .otherwise(F.to_json(post)).alias("body"),
        F.lit("").alias("error"), F.when(old, F.lit(1)).otherwise(F.lit(2)).cast("long").alias("fetched_at"),
    )


def root_captures_v(spark: SparkSession, base: str) -> DataFrame:
    """Captured site roots (``/wp-json/?_fields=name``), two per page origin: the first had another name."""
    pages = read_table(spark, base, "pages", "url")
    origin = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    o = pages.select(origin.alias("site")).distinct()
    n = F.length("site") % 3
    last = o.select(
        "site", F.lit("root").alias("kind"),
        F.when(n == 0, F.lit(503)).otherwise(F.lit(200)).alias("status"),
        F.when(n == 1, F.lit('{"name": ""}'))
        .otherwise(F.concat(F.lit('{"name": "Site '), F.upper(F.regexp_extract("site", r"://([^.]*)", 1)), F.lit('"}')))
        .alias("body"),
        F.lit("").alias("error"), F.lit(2).cast("long").alias("fetched_at"),
    )
    return last.unionByName(last.withColumns({"status": F.lit(200), "body": F.lit('{"name": "Old"}'), "fetched_at": F.lit(1).cast("long")}))
