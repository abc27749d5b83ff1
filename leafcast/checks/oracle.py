"""SQL twins (DuckDB dialect) of the registered queries, written independently of the
Spark code. Adapter views are CTEs over the pre-registered tables; option values are
those of ``leafcast.options.ADAPTER_OPTIONS`` written out as SQL literals.
"""

from __future__ import annotations

# Fixed values shared by the SQL text below.
TRIM = "(' ' || chr(9) || chr(10) || chr(13) || chr(11))"
WS_RUN = r"'[\t\n\x0B\f\r\x{85}\x{180E}\p{Z}]+'"
FMTS = "['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M']"
OFFSET = "'([+-])([0-9]{2}):?([0-9]{2})$'"
SLUG = "lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g'))"
SITE = "'https://example.com'"
CRLF = "(chr(13) || chr(10))"


def php_trim(e: str) -> str:
    return f"trim({e}, {TRIM})"


def title_flat(e: str) -> str:
    return php_trim(f"regexp_replace(coalesce({e}, ''), {WS_RUN}, ' ', 'g')")


def gmt_ts(e: str) -> str:
    wall = f"try_strptime(regexp_replace({e}, '([.,][0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$', ''), {FMTS})"
    minutes = (f"coalesce(TRY_CAST(regexp_extract({e}, {OFFSET}, 1) || '1' AS INTEGER), 0) * "
               f"(coalesce(TRY_CAST(regexp_extract({e}, {OFFSET}, 2) AS INTEGER), 0) * 60 + coalesce(TRY_CAST(regexp_extract({e}, {OFFSET}, 3) AS INTEGER), 0))")
    return f"({wall} - to_minutes({minutes}))"


def gmt_epoch(e: str) -> str:
    return f"coalesce(epoch({gmt_ts(e)}), 0)"


def fmt_datetime(e: str, zone: str = "Asia/Tokyo") -> str:
    ts = gmt_ts(e)
    local = f"timezone('{zone}', timezone('UTC', {ts}))"
    off = f"date_diff('minute', {ts}, {local})"
    return (
        f"CASE WHEN {ts} IS NULL THEN '' ELSE strftime({local}, '%Y-%m-%d %H:%M:%S') || ' ' || "
        f"CASE WHEN {off} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({off}) // 60 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(abs({off}) % 60 AS VARCHAR), 2, '0') END"
    )


VIEWS: dict[str, str] = {}

VIEWS["types_v"] = f"""
SELECT {SITE} AS site, o_orderpriority AS type_key, {SLUG} AS slug, o_orderpriority AS name,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {SLUG} || 's' END AS rest_base
FROM (SELECT DISTINCT o_orderpriority FROM orders) d"""

VIEWS["types_kept"] = r"""
SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY type_key) - 1 AS BIGINT) AS type_pos
FROM types_v
WHERE slug IS NOT NULL AND NOT (regexp_matches(slug, '^wp_') OR slug = 'attachment')
  AND NOT regexp_matches(coalesce(name, ''), '^2-') AND rest_base IS NOT NULL"""

VIEWS["posts_v"] = f"""
SELECT {SITE} AS site, o_orderpriority AS type_key, {SLUG} AS slug,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {SLUG} || 's' END AS rest_base,
       o_orderkey AS id,
       '  Order' || chr(9) || CAST(o_orderkey AS VARCHAR) || chr(10) || o_orderstatus AS title_raw,
       {SITE} || '/' || {SLUG} || '/' || CAST(o_orderkey AS VARCHAR) AS link,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS date,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS date_gmt,
       CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - o_orderkey % 100
            WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 10 + 1
            ELSE 0 END AS parent,
       o_custkey AS author
FROM orders"""

VIEWS["fetched"] = """
SELECT * FROM (
  SELECT p.*, t.type_pos,
         row_number() OVER (PARTITION BY p.site, p.type_key ORDER BY p.date DESC, p.id DESC) AS rn
  FROM posts_v p JOIN types_kept t ON p.site = t.site AND p.type_key = t.type_key)
WHERE rn <= 200"""

VIEWS["terms_v"] = """
SELECT l.l_orderkey AS id,
  list({'taxonomy': CASE WHEN l.l_linenumber % 7 = 0 THEN '' ELSE 'brand' END,
        'name': CASE WHEN l.l_linenumber % 5 <> 0 THEN p.p_brand END} ORDER BY l.l_linenumber, l.l_partkey) AS g1,
  list({'taxonomy': CASE WHEN l.l_linenumber % 7 = 0 THEN '' ELSE 'type' END,
        'name': CASE WHEN l.l_linenumber % 5 <> 0 THEN p.p_type END} ORDER BY l.l_linenumber, l.l_partkey) AS g2
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY l.l_orderkey"""

# Terms of the fetched posts, one row per (id, position) with the term kept by G4's rule.
VIEWS["fetched_terms"] = """
SELECT f.id, u.pos, u.t.taxonomy AS taxonomy, u.t.name AS name
FROM (SELECT DISTINCT id FROM fetched) f JOIN (
  SELECT id, unnest(list_concat(g1, g2)) AS t, generate_subscripts(list_concat(g1, g2), 1) AS pos FROM terms_v
) u ON f.id = u.id
WHERE coalesce(u.t.taxonomy, '') <> '' AND u.t.name IS NOT NULL"""

# G4 then G5: names grouped by taxonomy (taxonomies in first-seen order), flattened.
VIEWS["terms_flat_v"] = """
SELECT id, flatten(list(names ORDER BY first_pos)) AS terms_flat FROM (
  SELECT id, taxonomy, min(pos) AS first_pos, list(name ORDER BY pos) AS names
  FROM fetched_terms GROUP BY id, taxonomy)
GROUP BY id"""

VIEWS["flat"] = f"""
SELECT f.*, CAST((f.rn - 1) // 100 + 1 AS BIGINT) AS page, CAST((f.rn - 1) % 100 AS BIGINT) AS pos,
       {title_flat('f.title_raw')} AS title, coalesce(tf.terms_flat, []::VARCHAR[]) AS terms_flat
FROM fetched f LEFT JOIN terms_flat_v tf ON f.id = tf.id"""

VIEWS["parented"] = """
SELECT f.*, CASE WHEN coalesce(f.parent, 0) > 0 THEN coalesce(pt.ptitle, '') ELSE '' END AS parent_title
FROM flat f LEFT JOIN (
  SELECT site, type_key, id AS pid, arg_max(title, page * 1000000 + pos) AS ptitle FROM flat GROUP BY site, type_key, id
) pt ON f.site = pt.site AND f.type_key = pt.type_key AND f.parent = pt.pid"""

VIEWS["listed"] = f"""
SELECT k.*, row_number() OVER (PARTITION BY site, type_key ORDER BY {gmt_epoch('date_gmt')} DESC, page, pos) AS rank,
       {fmt_datetime('date_gmt')} AS date_local,
       split_part({fmt_datetime('date_gmt')}, ' ', 1) AS date_label,
       coalesce(author, 0) AS author_id,
       url_encode(rest_base) || '/' || CAST(id AS VARCHAR) AS href
FROM parented k
WHERE NOT (regexp_matches(title, '^Order \\d*7 P$') OR title = 'Order 42 F') AND id NOT IN (7, 44, 1234)"""

VIEWS["users_v"] = f"""
SELECT {SITE} AS site, CASE WHEN c_custkey % 40 = 1 THEN c_custkey + 1000000000 ELSE c_custkey END AS id,
       CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE c_name END AS name, c_mktsegment AS description
FROM customer"""

VIEWS["author_latest_v"] = """
SELECT site, author_id, max(coalesce(date_gmt, '')) AS latest_gmt, min(type_pos * 1000000 + rank) AS first_seen
FROM listed WHERE author_id > 0 GROUP BY site, author_id"""

VIEWS["authors_v"] = f"""
SELECT a.site, row_number() OVER (PARTITION BY a.site ORDER BY {gmt_epoch('a.latest_gmt')} DESC, a.first_seen) AS rank,
       a.author_id, {php_trim('u.name')} AS name, coalesce(u.description, '') AS description, a.latest_gmt
FROM author_latest_v a JOIN users_v u ON a.site = u.site AND a.author_id = u.id
WHERE {php_trim('u.name')} <> ''"""

_LABELS = f"array_to_string(list_transform(l.terms_flat, lambda t: '[' || {php_trim('t')} || ']'), '')"
_SMALL = (
    f"(CASE WHEN len(l.terms_flat) > 0 THEN {_LABELS} ELSE '' END || "
    "CASE WHEN len(l.terms_flat) > 0 AND l.date_label <> '' THEN ' ' ELSE '' END || "
    "CASE WHEN l.date_label <> '' THEN '(' || l.date_label || ')' ELSE '' END)"
)
_LINE = (
    "CASE WHEN l.parent_title <> '' THEN l.parent_title || ' ›› ' ELSE '' END || '[' || "
    f"CASE WHEN len(l.terms_flat) > 0 OR l.date_label <> '' THEN l.title || ' ' || {_SMALL} ELSE l.title END"
    " || '](' || l.href || ')'"
)

VIEWS["index_rows_v"] = f"""
SELECT l.site, l.type_key, l.slug, l.rank, l.id, l.title, l.parent_title,
       array_to_string(l.terms_flat, '|') AS terms, l.date_local AS date, l.date_label, l.author_id,
       coalesce(a.name, '') AS author_name, l.link, url_decode(replace(l.link, '+', '%20')) AS permalink, l.href, {_LINE} AS line
FROM listed l LEFT JOIN authors_v a ON l.site = a.site AND l.author_id = a.author_id"""

VIEWS["type_summary_v"] = """
SELECT t.site, t.type_pos, t.type_key, t.slug, t.name AS type_name,
       CAST(c.total_found AS BIGINT) AS total_found,
       CAST(greatest(ceil(c.total_found / 100), 1) AS BIGINT) AS total_pages,
       greatest(ceil(c.total_found / 100), 1) > 2 AS truncated,
       CAST(coalesce(n.listed, 0) AS BIGINT) AS listed,
       CASE WHEN greatest(ceil(c.total_found / 100), 1) > 2
            THEN 'Showing the latest ' || CAST(coalesce(n.listed, 0) AS VARCHAR) || ' of '
                 || CAST(c.total_found AS VARCHAR) || ' items.' ELSE '' END AS note
FROM types_kept t
LEFT JOIN (SELECT site, type_key, count(*) AS total_found FROM posts_v GROUP BY site, type_key) c
  ON t.site = c.site AND t.type_key = c.type_key
LEFT JOIN (SELECT site, type_key, count(*) AS listed FROM listed GROUP BY site, type_key) n
  ON t.site = n.site AND t.type_key = n.type_key"""


QUERIES: dict[str, str] = {
    "newest_per_type": "SELECT site, type_key, id, date, CAST((rn - 1) // 100 + 1 AS BIGINT) AS page, "
                       "CAST((rn - 1) % 100 AS BIGINT) AS pos FROM fetched",
    "parent_titles": "SELECT site, type_key, id, parent, parent_title FROM parented",
    "listing_rank": "SELECT site, type_key, rank, id, title, date_local AS date, date_label FROM listed",
    "index_rows": "SELECT * FROM index_rows_v",
    "author_latest": "SELECT site, author_id, latest_gmt FROM author_latest_v",
    "authors": "SELECT * FROM authors_v",
    "type_summary": "SELECT * FROM type_summary_v",
    "filter_types": "SELECT site, type_pos, type_key, slug, name, rest_base FROM types_kept",
}


def with_views(select: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body}\n)" for name, body in VIEWS.items())
    return f"WITH {ctes}\n{select}"


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in QUERIES.items()}


# ---- batch 2: column functions, captures, resolution, planning ---------------------------

URL_PARTS = r"'(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"
HOST_PORT = r"'^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$'"
ORIGIN = r"'^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*'"


def normalize_url(e: str, without_params: bool = False) -> str:
    scheme = f"lower(regexp_extract({e}, {URL_PARTS}, 1))"
    hp = f"regexp_extract(regexp_extract({e}, {URL_PARTS}, 2), '^(?:.*@)?(.*)$', 1)"
    host = f"regexp_extract({hp}, {HOST_PORT}, 1)"
    port = f"regexp_extract({hp}, {HOST_PORT}, 2)"
    path = f"rtrim(regexp_extract({e}, {URL_PARTS}, 3), '/')"
    out = f"{scheme} || '://' || lower({host}) || CASE WHEN {port} <> '' THEN ':' || {port} ELSE '' END || {path}"
    if not without_params:
        out += f" || regexp_extract({e}, {URL_PARTS}, 4) || regexp_extract({e}, {URL_PARTS}, 5)"
    return f"CASE WHEN {e} IS NOT NULL AND {scheme} IN ('http', 'https') AND {host} <> '' THEN {out} END"


def same_site(base: str, url: str) -> str:
    b, u = normalize_url(base, True), normalize_url(url, True)
    return f"coalesce(({b}) IS NOT NULL AND ({u}) IS NOT NULL AND (({u}) = ({b}) OR starts_with({u}, ({b}) || '/')), false)"


def http_ok(e: str) -> str:
    return f"coalesce({e} BETWEEN 200 AND 299, false)"


def yaml_scalar(e: str) -> str:
    cond = " OR ".join([
        f"{e} = ''",
        rf"regexp_matches({e}, '[\t\n\x0B\f\r\p{{Z}}]')",
        f"strpos({e}, ':') > 0",
        rf"regexp_matches({e}, '(?:^|[ \t\n\x0B\f\r])#')",
        r"regexp_matches(" + e + r", '[\[\]{}&*!|>''\"%@`,]')",
        f"regexp_matches({e}, '^[-?:]')",
        f"regexp_matches({e}, '(?i)^(?:true|false|null|yes|no|on|off|~)$')",
        rf"regexp_matches({e}, '^[+-]?(?:\d+\.?\d*|\.\d+)$')",
    ])
    quoted = "'\"' || replace(replace(" + e + ", '\\', '\\\\'), '\"', '\\\"') || '\"'"
    return f"CASE WHEN {cond} THEN {quoted} ELSE {e} END"


def raw_url_encode(e: str) -> str:
    return f"url_encode({e})"


VIEWS["captures_v"] = f"""
SELECT {SITE} AS site, 'pages|' || CAST(s.page_id AS VARCHAR) AS request_key, 'page' AS kind, s.page_id, s.url,
  s.status,
  CASE WHEN s.status = 0 THEN '' ELSE
    'HTTP/1.1 ' || CAST(s.status AS VARCHAR) || {CRLF} || 'X-WP-Total: ' || CAST(CASE WHEN s.page_id % 50 = 7 THEN s.page_id + 3000000000 ELSE s.page_id * 7 END AS VARCHAR) || {CRLF}
    || 'x-wp-totalpages: ' || CAST(s.page_id % 6 AS VARCHAR)
    || CASE WHEN s.status = 301 THEN {CRLF} || 'Location: ' || coalesce(n.url, '') ELSE '' END
    || CASE WHEN s.page_id % 8 = 0 THEN {CRLF} || 'X-WP-TOTAL:  ' || CAST(s.page_id * 7 + 1 AS VARCHAR) ELSE '' END
    || {CRLF} END AS headers_raw,
  s.html AS body,
  CASE WHEN s.status = 0 THEN 'Operation timed out' ELSE '' END AS error
FROM (SELECT page_id, url, html,
        CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 301 WHEN 3 THEN 500 WHEN 4 THEN 0 ELSE 200 END AS status
      FROM pages) s
LEFT JOIN pages n ON n.page_id = s.page_id + 1"""

VIEWS["header_lines"] = f"""
SELECT request_key, unnest(string_split(trim(headers_raw, {TRIM}), {CRLF})) AS line,
       generate_subscripts(string_split(trim(headers_raw, {TRIM}), {CRLF}), 1) AS i
FROM captures_v"""

VIEWS["headers_v"] = f"""
SELECT request_key, name, arg_max(value, i) AS value FROM (
  SELECT request_key, i, lower({php_trim("split_part(line, ':', 1)")}) AS name,
         {php_trim("substr(line, strpos(line, ':') + 1)")} AS value
  FROM header_lines WHERE strpos(line, ':') > 0)
GROUP BY request_key, name"""

VIEWS["repeated_v"] = """
SELECT request_key AS okey, request_key, page_id, url, status FROM captures_v
UNION ALL SELECT request_key, request_key || '|again', page_id, url, status FROM captures_v WHERE page_id % 3 = 0"""

VIEWS["redirect_targets_v"] = """
SELECT url, arg_min(status, request_key) AS status, min(request_key) AS request_key FROM repeated_v GROUP BY url"""

VIEWS["access_v"] = """
SELECT event_id,
  CASE event_type
    WHEN 'view' THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0'
    WHEN 'click' THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
    WHEN 'error' THEN 'curl/8.0'
    WHEN 'signup' THEN '-'
    WHEN 'purchase' THEN ' Google '
    ELSE '' END AS user_agent,
  ['ja,en;q=0.8', 'en-US', 'fr', '', 'fr;q=1,en;q=0.5,ja;q=0.5', 'ja;q=0.2, en-GB;q=0.7'][user_id % 6 + 1] AS accept_language,
  event_id % 3 = 0 AS raw, event_id % 3 = 1 AS html
FROM events"""

VIEWS["lang_v"] = f"""
SELECT a.event_id, a.accept_language, coalesce(b.lang, 'en') AS lang
FROM access_v a LEFT JOIN (
  SELECT event_id, lang FROM (
    SELECT event_id, lang, row_number() OVER (PARTITION BY event_id ORDER BY q DESC, i) AS r FROM (
      SELECT event_id, i,
        split_part(lower({php_trim("split_part(part, ';', 1)")}), '-', 1) AS lang,
        CASE WHEN regexp_extract(coalesce(string_split(part, ';')[2], ''), 'q=([0-9.]+)', 1) = '' THEN 1.0
             ELSE coalesce(TRY_CAST(regexp_extract(regexp_extract(coalesce(string_split(part, ';')[2], ''),
                  'q=([0-9.]+)', 1), '^([0-9]*\\.?[0-9]*)', 1) AS DOUBLE), 0.0) END AS q
      FROM (SELECT event_id, unnest(string_split(accept_language, ',')) AS part,
                   generate_subscripts(string_split(accept_language, ','), 1) AS i FROM access_v))
    WHERE lang IN ('en', 'ja'))
  WHERE r = 1) b ON a.event_id = b.event_id"""

_AGENT = ("(user_agent = '-' OR regexp_matches(lower(user_agent), "
          "'anthropic|claude|google|gemini|openai|chatgpt|perplexity|bing|facebook|curl'))")
_MODE = (f"CASE WHEN {php_trim('user_agent')} = 'Google' THEN 'html' WHEN raw THEN 'raw' "
         "WHEN html THEN 'html' ELSE 'markdown' END")

VIEWS["alt_pages_v"] = f"""
SELECT {SITE} AS site, p.page_id, p.url,
  replace(p.html, '</head>',
    CASE WHEN p.page_id % 6 = 0 THEN '<link rel="alternate" title="RSS" href="https://example.com/wp-json/wp/v2/posts/1" />' ELSE '' END
    || CASE WHEN p.page_id % 4 = 0 THEN '<link rel="alternate" title="JSON" href="https://example.com/feed/" />' ELSE '' END
    || CASE WHEN p.page_id % 5 = 0 THEN '<!-- old: ' || replace(m.link, CAST(p.page_id AS VARCHAR), '1')
         || ' --><script>var s = ''<link rel="alternate" title="JSON" href="/wp-json/wp/v2/posts/2">'';</script>' ELSE '' END
    || CASE WHEN p.page_id % 7 = 0 THEN '<link data-note=''rel="alternate" title="JSON"'' href="/wp-json/wp/v2/posts/3" />' ELSE '' END
    || CASE WHEN p.page_id % 2 = 0 AND p.page_id % 3 = 0 THEN '<LINK title=''JSON'' rel=alternate href="https://example.com/wp-json/wp/v2/'
         || m.rb || '/' || CAST(p.page_id AS VARCHAR) || '?a=1&amp;b=2">' WHEN p.page_id % 2 = 0 THEN m.link ELSE '' END
    || '</head>') AS html
FROM pages p LEFT JOIN orders o ON o.o_orderkey = p.page_id
CROSS JOIN LATERAL (SELECT rb, '<link rel="alternate" type="application/json" title="JSON" href="https://example.com/wp-json/wp/v2/'
         || rb || '/' || CAST(p.page_id AS VARCHAR) || '" />' AS link
       FROM (SELECT coalesce(CASE WHEN o.o_orderpriority <> '4-NOT SPECIFIED' THEN {SLUG} || 's' END, 'posts') AS rb)) m"""

_LINKS = r"""'(?i)<link\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""
_ATTRIBUTE = r"""'([^\s=/>"'']+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
_ELEMENTS = r"""regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"""


def tag_attr(tag: str, name: str) -> str:
    names = f"list_transform(regexp_extract_all({tag}, {_ATTRIBUTE}, 1), lambda a: lower(a))"
    value = f"coalesce(regexp_extract_all({tag}, {_ATTRIBUTE}, 2)[nullif(list_position({names}, '{name}'), 0)], '')"
    value = "regexp_replace(" + value + r""", '^["'']|["'']$', '', 'g')"""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{char}')"
    return value


_API = r"'/wp-json/wp/v2/([^/]+)/(\d+)'"
_FIRST_ALT = (
    f"list_filter(regexp_extract_all({_ELEMENTS}, {_LINKS}), lambda l: "
    f"{tag_attr('l', 'rel')} = 'alternate' AND {tag_attr('l', 'title')} = 'JSON' AND regexp_matches({tag_attr('l', 'href')}, {_API}))[1]"
)

VIEWS["targets_v"] = f"""
SELECT site, page_id, coalesce(href, '') AS alt_href,
       regexp_extract(coalesce(href, ''), {_API}, 1) AS rest_base,
       coalesce(TRY_CAST(regexp_extract(coalesce(href, ''), {_API}, 2) AS BIGINT), 0) AS id
FROM (SELECT site, page_id, {tag_attr(_FIRST_ALT, 'href')} AS href FROM alt_pages_v)"""

VIEWS["resolved_v"] = f"""
SELECT t.page_id, t.rest_base, t.id, (t.rest_base <> '' AND t.id > 0) AS valid, p.id IS NOT NULL AS resolved,
       p.title AS post_title
FROM targets_v t LEFT JOIN (SELECT site, rest_base, id, {title_flat('title_raw')} AS title FROM posts_v) p
  ON t.rest_base <> '' AND t.id > 0 AND t.site = p.site AND t.rest_base = p.rest_base AND t.id = p.id"""

VIEWS["fragments_v"] = r"""
SELECT page_id, html || chr(10) ||
  CASE page_id % 5
    WHEN 0 THEN '<table class="t"><caption>Cap</caption><colgroup><col></colgroup><thead><tr><th colspan="2">H</th></tr></thead>' || chr(10) || '<tbody><tr><td rowspan="1">a</td><td>b<br>c</td></tr></tbody></table>'
    WHEN 1 THEN '<pre class="language-python"><code>for tide in range(3):' || chr(10) || '    print(tide)' || chr(10) || '</code></pre><pre class="mermaid">flowchart LR; tide--&gt;moon;</pre>'
    WHEN 2 THEN '<form action="/x"><p>Name</p><input name="name"></form>'
    WHEN 3 THEN '<figure><img src="https://example.com/a.png" alt="A" width="9"><figcaption>Fig</figcaption></figure><details><summary>More</summary><p>Body</p></details>'
    ELSE '<p><i class="fa fa-star"></i> <a href="https://xn--wgv71a119e.example/a%20b" target="_blank">IDN link</a></p>'
  END AS fragment
FROM pages"""

VIEWS["coll_ranked"] = """
SELECT * FROM (
  SELECT p.*, row_number() OVER (PARTITION BY site, type_key ORDER BY date DESC, id DESC) AS rn FROM posts_v p)
WHERE rn <= 200"""

VIEWS["type_counts"] = "SELECT site, type_key, count(*) AS total FROM posts_v GROUP BY site, type_key"

VIEWS["coll_plan"] = f"""
SELECT t.site, t.type_key, 1 AS page,
       t.site || '/wp-json/wp/v2/' || t.rest_base || '?per_page=100&page=1&orderby=date&order=desc&_embed=wp:term'
       || '&_fields=id,title,link,date,date_gmt,parent,author,_links.wp:term,_embedded.wp:term' AS url
FROM types_kept t
UNION ALL
SELECT t.site, t.type_key, g.page,
       t.site || '/wp-json/wp/v2/' || t.rest_base || '?per_page=100&page=' || CAST(g.page AS VARCHAR)
       || '&orderby=date&order=desc&_embed=wp:term'
       || '&_fields=id,title,link,date,date_gmt,parent,author,_links.wp:term,_embedded.wp:term' AS url
FROM types_kept t JOIN type_counts c ON t.site = c.site AND t.type_key = c.type_key,
     LATERAL (SELECT unnest(generate_series(2, least(CAST(greatest(ceil(c.total / 100), 1) AS BIGINT), 2))) AS page) g"""

VIEWS["batches_v"] = f"""
SELECT b.batch_id, f.base, 'pages|' || CAST(b.page_id AS VARCHAR) AS request_key, b.url
FROM (SELECT page_id // 10 AS batch_id, page_id, url FROM pages) b
JOIN (SELECT page_id // 10 AS batch_id, regexp_extract(arg_min(url, page_id), {ORIGIN}, 0) AS base
      FROM pages GROUP BY 1) f ON b.batch_id = f.batch_id"""

_ORDER_DATE = ("CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'not a date' "
               "WHEN event_id % 13 = 4 THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
               "['', 'Z', '.250', '+09:00', '-0330', '.5Z', ''][event_id % 7 + 1] END")
_NL2BR = "regexp_replace({e}, '(\\r\\n|\\n\\r|\\n|\\r)', '<br />\\1', 'g')"


def html_escape(e: str) -> str:
    out = f"replace({e}, '&', '&amp;')"
    for raw, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        out = f"replace({out}, '{raw}', '{ent}')"
    return out


def _digest(src: str, key: str, expr: str) -> str:
    return f"SELECT {key}, CAST(length({expr}) AS BIGINT) AS n_chars, md5({expr}) AS md5 FROM {src}"


_ICON = r"""'(?i)<i\b[^>]*\bclass\s*=\s*["''][^"'']*\bfa[bsrld]?\b[^"'']*["''][^>]*>\s*</i>'"""

QUERIES.update({
    "normalize_url": f"SELECT page_id, url, {normalize_url('url')} AS normalized, {normalize_url('url', True)} AS normalized_np FROM pages",
    "prettify_url": "SELECT page_id, url_decode(replace(url || '#caf%C3%A9+%2B%zz', '+', '%20')) AS pretty FROM pages",
    "same_site": f"SELECT page_id, base, {same_site('base', 'url')} AS same_site FROM "
                 f"(SELECT page_id, url, regexp_extract(url, {ORIGIN}, 0) || '/en' AS base FROM pages)",
    "title_flat": _digest("documents", "doc_id", title_flat("text")),
    "lf_normalize": _digest("documents", "doc_id", "regexp_replace(text, '\\r\\n?', chr(10), 'g')"),
    "collapse_blank_lines": _digest("documents", "doc_id",
        "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g')"),
    "yaml_value": "SELECT src, k, turn, v, " + yaml_scalar("v") + """ AS y FROM (
        SELECT 'nation' AS src, CAST(n_nationkey AS BIGINT) AS k, n_name AS v, CAST(0 AS BIGINT) AS turn FROM nation
        UNION ALL SELECT 'part_name', p_partkey, p_name, 0 FROM part
        UNION ALL SELECT 'part_type', p_partkey, p_type, 0 FROM part
        UNION ALL SELECT 'part_brand', p_partkey, p_brand, 0 FROM part
        UNION ALL SELECT 'props', event_id, props, 0 FROM events
        UNION ALL SELECT 'priority', o_orderkey, o_orderpriority, 0 FROM orders
        UNION ALL SELECT 'order_id', o_orderkey, CAST(o_orderkey AS VARCHAR), 0 FROM orders
        UNION ALL SELECT 'customer', c_custkey, c_name, 0 FROM customer
        UNION ALL SELECT 'conversation', conv_id, text, turn FROM conversations)""",
    "format_datetime": f"SELECT event_id, gmt, {fmt_datetime('gmt', 'Asia/Tokyo')} AS tokyo, "
                       f"{fmt_datetime('gmt', 'America/St_Johns')} AS st_johns, {fmt_datetime('gmt', 'UTC')} AS utc, "
                       f"{fmt_datetime('gmt', 'UTC')} AS fallback FROM (SELECT event_id, {_ORDER_DATE} AS gmt FROM events)",
    "header_map": "SELECT request_key, name, value FROM headers_v",
    "capture_outcome": f"SELECT request_key, CAST(status AS BIGINT) AS status, {http_ok('status')} AS success, "
                       f"CASE WHEN {http_ok('status')} THEN '' WHEN status = 0 THEN coalesce(error, '') "
                       f"ELSE 'HTTP ' || CAST(status AS VARCHAR) END AS error, "
                       f"CASE WHEN {http_ok('status')} THEN md5(body) END AS body_md5 FROM captures_v",
    "type_totals": """
        SELECT c.request_key,
          CAST(coalesce(TRY_CAST(regexp_extract(coalesce(t.value, ''), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS BIGINT) AS total_found,
          CAST(CASE WHEN p.value IS NULL THEN 1 ELSE coalesce(TRY_CAST(regexp_extract(p.value, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0) END AS BIGINT) AS total_pages,
          CASE WHEN p.value IS NULL THEN 1 ELSE coalesce(TRY_CAST(regexp_extract(p.value, '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0) END > 2 AS truncated
        FROM captures_v c
        LEFT JOIN headers_v t ON c.request_key = t.request_key AND t.name = 'x-wp-total'
        LEFT JOIN headers_v p ON c.request_key = p.request_key AND p.name = 'x-wp-totalpages'""",
    "type_readability": f"""
        SELECT request_key AS type_key, coalesce(CASE WHEN page_id % 7 <> 0 THEN 'Page ' || CAST(page_id AS VARCHAR) END, request_key) AS name,
          CAST(status AS BIGINT) AS status,
          CASE WHEN {http_ok('status')} THEN 'readable' WHEN status IN (401, 404) THEN 'unreadable' ELSE 'fatal' END AS class,
          CASE WHEN {http_ok('status')} OR status IN (401, 404) THEN ''
               ELSE 'slug: ' || request_key || CASE WHEN status = 0 THEN CASE WHEN coalesce(error, '') <> '' THEN ', ' || error ELSE '' END
                                                  ELSE ', HTTP ' || CAST(status AS VARCHAR) END END AS error
        FROM captures_v""",
    "is_agent": f"SELECT event_id, {_AGENT} AS is_agent FROM access_v",
    "negotiate_lang": "SELECT event_id, accept_language, lang FROM lang_v",
    "render_mode": f"SELECT event_id, {_MODE} AS mode FROM access_v",
    "traffic_classes": f"SELECT {_AGENT} AS is_agent, l.lang, {_MODE} AS mode, count(*) AS requests "
                       "FROM access_v a JOIN lang_v l ON a.event_id = l.event_id GROUP BY ALL",
    "html_escape": "SELECT conv_id, turn, CAST(length(e) AS BIGINT) AS n_chars, md5(e) AS md5 FROM (SELECT conv_id, turn, "
                   + _NL2BR.format(e=html_escape("text")) + " AS e FROM conversations)",
    "index_href": f"SELECT p_partkey, {raw_url_encode('p_name')} || '/' || CAST(p_partkey AS VARCHAR) AS href, "
                  f"{raw_url_encode('p_brand')} AS brand_enc FROM part",
    "icon_replace": _digest("fragments_v", "page_id", f"regexp_replace(fragment, {_ICON}, '■', 'g')"),
    "strip_wrappers": _digest("pages", "page_id", "regexp_replace(html, '(?i)</?(?:html|body)\\b[^>]*>', '', 'g')"),
    "raw_pages": _digest("fragments_v", "page_id",
        "regexp_replace(regexp_replace(fragment, '\\r\\n?', chr(10), 'g'), '(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g')"),
    "page_alternate_link": "SELECT page_id, alt_href, rest_base, id FROM targets_v",
    "resolve_pages": "SELECT * FROM resolved_v",
    "unresolved_targets": "SELECT page_id, rest_base, id FROM resolved_v WHERE NOT valid",
    "redirect_once": f"""
        SELECT c.request_key, CAST(c.status AS BIGINT) AS status, h.value AS location, x.internal,
          CASE WHEN x.internal THEN t.request_key END AS target_key,
          CAST(CASE WHEN x.internal THEN t.status END AS BIGINT) AS target_status,
          CASE WHEN NOT x.internal THEN 'url_must_be_internal' WHEN t.request_key IS NULL THEN 'page_fetch_failed'
               WHEN NOT {http_ok('t.status')} THEN 'page_fetch_failed' ELSE '' END AS error
        FROM repeated_v c
        JOIN headers_v h ON c.okey = h.request_key AND h.name = 'location'
        CROSS JOIN LATERAL (SELECT {same_site(f"(regexp_extract(c.url, {ORIGIN}, 0) || CASE WHEN c.page_id % 20 = 2 THEN '/en' ELSE '' END)", 'h.value')} AS internal) x
        LEFT JOIN redirect_targets_v t ON t.url = h.value
        WHERE NOT {http_ok('c.status')}""",
    "batch_admission": f"SELECT batch_id, bool_and(ok) AS admitted, count(*) AS n_urls, "
                       f"CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_rejected "
                       f"FROM (SELECT batch_id, {same_site('base', 'url')} AS ok FROM batches_v) GROUP BY batch_id",
    "src_types": "SELECT site, type_pos, type_key, slug, name, rest_base FROM types_c",
    "src_posts": """
        SELECT p.site, r.type_key, CAST((r.rn - 1) // 100 + 1 AS BIGINT) AS page, CAST((r.rn - 1) % 100 AS BIGINT) AS pos,
               r.id, r.title_raw, r.date_gmt, r.parent, r.author,
               CAST(coalesce(2 * len(t.g1), 0) AS BIGINT) AS n_terms
        FROM coll_ranked r JOIN sites_c p ON true LEFT JOIN terms_v t ON r.id = t.id
        WHERE NOT (r.type_key = '3-MEDIUM' AND (r.rn - 1) // 100 + 1 = 2)
          AND NOT (p.site = 'https://example.com' AND r.type_key = '5-LOW' AND (r.rn - 1) // 100 + 1 = 2)
          AND NOT (p.site = 'https://two.example.com/blog' AND r.type_key = '1-URGENT' AND (r.rn - 1) // 100 + 1 = 1)""",
    "src_users": """
        SELECT p.site, id, CASE WHEN id % 10 = 0 AND (id // 100 + 1) % 7 <> 3 THEN name || ' (2)' ELSE name END AS name, description
        FROM users_v JOIN sites_c p ON true WHERE (id // 100) % 7 <> 3 OR (id % 10 = 0 AND (id // 100 + 1) % 7 <> 3)""",
    "src_post_full": """
        SELECT 'post|' || coalesce(p.rest_base, '') || '|' || CAST(p.id AS VARCHAR) AS request_key,
          CASE WHEN p.id % 23 = 0 THEN 'post_fetch_failed' WHEN p.id % 29 = 0 OR p.id % 37 = 0 THEN 'post_parse_failed' ELSE '' END AS error,
          CASE WHEN p.id % 31 = 0 AND p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0 THEN 0 ELSE p.id END AS id,
          CASE WHEN p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0 THEN p.title_raw END AS title_raw,
          CASE WHEN p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0 THEN coalesce(c.c_name, '') ELSE '' END AS author_name,
          CAST(CASE WHEN p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0 THEN length(p.fragment) ELSE 0 END AS BIGINT) AS content_len,
          CAST(CASE WHEN p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0 THEN coalesce(2 * len(t.g1), 0) ELSE 0 END AS BIGINT) AS n_terms
        FROM contents_v p
        LEFT JOIN terms_v t ON t.id = p.id LEFT JOIN customer c ON c.c_custkey = p.author""",
    "site_name": f"""
        SELECT site, CASE WHEN length(site) % 3 = 2 THEN 'Site ' || upper(regexp_extract(site, '://([^.]*)', 1))
                          ELSE regexp_extract(regexp_extract(regexp_extract(site, {URL_PARTS}, 2), '^(?:.*@)?(.*)$', 1), {HOST_PORT}, 1) END AS site_name
        FROM (SELECT DISTINCT regexp_extract(url, {ORIGIN}, 0) AS site FROM pages)""",
    "plan_first_pages": "SELECT site, type_key, type_key AS request_key, url FROM coll_plan WHERE page = 1",
    "plan_next_pages": """
        SELECT p.site, p.type_key, CAST(p.page AS BIGINT) AS page, p.type_key || '|' || CAST(p.page AS VARCHAR) AS request_key,
          p.site || '/wp-json/wp/v2/' || t.rest_base || '?per_page=100&page=' || CAST(p.page AS VARCHAR) || '&orderby=date&order=desc&_embed=wp:term'
          || '&_fields=id,title,link,date,date_gmt,parent,author,_links.wp:term,_embedded.wp:term' AS url
        FROM asked_c p JOIN types_kept_c t ON p.site = t.site AND p.type_key = t.type_key WHERE p.page >= 2""",
    "plan_vs_captures": """
        SELECT site, type_key || '|' || CAST(page AS VARCHAR) AS request_key, CAST(coalesce(status, 0) AS BIGINT) AS status,
          coalesce(status, 0) = 200 AS success,
          CASE WHEN status IS NULL THEN 'not captured' WHEN status = 200 THEN '' ELSE 'HTTP ' || CAST(status AS VARCHAR) END AS error
        FROM asked_c""",
    "plan_user_chunks": f"""
        SELECT site, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_ids,
          site || '/wp-json/wp/v2/users?include=' || string_agg(CAST(author_id AS VARCHAR), ',' ORDER BY rn)
          || '&per_page=100&_fields=id,name,description' AS url
        FROM (SELECT *, (rn - 1) // 100 AS chunk FROM (
          SELECT site, author_id, row_number() OVER (PARTITION BY site ORDER BY {gmt_epoch('latest_gmt')} DESC, first_seen) AS rn
          FROM author_latest_v))
        GROUP BY site, chunk""",
    "plan_post_urls": "SELECT site, id, site || '/wp-json/wp/v2/' || rest_base || '/' || CAST(id AS VARCHAR) "
                      "|| '?_embed=author,wp:term' AS url FROM listed",
    "terms_by_taxonomy": """
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY first_pos) - 1 AS BIGINT) AS tax_pos, taxonomy,
               array_to_string(names, '|') AS names
        FROM (SELECT id, taxonomy, min(pos) AS first_pos, list(name ORDER BY pos) AS names FROM fetched_terms GROUP BY id, taxonomy)""",
    "terms_flat": "SELECT id, array_to_string(terms_flat, '|') AS terms FROM flat",
})


# ---- batch 3: HTML jobs and documents --------------------------------------------------------

# Fixed values of the slim job in this dialect (no possessive quantifiers).
_BLOCK = r"'(?is)<pre\b[^>]*>.*?</pre\s*>|<code\b[^>]*>.*?</code\s*>'"
_PIECE = r"""'(?s)<!--.*?-->|<(?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+|<'"""
_ATTR = r"""'([^\s=/>"''<]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?'"""
_NAME = r"lower(regexp_extract({p}, '^</?([A-Za-z][^\s/>]*)', 1))"


# Elements without contents, blocks, and elements by how far an end tag reaches.
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
_BLOCKS = ("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
           "h5 h6 header hr main nav ol p pre section table ul").split()
_LEVELS = (("div",), ("td", "th"), ("tr",), ("tbody", "tfoot", "thead"), ("table",))
_RAW = r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]::VARCHAR[]"


def repaired(html: str) -> str:
    """Elements closed in order (H8): a list of open names, outermost first, carried over the pieces of the document."""
    piece = _PIECE.replace("(?s)<!--.*?-->", "(?is)<!--.*?-->|" + _RAW)
    name = (f"CASE WHEN regexp_matches(p, '^</?[A-Za-z]') AND NOT regexp_full_match(p, '(?is){_RAW}') "
            rf"THEN lower(regexp_extract(p, '^</?([A-Za-z][^\s/>]*)', 1)) ELSE '' END")
    into = ((_BLOCKS, ("p",), ("button", "caption", "table", "td", "th")), (("li",), ("li",), ("ol", "table", "ul")),
            (("dd", "dt"), ("dd", "dt"), ("dl", "table")), (("option",), ("option",), ("datalist", "select")),
            (("td", "th"), ("td", "th"), ("table", "tr")), (("tr",), ("tr",), ("table",)),
            (_LEVELS[3], _LEVELS[3], ("table",)))
    ends = "t.p[1:2] = '</'"
    shuts = f"CASE WHEN {ends} THEN [t.n] " + " ".join(f"WHEN list_contains({listed(names)}, t.n) THEN {listed(shut)}" for names, shut, _ in into) + " ELSE []::VARCHAR[] END"
    over = [f"WHEN {ends} AND list_contains({listed(level)}, t.n) THEN {listed([n for up in _LEVELS[i + 1:] for n in up])}" for i, level in enumerate(_LEVELS)]
    over.append(f"WHEN {ends} THEN {listed([n for level in _LEVELS for n in level])}")
    over += [f"WHEN list_contains({listed(names)}, t.n) THEN {listed(stop)}" for names, _, stop in into]
    void = f"list_contains({listed(_VOID)}, t.n)"
    items = (f"list_transform(list_transform(regexp_extract_all({html}, {piece}), lambda p: {{'p': p, 'n': {name}}}), lambda t: {{'s': []::VARCHAR[], 'o': '', 'p': t.p, 'n': t.n, "
             f"'k': CASE WHEN t.n = '' THEN 'text' WHEN {ends} AND {void} THEN 'stray' WHEN {ends} THEN 'end' WHEN {void} THEN 'void' WHEN suffix(t.p, '/>') THEN 'empty' ELSE 'start' END, "
             f"'x': {shuts}, 'w': CASE {' '.join(over)} ELSE []::VARCHAR[] END}})")
    first = "{'s': []::VARCHAR[], 'o': '', 'p': '', 'n': '', 'k': '', 'x': []::VARCHAR[], 'w': []::VARCHAR[]}"
    spot = "coalesce(list_max(list_filter(range(1, len(a.s) + 1), lambda j: list_contains(t.x, a.s[j]))), 0)"
    ok = f"({spot} > 0 AND t.k <> 'stray' AND NOT list_has_any(a.s[{spot} + 1:], t.w))"
    closed = f"CASE WHEN {ok} THEN array_to_string(list_transform(list_reverse(a.s[{spot}:]), lambda y: '</' || y || '>'), '') ELSE '' END"
    left = f"CASE WHEN {ok} THEN a.s[1:{spot} - 1] ELSE a.s END"
    own = "CASE t.k WHEN 'end' THEN '' WHEN 'stray' THEN '' WHEN 'empty' THEN t.p || '</' || t.n || '>' ELSE t.p END"
    step = (f"{{'s': CASE WHEN t.k = 'start' THEN list_append({left}, t.n) ELSE {left} END, 'o': a.o || {closed} || {own}, "
            "'p': '', 'n': '', 'k': '', 'x': []::VARCHAR[], 'w': []::VARCHAR[]}")
    last = f"list_reduce({items}, lambda a, t: {step}, {first})"
    return f"list_transform([{last}], lambda z: z.o || array_to_string(list_transform(list_reverse(z.s), lambda y: '</' || y || '>'), ''))[1]"


def slim(html: str, keep: tuple, drop: tuple, unwrap: tuple) -> str:
    """The slim job in SQL; nested drop tags are cut where they are balanced and do not nest in the data."""
    src = f"regexp_replace({html}, '(?i)</?(?:html|body)\\b[^>]*>', '', 'g')"
    src = f"regexp_replace({src}, '(?is)<!doctype[^>]*>|<\\?[^>]*>|<head\\b.*?</head\\s*>', '', 'g')"
    for tag in drop:
        src = f"regexp_replace({src}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    whole, src = repaired(src), "doc"
    rest = r"regexp_replace(p, '^<[A-Za-z][^\s/>]*|/?>$', '', 'g')"
    pairs = (f"list_filter(list_zip(list_transform(regexp_extract_all({rest}, {_ATTR}, 1), lambda a: lower(a)), regexp_extract_all({rest}, {_ATTR}, 2)), "
             f"lambda z: list_contains({listed(keep)}, z[1]))")
    value = r"""replace(regexp_replace(z[2], '^["'']|["'']$', '', 'g'), '"', '&quot;')"""
    words = f"list_filter(regexp_split_to_array({value}, '\\s+'), lambda w: w <> '')"
    rel = f"array_to_string(CASE WHEN list_contains({words}, 'noreferrer') THEN {words} ELSE list_append({words}, 'noreferrer') END, ' ')"
    has = lambda n: f"list_contains(list_transform({pairs}, lambda y: y[1]), '{n}')"
    attrs = f"array_to_string(list_transform({pairs}, lambda z: ' ' || z[1] || '=\"' || CASE WHEN z[1] = 'rel' AND {has('href')} THEN {rel} ELSE {value} END || '\"'), '')"
    name = _NAME.format(p="p")
    tag = f"'<' || {name} || {attrs} || CASE WHEN {has('href')} AND NOT {has('rel')} THEN ' rel=\"noreferrer\"' ELSE '' END || '>'"

    def rewritten(stretch: str, collapse: bool) -> str:
        words_ = f"regexp_replace(p, {WS_RUN}, ' ', 'g')" if collapse else "p"
        kept = f"list_filter(regexp_extract_all({stretch}, {_PIECE}), lambda p: NOT (regexp_matches(p, '^</?[A-Za-z]') AND list_contains({listed(unwrap)}, {name})))"
        return (f"array_to_string(list_transform({kept}, lambda p: CASE WHEN p[1] <> '<' OR p = '<' THEN {words_} WHEN NOT regexp_matches(p, '^</?[A-Za-z]') THEN p "
                f"WHEN p[1:2] = '</' THEN '</' || {name} || '>' ELSE {tag} END), '')")

    between = "regexp_replace(" + rewritten("s", True) + r", '[ \t\r\x00\x0B]*\n[ \t\n\r\x00\x0B]*', chr(10), 'g')"
    slimmed = php_trim(
        f"array_to_string(list_transform(list_zip(list_transform(regexp_split_to_array({src}, {_BLOCK}), lambda s: {between}), "
        f"list_transform(regexp_extract_all({src}, {_BLOCK}), lambda b: {rewritten('b', False)})), lambda z: z[1] || coalesce(z[2], '')), '')"
    )
    return f"list_transform([{whole}], lambda doc: {slimmed})[1]"


def count_of(e: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({e}, ''), '{pattern}')) AS BIGINT)"


VIEWS["page_bodies"] = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', '', 'g'),
       '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g') AS body
FROM pages"""

VIEWS["contents_v"] = """
SELECT p.id, p.rest_base, p.title_raw, p.link, p.date_gmt, p.author, coalesce(f.fragment, '<p>' || p.title_raw || '</p>') AS fragment
FROM posts_v p LEFT JOIN fragments_v f ON f.page_id = p.id"""

VIEWS["full_ok"] = f"""
SELECT p.id, CASE WHEN p.id % 31 = 0 THEN 0 ELSE p.id END AS shown, p.rest_base, p.title_raw, p.link, p.date_gmt,
  coalesce(c.c_name, '') AS author_name, p.fragment
FROM contents_v p LEFT JOIN customer c ON c.c_custkey = p.author
WHERE p.id % 23 <> 0 AND p.id % 29 <> 0 AND p.id % 37 <> 0"""

VIEWS["full_terms"] = """
SELECT id, pos, t.taxonomy AS taxonomy, t.name AS name FROM (
  SELECT id, unnest(list_concat(g1, g2)) AS t, generate_subscripts(list_concat(g1, g2), 1) AS pos
  FROM terms_v WHERE id IN (SELECT id FROM full_ok))
WHERE coalesce(t.taxonomy, '') <> '' AND t.name IS NOT NULL"""

VIEWS["full_tax"] = f"""
SELECT id, count(*) AS n_tax,
       string_agg(taxonomy || ': ' || CASE WHEN len(names) = 0 THEN '[]' ELSE '[ ' ||
         array_to_string(list_transform(names, lambda x: {yaml_scalar('x')}), ', ') || ' ]' END, chr(10) ORDER BY first_pos) AS lines
FROM (SELECT id, taxonomy, min(pos) AS first_pos, list(name ORDER BY pos) AS names FROM full_terms GROUP BY id, taxonomy)
GROUP BY id"""

VIEWS["front_matter_v"] = f"""
SELECT o.shown AS id, '---' || chr(10) || 'post_id: ' || CAST(o.shown AS VARCHAR) || chr(10)
  || 'date: ' || {yaml_scalar(fmt_datetime('o.date_gmt'))} || chr(10)
  || 'title: ' || {yaml_scalar(title_flat('o.title_raw'))} || chr(10)
  || coalesce(t.lines || chr(10), '')
  || CASE WHEN o.author_name <> '' THEN 'author: ' || {yaml_scalar('o.author_name')} || chr(10) ELSE '' END
  || 'permalink: ' || {yaml_scalar("coalesce(o.link, '')")} || chr(10) || '---' || chr(10) || chr(10) AS front_matter,
  CAST(6 + coalesce(t.n_tax, 0) + CASE WHEN o.author_name <> '' THEN 1 ELSE 0 END AS BIGINT) AS fm_lines,
  '# ' || {title_flat('o.title_raw')} AS heading,
  md5(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o.fragment, '(?is)<head\\b.*?</head>', '', 'g'),
    '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>|&#?\\w+;', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), ' ')) AS words_md5
FROM full_ok o LEFT JOIN full_tax t ON o.id = t.id"""

VIEWS["full_errors"] = """
SELECT p.id AS src_id, CASE WHEN p.id % 23 = 0 THEN 'post_fetch_failed' ELSE 'post_parse_failed' END AS error
FROM posts_v p WHERE p.id % 23 = 0 OR p.id % 29 = 0 OR p.id % 37 = 0"""

_ESC_TITLE = html_escape(title_flat("o.title_raw"))

QUERIES.update({
    "slim_pages": f"""
        SELECT page_id, variant, CAST(length(slim) AS BIGINT) AS n_chars, md5(slim) AS md5 FROM (
          SELECT page_id, 'default' AS variant, {slim("html", ("colspan", "rowspan", "href", "src", "alt"), ("script", "style"), ())} AS slim FROM pages
          UNION ALL SELECT page_id, 'other', {slim("html", ("href", "class", "rel"), ("script", "nav"), ("b", "span", "div"))} FROM pages)""",
    "markdown_pages": f"""
        SELECT page_id, true AS ok, '# Page ' || CAST(page_id AS VARCHAR) AS first_line,
          1 + {count_of('fragment', '(?i)<h[1-6]\\b[^>]*>')} AS n_headings,
          {count_of('fragment', '(?i)<table\\b[^>]*>')} AS n_tables,
          2 * {count_of('fragment', '(?i)<pre\\b[^>]*>')} AS n_fence_lines,
          {count_of('fragment', '(?i)<form\\b[^>]*>')} AS n_forms,
          CAST(0 AS BIGINT) AS n_scripts,
          CAST(len(regexp_extract_all(fragment, {_ICON})) AS BIGINT) AS n_icons,
          {count_of('fragment', '<a [^>]*href="https://xn--wgv71a119e[.]example/a%20b"')} AS n_pretty_links,
          md5(array_to_string(regexp_extract_all(regexp_replace(fragment, '(?s)<!--.*?-->|<[^>]*>|&#?\\w+;', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), ' ')) AS words_md5
        FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(fragment, '(?is)<head\\b.*?</head>', '', 'g'),
          '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g') AS fragment FROM fragments_v)""",
    "front_matter": "SELECT id, front_matter FROM front_matter_v",
    "markdown_documents": """
        SELECT id, CAST(NULL AS VARCHAR) AS error, fm_lines, heading, words_md5 FROM front_matter_v
        UNION ALL SELECT src_id, error, NULL, NULL, NULL FROM full_errors""",
    "html_documents": f"""
        SELECT id, error, title_tag, title_tag AS h1, true AS closed, md5('<html><head><meta charset="UTF-8"><meta name="robots" content="noindex, nofollow"><title>'
            || title_tag || '</title></head><body><h1>' || title_tag || '</h1>' || slim || '</body></html>') AS md5 FROM (
          SELECT o.shown AS id, CAST(NULL AS VARCHAR) AS error, {_ESC_TITLE} AS title_tag,
            {slim("regexp_replace(regexp_replace(o.fragment, '\\r\\n?', chr(10), 'g'), '(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g')", ("colspan", "rowspan", "href", "src", "alt"), ("script", "style"), ())} AS slim
          FROM full_ok o)
        UNION ALL SELECT src_id, error, NULL, NULL, NULL, NULL FROM full_errors""",
    "raw_documents": """
        SELECT shown AS id, CAST(NULL AS VARCHAR) AS error,
          md5(regexp_replace(regexp_replace(fragment, '\\r\\n?', chr(10), 'g'), '(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g')) AS md5
        FROM full_ok
        UNION ALL SELECT src_id, error, NULL FROM full_errors""",
})


def _index_lines(rows: str, summary: str, authors: str, heads: str, unreadable: str = "") -> str:
    return f"""
SELECT site, CAST(0 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS detail,
  '# ' || name AS text FROM ({heads})
UNION ALL SELECT site, 0, 0, 1, 0, 'View original: ' || site FROM ({heads})
UNION ALL SELECT site, 1, 0, 0, 0, '{'## Authors'}' FROM {authors} GROUP BY site
UNION ALL SELECT site, 1, 0, rank, 0, '### ' || name FROM {authors}
UNION ALL SELECT site, 1, 0, rank, 1, description FROM {authors} WHERE description <> ''
UNION ALL SELECT site, 2, type_pos, 0, 0, '## [' || slug || '] ' || type_name FROM {summary}
UNION ALL SELECT site, 2, type_pos, 0, 1, note FROM {summary} WHERE note <> ''
UNION ALL SELECT r.site, 2, s.type_pos, r.rank, d.detail, d.text
  FROM {rows} r JOIN {summary} s ON r.site = s.site AND r.type_key = s.type_key
  CROSS JOIN LATERAL (SELECT unnest([0, 1, 2, 3, 5]) AS detail, unnest(['- ' || r.line, '  - Post ID: ' || CAST(r.id AS VARCHAR), '  - Date: ' || r.date,
    CASE WHEN r.author_name <> '' THEN '  - Author: ' || r.author_name END, '  - Permalink: ' || r.permalink]) AS text) d
  WHERE d.text IS NOT NULL""" + unreadable


VIEWS["index_lines_v"] = _index_lines("index_rows_v", "type_summary_v", "authors_v", "SELECT site, 'example.com' AS name FROM types_kept GROUP BY site")

QUERIES["site_index_lines"] = "SELECT * FROM index_lines_v"

QUERIES.update({
    "api_path_parts": f"""
        SELECT page_id, CAST(i - 1 AS BIGINT) AS link_pos, {tag_attr('tag', 'href')} AS href,
          regexp_extract({tag_attr('tag', 'href')}, {_API}, 1) AS rest_base,
          coalesce(TRY_CAST(regexp_extract({tag_attr('tag', 'href')}, {_API}, 2) AS BIGINT), 0) AS id
        FROM (SELECT page_id, unnest(regexp_extract_all(html, {_LINKS})) AS tag,
                     generate_subscripts(regexp_extract_all(html, {_LINKS}), 1) AS i FROM alt_pages_v)""",
    "date_label": f"""
        SELECT id, d AS "full", split_part(d, ' ', 1) AS date_only, '' AS "none" FROM (
          SELECT o_orderkey AS id, {fmt_datetime("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')")} AS d FROM orders)""",
})


# ---- batch 4: the index over captured responses of several sites ----------------------------
# Three sites have a type map; two types responses failed. Of the planned pages, one was never captured
# (first site), two answered 401 and 500 (second site); page 2 of 3-MEDIUM has a broken body everywhere.

VIEWS["sites_c"] = """
SELECT unnest(['https://example.com', 'https://two.example.com/blog', 'https://four.example.com']) AS site"""

VIEWS["types_c"] = """
SELECT s.site, CAST(row_number() OVER (PARTITION BY s.site ORDER BY type_key) - 1 AS BIGINT) AS type_pos,
       type_key, slug, name, rest_base
FROM types_v JOIN sites_c s ON true"""

VIEWS["types_kept_c"] = r"""
SELECT * FROM types_c
WHERE slug IS NOT NULL AND NOT (regexp_matches(slug, '^wp_') OR slug = 'attachment')
  AND NOT regexp_matches(coalesce(name, ''), '^2-') AND rest_base IS NOT NULL"""

VIEWS["planned_c"] = """
SELECT t.site, t.type_key, g.page,
  CASE WHEN t.site = 'https://example.com' AND t.type_key = '5-LOW' AND g.page = 2 THEN NULL
       WHEN t.site = 'https://two.example.com/blog' AND t.type_key = '1-URGENT' AND g.page = 1 THEN 401
       WHEN t.site = 'https://two.example.com/blog' AND t.type_key = '3-MEDIUM' AND g.page = 2 THEN 500 ELSE 200 END AS status
FROM types_kept_c t JOIN type_counts c ON t.type_key = c.type_key,
  LATERAL (SELECT unnest(generate_series(1, least(CAST(greatest(ceil(c.total / 100), 1) AS BIGINT), 2))) AS page) g"""

VIEWS["asked_c"] = """
SELECT * FROM planned_c p WHERE page = 1 OR EXISTS (
  SELECT 1 FROM planned_c f WHERE f.site = p.site AND f.type_key = p.type_key AND f.page = 1 AND f.status = 200)"""

VIEWS["report_c"] = """
SELECT t.site, t.type_pos, t.type_key, t.name, CAST(f.status AS BIGINT) AS status,
  CASE WHEN f.status = 401 THEN 'unreadable' WHEN m.page IS NULL THEN 'readable' ELSE 'fatal' END AS class,
  CASE WHEN f.status = 401 OR m.page IS NULL THEN '' ELSE 'slug: ' || t.type_key || ', page ' || CAST(m.page AS VARCHAR)
       || CASE WHEN m.status IS NULL THEN ', not captured' ELSE ', HTTP ' || CAST(m.status AS VARCHAR) END END AS error
FROM types_kept_c t JOIN asked_c f ON t.site = f.site AND t.type_key = f.type_key AND f.page = 1
LEFT JOIN (SELECT * FROM asked_c WHERE page > 1 AND coalesce(status, 0) <> 200) m ON t.site = m.site AND t.type_key = m.type_key"""

VIEWS["fetched_c"] = """
SELECT t.site, r.* EXCLUDE (site), t.type_pos FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.type_key ORDER BY p.date DESC, p.id DESC) AS rn FROM posts_v p) r
JOIN types_kept_c t ON r.type_key = t.type_key
JOIN report_c x ON x.site = t.site AND x.type_key = r.type_key AND x.class = 'readable'
WHERE r.rn <= 200 AND NOT (r.type_key = '3-MEDIUM' AND r.rn > 100)"""

VIEWS["users_c"] = """
SELECT s.site, id, CASE WHEN id % 10 = 0 AND (id // 100 + 1) % 7 <> 3 THEN name || ' (2)' ELSE name END AS name, description
FROM users_v JOIN sites_c s ON true WHERE (id // 100) % 7 <> 3 OR (id % 10 = 0 AND (id // 100 + 1) % 7 <> 3)"""


def _captured_copy(names: list[str], renames: dict[str, str]) -> None:
    """Copies of listing views that read the captured inputs (view references renamed)."""
    import re as _re

    for n in names:
        body = VIEWS[n]
        for old, new in renames.items():
            body = _re.sub(rf"\b{old}\b", new, body)
        VIEWS[n + "_c"] = body


_CHAIN = ["fetched_terms", "terms_flat_v", "flat", "parented", "listed", "author_latest_v", "authors_v", "index_rows_v"]
_captured_copy(_CHAIN, {**{n: n + "_c" for n in _CHAIN}, "fetched": "fetched_c", "users_v": "users_c"})

VIEWS["type_summary_c"] = """
SELECT t.site, t.type_pos, t.type_key, t.slug, t.name AS type_name,
       CAST(c.total AS BIGINT) AS total_found, CAST(greatest(ceil(c.total / 100), 1) AS BIGINT) AS total_pages,
       greatest(ceil(c.total / 100), 1) > 2 AS truncated, CAST(coalesce(n.listed, 0) AS BIGINT) AS listed,
       CASE WHEN greatest(ceil(c.total / 100), 1) > 2 THEN 'Showing the latest ' || CAST(coalesce(n.listed, 0) AS VARCHAR)
            || ' of ' || CAST(c.total AS VARCHAR) || ' items.' ELSE '' END AS note
FROM types_kept_c t JOIN report_c x ON x.site = t.site AND x.type_key = t.type_key AND x.class = 'readable'
LEFT JOIN type_counts c ON t.type_key = c.type_key
LEFT JOIN (SELECT site, type_key, count(*) AS listed FROM listed_c GROUP BY site, type_key) n
  ON t.site = n.site AND t.type_key = n.type_key"""

QUERIES.update({
    "captured_index_rows": "SELECT * FROM index_rows_v_c",
    "captured_type_report": "SELECT * FROM report_c",
    "captured_type_summary": "SELECT * FROM type_summary_c",
    "captured_errors": """
        SELECT site, type_key, error FROM report_c WHERE class = 'fatal'
        UNION ALL SELECT 'https://three.example.com', NULL, 'types: Operation timed out'
        UNION ALL SELECT 'https://five.example.com', NULL, 'types: not a JSON object'""",
    "captured_index_lines": _index_lines(
        "index_rows_v_c", "type_summary_c", "authors_v_c",
        "SELECT site, regexp_extract(site, '://([^/]*)', 1) AS name FROM (SELECT unnest(['https://example.com', 'https://two.example.com/blog', "
        "'https://three.example.com', 'https://four.example.com', 'https://five.example.com']) AS site)",
        """
UNION ALL SELECT site, 3, 0, 0, 0, '## Post types that could not be read' FROM report_c WHERE class = 'unreadable' GROUP BY site
UNION ALL SELECT site, 3, 0, type_pos + 1, 0, '- [' || type_key || '] ' || name FROM report_c WHERE class = 'unreadable'"""),
    "index_rows_agent": """
        SELECT l.site, l.id, l.link AS permalink, l.href || '?html' AS href, """ + _LINE.replace("l.date_label", "''").replace("l.href", "l.href || '?html'") + """ AS line
        FROM listed l LEFT JOIN authors_v a ON l.site = a.site AND l.author_id = a.author_id""",
    "filter_posts": f"""
        SELECT site, id, title FROM (SELECT site, id, {title_flat('title_raw')} AS title FROM posts_v)
        WHERE NOT (regexp_matches(title, '^Order \\d*7 P$') OR title = 'Order 42 F') AND id NOT IN (7, 44, 1234)
          AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)""",
    "rule_kind": r"""
        SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(v, '(?i)^[a-f]') THEN '0' END, CASE WHEN regexp_matches(v, 'PROMO$') THEN '1' END,
          CASE WHEN regexp_matches(v, '\p{Lu}C') THEN '2' END, CASE WHEN v = '/unclosed(/' THEN '3' END,
          CASE WHEN regexp_matches(v, '^l\w+[ \t]') THEN '4' END, CASE WHEN contains(v, 'widg') THEN '5' END) AS matched, 'r,r,r,s,r,r' AS kinds
        FROM (SELECT p_partkey, p_name || ' ' || p_type AS v FROM part)""",
})

_RAW_MD5 = ("md5(regexp_replace(regexp_replace(fragment, '\\r\\n?', chr(10), 'g'), '(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g'))")
QUERIES["incremental_documents"] = f"""
    SELECT shown AS id, CAST(NULL AS VARCHAR) AS error, {_RAW_MD5} AS md5, CAST(2 AS BIGINT) AS run_id FROM full_ok WHERE shown % 2 = 1
    UNION ALL SELECT src_id, error, NULL, 2 FROM full_errors WHERE src_id % 2 = 1
    UNION ALL SELECT shown, NULL, {_RAW_MD5}, 3 FROM full_ok
    UNION ALL SELECT src_id, error, NULL, 3 FROM full_errors"""

# What each post was in each of the five runs that saw it: a as captured, f failed, c changed.
VIEWS["run_states"] = """
WITH p AS (
  SELECT id, shown, true AS ok, CAST(NULL AS VARCHAR) AS error FROM full_ok UNION ALL SELECT src_id, src_id, false, error FROM full_errors
), seen AS (
  SELECT id, shown, ok, error, 1 AS run, 'a' AS state FROM p WHERE shown % 2 = 0
  UNION ALL SELECT id, shown, ok, error, 2, CASE WHEN ok AND shown % 4 = 0 THEN 'f' ELSE 'a' END FROM p
  UNION ALL SELECT id, shown, ok, error, 3, 'a' FROM p WHERE shown % 8 = 0
  UNION ALL SELECT id, shown, ok, error, 4, 'c' FROM p WHERE shown % 3 = 0
  UNION ALL SELECT id, shown, ok, error, 5, 'a' FROM p WHERE shown % 6 = 0
)
SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY run) AS old FROM seen) WHERE old IS DISTINCT FROM state"""
VIEWS["versions_v"] = """
SELECT s.id, s.shown, s.ok, s.state, 'post|' || coalesce(p.rest_base, '') || '|' || CAST(s.id AS VARCHAR) AS request_key,
  CASE WHEN s.state = 'f' THEN 'post_fetch_failed' ELSE s.error END AS error,
  CAST(s.run AS BIGINT) AS valid_from, CAST(lead(s.run) OVER (PARTITION BY s.id ORDER BY s.run) AS BIGINT) AS valid_to
FROM run_states s JOIN posts_v p ON p.id = s.id"""
QUERIES["document_versions"] = "SELECT request_key, error, valid_from, valid_to FROM versions_v"
QUERIES["latest_documents"] = f"""
    SELECT request_key, v.shown AS id, error, CASE WHEN v.ok AND v.state <> 'f' THEN
      {_RAW_MD5.replace("(fragment,", "(f.fragment || CASE WHEN v.state = 'c' THEN chr(10) || 'changed' ELSE '' END,")} END AS md5, valid_from AS run_id
    FROM versions_v v JOIN contents_v f ON f.id = v.id WHERE valid_to IS NULL"""

QUERIES["rejected_urls"] = f"SELECT batch_id, request_key, url FROM batches_v WHERE NOT {same_site('base', 'url')}"

# Offsets add up in the order of the lines.
QUERIES["site_index_text"] = f"""
    SELECT site, CAST(coalesce(sum(n) OVER (PARTITION BY site ORDER BY kind, section, pos, detail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
      CAST(n AS BIGINT) AS n_bytes, md5(text) AS md5
    FROM (SELECT *, strlen(text) + 1 AS n FROM ({QUERIES["captured_index_lines"]}))"""

QUERIES["page_of_post"] = """
    SELECT site, type_key, id, date, (n - 1) // 100 + 1 AS page, (n - 1) % 100 AS pos
    FROM (SELECT site, type_key, id, date, row_number() OVER (PARTITION BY site, type_key ORDER BY date DESC, id DESC) AS n FROM posts_v)"""

# What each shape of rule means, written out.
QUERIES["rule_match"] = """
    SELECT p_partkey, name || '|' || kind AS rule_id
    FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS v FROM part) t
    JOIN (SELECT p_name AS name, p_type AS kind, regexp_extract(p_name, '[^ ]*$') AS second, (ascii(p_name) + 3 * length(p_name) + ascii(p_type)) % 7 AS shape,
        CAST(length(p_name) % 5 + 1 AS VARCHAR) AS size FROM (SELECT DISTINCT p_name, p_type FROM part)) r
    ON CASE shape
      WHEN 0 THEN v = name || ' ' || kind || ' Brand#' || size
      WHEN 1 THEN contains(v, name || ' ' || kind)
      WHEN 2 THEN starts_with(lower(v), lower(name) || ' ')
      WHEN 3 THEN regexp_matches(lower(v), lower(kind) || ' brand#1[0-9]$')
      WHEN 4 THEN contains(v, second || ' ' || kind) OR contains(v, 'nothing ' || kind)
      WHEN 5 THEN v[1] BETWEEN 'a' AND 'c' AND contains(v[2:], second[1])
      ELSE v = '/unclosed(/' || kind END"""
