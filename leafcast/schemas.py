"""The data model as Spark DDL schemas.

Input-side schemas are used to read captured responses and JSON bodies with explicit
types (no inference); output-side schemas document what the operators produce and are
asserted by the tests.
"""

from __future__ import annotations

# Schemas of captured data and JSON bodies.
TERMS = "array<array<struct<taxonomy:string,name:string>>>"
CAPTURE = ("site string, request_key string, kind string, type_key string, page int, url string, status int, "
           "headers_raw string, body string, error string, fetched_at bigint")
POST_CAPTURE = ("site string, rest_base string, id bigint, request_key string, kind string, status int, "
                "body string, error string, fetched_at bigint")
TYPES_CAPTURE = "site string, request_key string, kind string, status int, body string, error string, fetched_at bigint"
ROOTS_CAPTURE = "site string, kind string, status int, body string, error string, fetched_at bigint"
COLLECTIONS_CAPTURE = ("site string, request_key string, kind string, type_key string, page int, status int, "
                       "headers_raw string, body string, error string, fetched_at bigint")
USERS_CAPTURE = "site string, chunk bigint, request_key string, status int, body string, error string, fetched_at bigint"
POST_JSON = (
    "struct<id:bigint,title:struct<rendered:string>,link:string,date:string,date_gmt:string,parent:bigint,"
    "author:bigint,content:struct<rendered:string>,"
    "_embedded:struct<`wp:term`:" + TERMS + ",author:array<struct<id:bigint,name:string>>>>"
)
USER_JSON = "struct<id:bigint,name:string,description:string>"
TYPE_MAP_JSON = "map<string,struct<slug:string,name:string,rest_base:string>>"

# Outputs (column names in order).
INDEX_ROWS = ("site", "type_key", "slug", "rank", "id", "title", "parent_title", "terms", "date", "date_label",
              "author_id", "author_name", "link", "permalink", "href", "line")
TYPE_SUMMARY = ("site", "type_pos", "type_key", "slug", "type_name", "total_found", "total_pages", "truncated",
                "listed", "note")
AUTHORS = ("site", "rank", "author_id", "name", "description", "latest_gmt")
DOCUMENTS = ("site", "request_key", "rest_base", "id", "mode", "title", "body", "error", "src_hash")
INDEX_LINES = ("site", "kind", "section", "pos", "detail", "text")
# Written tables of a site index, by name.
INDEX_TABLES = {
    "index_rows": "site string, type_key string, slug string, rank int, id bigint, title string, parent_title string, terms string, date string, "
                  "date_label string, author_id bigint, author_name string, link string, permalink string, href string, line string, run_id bigint",
    "type_summary": "site string, type_pos int, type_key string, slug string, type_name string, total_found bigint, total_pages bigint, "
                    "truncated boolean, listed bigint, note string, run_id bigint",
    "type_report": "site string, type_pos int, type_key string, name string, status int, class string, error string, run_id bigint",
    "errors": "site string, type_key string, error string, run_id bigint",
    "index_lines": "site string, kind bigint, section bigint, pos bigint, detail bigint, text string, n_bytes bigint, byte_offset bigint, run_id bigint",
}
