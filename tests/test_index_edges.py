"""Edge tables for the index operators: ties, blanks, duplicates, missing parents and users."""

from pyspark.sql import functions as F

from leafcast.operators import index as idx
from leafcast.operators import types as ty
from leafcast.options import Options
from leafcast.plans import requests as rq
from leafcast.sources import captures as cap

POST_COLS = ("site string, type_key string, type_pos int, rest_base string, id bigint, title_raw string, link string, "
             "date string, date_gmt string, parent bigint, author bigint, page int, pos int")


def _posts(spark, rows):
    df = spark.createDataFrame(rows, POST_COLS)
    return df.withColumn("terms_flat", F.array().cast("array<string>")).withColumn("slug", F.col("rest_base"))


S, T = "https://s.test", "post"


def test_parent_titles_edges(spark):
    rows = [
        (S, T, 0, "posts", 1, "Parent", "", "2024-01-05", "2024-01-05T00:00:00", 0, 5, 1, 0),
        (S, T, 0, "posts", 2, "Child", "", "2024-01-04", "2024-01-04T00:00:00", 1, 5, 1, 1),
        (S, T, 0, "posts", 3, "Orphan", "", "2024-01-03", "2024-01-03T00:00:00", 99, 5, 1, 2),
        (S, T, 0, "posts", 4, "Dup old", "", "2024-01-02", "2024-01-02T00:00:00", 0, 6, 1, 3),
        (S, T, 0, "posts", 4, "Dup new", "", "2024-01-01", "2024-01-01T00:00:00", 0, 6, 2, 0),
        (S, T, 0, "posts", 5, "Of dup", "", "2024-01-01", "2024-01-01T00:00:00", 4, 6, 2, 1),
        (S, "page", 1, "pages", 6, "Other type", "", "2024-01-01", "2024-01-01T00:00:00", 1, 6, 1, 0),
    ]
    opts = Options(exclude_titles=("Parent",))
    listed = idx.listing(_posts(spark, rows), opts, capped=True)
    got = {(r.type_key, r.id, r.title): r.parent_title for r in listed.collect()}
    assert ("post", 1, "Parent") not in got                # excluded...
    assert got[("post", 2, "Child")] == "Parent"           # ...but still names its child's parent
    assert got[("post", 3, "Orphan")] == ""                # parent not fetched
    assert got[("post", 5, "Of dup")] == "Dup new"         # duplicate id: last fetched title wins
    assert got[("page", 6, "Other type")] == ""            # parents resolve within the same type only
    assert got[("post", 4, "Dup old")] == "" and got[("post", 4, "Dup new")] == ""


def test_listing_rank_ties_and_blank_dates(spark):
    rows = [
        (S, T, 0, "posts", 10, "blank", "", "", "", 0, 1, 1, 0),
        (S, T, 0, "posts", 11, "tie b", "", "2024-01-01", "2024-01-01T00:00:00", 0, 1, 1, 2),
        (S, T, 0, "posts", 12, "tie a", "", "2024-01-01", "2024-01-01T00:00:00", 0, 1, 1, 1),
        (S, T, 0, "posts", 13, "new", "", "2024-02-01", "2024-02-01T00:00:00", 0, 1, 2, 0),
        (S, T, 0, "posts", 14, "junk", "", "x", "not a date", 0, 1, 2, 1),
    ]
    listed = idx.listing(_posts(spark, rows), Options(timezone="UTC", show_date="full"), capped=True)
    order = [r.id for r in listed.orderBy("rank").collect()]
    assert order == [13, 12, 11, 10, 14]
    labels = {r.id: (r.date_local, r.date_label) for r in listed.collect()}
    assert labels[10] == ("", "") and labels[13] == ("2024-02-01 00:00:00 +00:00",) * 2


def test_exclude_ids_and_titles(spark):
    rows = [(S, T, 0, "posts", i, f"Post {i}", "", "2024-01-01", "2024-01-01T00:00:00", 0, 1, 1, i) for i in range(1, 6)]
    opts = Options(exclude_ids=("2", 4), exclude_titles=("/post 5/i", " Post 1 "))
    assert sorted(r.id for r in idx.listing(_posts(spark, rows), opts, capped=True).collect()) == [3]


def test_authors_order_and_joins(spark):
    rows = [
        (S, T, 0, "posts", 1, "a", "", "2024-01-01", "2024-01-01T00:00:00", 0, 7, 1, 0),
        (S, T, 0, "posts", 2, "b", "", "2024-03-01", "2024-03-01T00:00:00", 0, 8, 1, 1),
        (S, T, 0, "posts", 3, "c", "", "2024-03-01", "2024-03-01T00:00:00", 0, 9, 1, 2),
        (S, T, 0, "posts", 4, "d", "", "2024-01-01", "2024-01-01T00:00:00", 0, 0, 1, 3),
        (S, T, 0, "posts", 5, "e", "", "2024-05-01", "2024-05-01T00:00:00", 0, 10, 1, 4),
        (S, T, 0, "posts", 6, "gone", "", "2024-06-01", "2024-06-01T00:00:00", 0, 11, 1, 5),
    ]
    users = spark.createDataFrame([(S, 7, "Seven", "bio\nline"), (S, 8, " Eight ", ""), (S, 9, "Nine", ""),
                                   (S, 10, "  ", "blank name"), (S, 11, "Eleven", "")],
                                  "site string, id bigint, name string, description string")
    listed = idx.listing(_posts(spark, rows), Options(exclude_titles=("gone",)), capped=True)
    latest = {r.author_id: r.latest_gmt for r in idx.author_latest(listed).collect()}
    assert 0 not in latest and 11 not in latest  # author 0 never; a fully excluded author disappears
    a = idx.authors(listed, users).orderBy("rank").collect()
    assert [(r.rank, r.author_id, r.name) for r in a] == [(1, 8, "Eight"), (2, 9, "Nine"), (3, 7, "Seven")]
    rows_out = {r.id: r.author_name for r in idx.index_rows(listed, idx.authors(listed, users)).collect()}
    assert rows_out[1] == "Seven" and rows_out[5] == "" and rows_out[4] == ""


def test_newest_per_type_cap_and_pages(spark):
    rows = [(S, T, 0, "posts", i, f"p{i}", "", f"2024-01-{i:02d}", f"2024-01-{i:02d}T00:00:00", 0, 1, 0, 0)
            for i in range(1, 21)]
    df = _posts(spark, rows).drop("page", "pos").repartition(4)
    opts = Options(posts_per_page=3, max_pages_per_type=2)
    got = [(r.id, r.page, r.pos) for r in idx.newest_per_type(df, opts).orderBy("page", "pos").collect()]
    assert got == [(20, 1, 0), (19, 1, 1), (18, 1, 2), (17, 2, 0), (16, 2, 1), (15, 2, 2)]
    assert Options(posts_per_page=0).per_page == 1 and Options(posts_per_page=500).per_page == 100


def test_readability_and_totals(spark):
    fp = spark.createDataFrame([
        (S, "a", "A", 200, "X-WP-Total: 250\r\nX-WP-TotalPages: 3\r\n", ""),
        (S, "b", None, 401, "", ""),
        (S, "c", "C", 404, "", ""),
        (S, "d", "D", 500, "", ""),
        (S, "e", "E", 0, "", "timeout"),
        (S, "f", "F", 200, "x-wp-total: junk\r\n", ""),
    ], "site string, type_key string, name string, status int, headers_raw string, error string")
    cls = {r.type_key: (r["class"], r.name, r.error) for r in ty.type_readability(fp).collect()}
    assert cls["a"][0] == "readable" and cls["b"] == ("unreadable", "b", "") and cls["c"][0] == "unreadable"
    assert cls["d"] == ("fatal", "D", "slug: d, HTTP 500") and cls["e"] == ("fatal", "E", "slug: e, timeout")
    tot = {r.type_key: (r.total_found, r.total_pages, r.truncated) for r in ty.type_totals(fp, Options()).collect()}
    assert tot["a"] == (250, 3, True) and tot["b"] == (0, 1, False) and tot["f"] == (0, 1, False)


def test_next_pages_never_count_down(spark):
    types = spark.createDataFrame([(S, "one", "ones"), (S, "three", "threes"), (S, "zero", "zeros")],
                                  "site string, type_key string, rest_base string")
    totals = spark.createDataFrame([(S, "one", 1), (S, "three", 3), (S, "zero", 0)], "site string, type_key string, total_pages int")
    plan = rq.next_pages(types, totals, types.select("site", "type_key"), Options(max_pages_per_type=2)).collect()
    assert [(r.type_key, r.page) for r in plan] == [("three", 2)]
    assert "per_page=100&page=2&orderby=date&order=desc" in plan[0].url


def test_users_last_record_wins(spark):
    c = spark.createDataFrame([
        (S, 0, 200, '[{"id": 1, "name": "A", "description": "x"}, {"id": 2, "name": "B"}]', ""),
        (S, 1, 200, '[{"id": 1, "name": "A2", "description": "y"}]', ""),
        (S, 2, 500, '[{"id": 2, "name": "lost"}]', ""),
        (S, 3, 200, "not json", ""),
    ], "site string, chunk int, status int, body string, error string")
    got = {r.id: r.name for r in cap.users_from_chunks(c).collect()}
    assert got == {1: "A2", 2: "B"}
