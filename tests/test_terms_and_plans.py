"""A10 cases the reference leaves untested: terms grouping and collection URLs."""

from pyspark.sql import functions as F

from leafcast.functions import terms
from leafcast.plans import requests as rq

TERMS = "array<array<struct<taxonomy:string,name:string>>>"


def test_terms_grouping_edges(spark):
    rows = [
        (1, [[("category", "News"), ("post_tag", "a")], [("category", "Tech"), ("", "skip"), ("post_tag", None)],
             [("case_tag", "PLC"), ("post_tag", "b")]]),
        (2, None),
        (3, [[]]),
    ]
    df = spark.createDataFrame(rows, f"id int, t {TERMS}")
    got = {r.id: ([(g.taxonomy, list(g.names)) for g in r.g], list(r.f))
           for r in df.select("id", terms.terms_by_taxonomy(F.col("t")).alias("g"), terms.terms_flat(F.col("t")).alias("f")).collect()}
    assert got[1] == ([("category", ["News", "Tech"]), ("post_tag", ["a", "b"]), ("case_tag", ["PLC"])],
                      ["News", "Tech", "a", "b", "PLC"])
    assert got[2] == ([], []) and got[3] == ([], [])


def test_collection_url_clamps(spark):
    df = spark.createDataFrame([("https://s.test", "posts", 3)], "site string, rb string, page int")
    for per_page, shown in ((0, 1), (1, 1), (100, 100), (500, 100)):
        (u,) = [r.u for r in df.select(rq.collection_url(F.col("site"), F.col("rb"), F.col("page"), per_page).alias("u")).collect()]
        assert u == (f"https://s.test/wp-json/wp/v2/posts?per_page={shown}&page=3&orderby=date&order=desc&_embed=wp:term"
                     "&_fields=id,title,link,date,date_gmt,parent,author,_links.wp:term,_embedded.wp:term")
    (p,) = [r.u for r in df.select(rq.post_url(F.col("site"), F.col("rb"), F.lit(7)).alias("u")).collect()]
    assert p == "https://s.test/wp-json/wp/v2/posts/7?_embed=author,wp:term"
