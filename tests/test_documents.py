"""W1/W2 front matter and documents; incremental runs; the streaming form equals the batch form."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.operators import documents as docs
from leafcast.options import Options
from leafcast.sources import adapters
from leafcast.sources import captures as cap

TERMS = "array<array<struct<taxonomy:string,name:string>>>"


def _fm(spark, rows, opts):
    df = spark.createDataFrame(rows, f"id bigint, date_gmt string, title string, terms {TERMS}, author string, link string")
    fm = docs.front_matter(F.col("id"), F.col("date_gmt"), F.col("title"), F.col("terms"), F.col("author"), F.col("link"), opts,
                           F.lit("https://s.test/wp-json/wp/v2/posts/1?_embed=author,wp:term"))
    return [r.fm for r in df.select("id", fm.alias("fm")).orderBy("id").collect()]


def test_front_matter_goldens(spark):
    terms = [[("category", "News"), ("category", "Tech: AI"), ("", "skip"), ("case_tag", None)], [("case_tag", "PLC")]]
    rows = [
        (1, "2031-11-02T22:15:00", "Tide tables", terms, "Ann", "https://s.test/?p=1"),
        (2, "", "plain", None, "", "https://s.test/p2"),
    ]
    a, b = _fm(spark, rows, Options(timezone="Asia/Tokyo"))
    assert a == ("---\npost_id: 1\ndate: \"2031-11-03 07:15:00 +09:00\"\ntitle: \"Tide tables\"\n"
                 "category: [ News, \"Tech: AI\" ]\ncase_tag: [ PLC ]\nauthor: Ann\n"
                 "permalink: \"https://s.test/?p=1\"\n---\n\n")
    assert b == "---\npost_id: 2\ndate: \"\"\ntitle: plain\npermalink: \"https://s.test/p2\"\n---\n\n"
    (c, _) = _fm(spark, rows, Options(timezone="UTC", show_api_endpoint=True))
    assert 'api_endpoint: "https://s.test/wp-json/wp/v2/posts/1?_embed=author,wp:term"\n---\n\n' in c


def _posts(spark):
    return cap.full_post(cap.latest_per_key(adapters.full_posts_capture_v(spark, SMALL)))


def test_documents_modes_and_errors(spark):
    opts = Options(timezone="Asia/Tokyo")
    for mode in ("markdown", "html", "raw"):
        d = docs.build_documents(_posts(spark), opts, mode).collect()
        ok = [r for r in d if r.error is None]
        bad = [r for r in d if r.error is not None]
        assert len(d) == 1500 and bad and all(r.body is None for r in bad)
        if mode == "markdown":
            assert all(r.body.startswith("---\npost_id: ") and f"\n---\n\n# {r.title}\n\n" in r.body for r in ok)
        if mode == "html":
            assert all(r.body.startswith('<html><head><meta charset="UTF-8">') and r.body.endswith("</body></html>") for r in ok)
            assert all("<script" not in r.body and " class=" not in r.body for r in ok)


def test_incremental_second_run_converts_nothing(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="leafcast-inc-", dir="/tmp"), "docs")
    opts = Options(timezone="UTC")
    first = docs.incremental_documents(spark, _posts(spark), out, opts, run_id=1)
    first.write.mode("append").parquet(out)
    n1 = spark.read.parquet(out).count()
    second = docs.incremental_documents(spark, _posts(spark), out, opts, run_id=2)
    assert n1 == 1500 and second.count() == 0
    changed = _posts(spark).withColumn("content", F.when(F.col("id") == 5, F.lit("<p>new</p>")).otherwise(F.col("content")))
    third = docs.incremental_documents(spark, changed, out, opts, run_id=3)
    third.write.mode("append").parquet(out)
    assert [r.id for r in third.collect()] == [5]
    latest = {r.id: r.run_id for r in docs.latest_documents(spark, out).collect()}
    assert latest[5] == 3 and latest[6] == 1


def test_stream_equals_batch(spark):
    from leafcast.streaming.documents_stream import CAPTURE_SCHEMA, start_document_stream

    root = tempfile.mkdtemp(prefix="leafcast-stream-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    captures = adapters.full_posts_capture_v(spark, SMALL).select(*[c.split()[0] for c in CAPTURE_SCHEMA.split(", ")])
    captures.where(F.col("id") % 2 == 0).write.parquet(os.path.join(src, "part=0"))
    captures.where(F.col("id") % 2 == 1).write.parquet(os.path.join(src, "part=1"))
    opts = Options(timezone="UTC")
    # A stable name resumes a stream; each test run is a new stream.
    q = start_document_stream(spark, src, out, opts, name=f"docs_test_{os.path.basename(root)}", max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out).select("id", "body", "error")
    batch = docs.build_documents(cap.full_post(captures), opts).select("id", "body", "error")
    assert streamed.count() == captures.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_runs_hash_once_and_move_what_the_mode_needs(spark):
    """The source hash is made before the join with the current versions; raw documents take no terms through it."""
    out = os.path.join(tempfile.mkdtemp(prefix="leafcast-inc-", dir="/tmp"), "docs")
    rows = [("s", f"k{i}", "posts", i, "T", "<p>x</p>", "l", "", "A", [[("category", "News")]], "") for i in range(6)] + [(None, None, "posts", 9, "T", "c", "l", "", "A", None, "")]
    posts = spark.createDataFrame(rows, f"site string, request_key string, rest_base string, id bigint, title_raw string, content string, link string, date_gmt string, author_name string, terms {TERMS}, error string")
    opts = Options(timezone="UTC")
    docs.incremental_documents(spark, posts.where("id <> 3"), out, opts, "raw", run_id=1).write.parquet(out)
    second = docs.incremental_documents(spark, posts, out, opts, "raw", run_id=2)
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    assert [(r.id, r.request_key, r.run_id) for r in second.collect()] == [(3, "k3", 2)]
    want = docs.build_documents(posts, opts, "raw").where("id = 3").first().src_hash
    assert second.first().src_hash == want
    second.write.mode("append").parquet(out)
    assert docs.incremental_documents(spark, posts, out, opts, "raw", run_id=3).count() == 0
    assert {r.src_hash for r in docs.document_versions(spark, out).collect()} == {r.src_hash for r in spark.read.parquet(out).collect()}
