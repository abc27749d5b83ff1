"""Captures that were fetched again, and documents that fail, recover, change and go back."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from leafcast import schemas
from leafcast.operators import documents as docs
from leafcast.operators import report
from leafcast.options import Options
from leafcast.plans import jobs
from leafcast.sources import captures as cap

CAPTURE = "site string, request_key string, status int, body string, error string, fetched_at bigint"
OPTS = Options()


def latest(spark, rows, schema=CAPTURE):
    got = cap.latest_per_key(spark.createDataFrame(rows, schema).repartition(3))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_the_last_fetch_counts_whatever_its_status(spark):
    rows = [("a", "k", 503, "x", "", 1), ("a", "k", 200, "new", "", 2), ("a", "l", 200, "ok", "", 1), ("a", "l", 500, "", "", 2), ("b", "k", 200, "b", "", 1)]
    assert latest(spark, rows) == [rows[1], rows[3], rows[4]]


def test_ties_prefer_a_success_and_copies_count_once(spark):
    rows = [("a", "k", 503, "x", "", 7), ("a", "k", 200, "y", "", 7)] + [("a", "l", 200, "same", "", 1)] * 4 + [(None, None, 200, "n", "", None), (None, None, 0, "", "t", None)]
    assert latest(spark, rows) == sorted([rows[1], rows[2], rows[6]], key=str)
    assert len(latest(spark, [("a", "k", 200, "y", "", 7), ("a", "k", 200, "z", "", 7)])) == 1


def test_tables_without_times_and_empty_tables(spark):
    assert latest(spark, [("a", "k", 200, "y"), ("a", "k", 404, "z")], "site string, request_key string, status int, body string") == [("a", "k", 200, "y")]
    assert latest(spark, []) == []


def test_bodies_are_not_in_the_reducing_shuffle(spark):
    path = tempfile.mkdtemp(prefix="leafcast-captures-", dir="/tmp") + "/t"
    spark.createDataFrame([("a", "k", 503, "x", "", 1), ("a", "k", 200, "new", "", 2)] + [("a", f"k{i}", 200, "b", "", 1) for i in range(50)], CAPTURE).write.parquet(path)
    got = cap.latest_per_key(spark.read.schema(CAPTURE).parquet(path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and got.count() == 51  # what has several captures was found before, without the bodies


def test_users_and_roots_of_the_last_capture(spark):
    users = [("a", 1, 200, '[{"id": 5, "name": "Old"}]', "", 1), ("a", 1, 200, '[{"id": 5, "name": "New"}]', "", 2), ("a", 2, 200, '[{"id": 6, "name": "X"}]', "", 1), ("a", 2, 500, "", "", 2)]
    got = cap.users_from_chunks(spark.createDataFrame(users, "site string, chunk bigint, status int, body string, error string, fetched_at bigint"))
    assert [(r.id, r.name) for r in got.collect()] == [(5, "New")]
    roots = [("https://e.org", "root", 200, '{"name": "Old"}', "", 1), ("https://e.org", "root", 200, '{"name": "New"}', "", 2)]
    names = cap.site_name(spark.createDataFrame(roots, schemas.ROOTS_CAPTURE))
    assert [tuple(r) for r in names.collect()] == [("https://e.org", "New")]


@pytest.mark.parametrize("body, error, post_id", [
    ('{"title": {"rendered": "T"}}', "", 0), ('{"other": 1}', "", 0), ("{}", "post_parse_failed", 9), ("null", "post_parse_failed", 9), ("[]", "post_parse_failed", 9),
    ('[{"id": 1}]', "post_parse_failed", 9), ('{"id": 1', "post_parse_failed", 9), ("", "post_parse_failed", 9), ("0", "post_parse_failed", 9), ('{"id": 4}', "", 4),
])
def test_what_a_full_post_needs(spark, body, error, post_id):
    r = cap.full_post(spark.createDataFrame([("s", "posts", 9, "k", "post", 200, body, "", 1)], schemas.POST_CAPTURE)).first()
    assert (r.error, r.id) == (error, post_id)


def post(key, status, text, at=1):
    body = '{"id": %d, "title": {"rendered": "T"}, "content": {"rendered": "%s"}}' % (len(key), text)
    return ("s", "posts", len(key), key, "post", status, body if status == 200 else "", "", at)


def test_recovering_and_reverting_documents(spark):
    """A, failed, A gives A again; a run over the same captures converts nothing; of two captures in a run the last counts."""
    root = tempfile.mkdtemp(prefix="leafcast-docs-", dir="/tmp")
    out = os.path.join(root, "out")

    def run(n, *captures):
        path = os.path.join(root, f"captures-{n}")
        spark.createDataFrame(list(captures), schemas.POST_CAPTURE).write.parquet(path)
        return jobs.documents_job(spark, path, out, OPTS, mode="raw", run_id=n)

    def now():
        return {r.request_key: (r.body, r.error) for r in docs.latest_documents(spark, out).collect()}

    other = post("other", 200, "stays")
    assert run(1, post("k", 200, "A"), other) == 2 and run(2, post("k", 200, "A"), other) == 0
    assert run(3, post("k", 500, "A"), other) == 1 and now()["k"] == (None, "post_fetch_failed")
    assert run(4, post("k", 200, "A"), other) == 1 and now()["k"] == ("A", None)
    assert run(5, post("k", 200, "C", 2), post("k", 200, "B", 1), other) == 1 and now()["k"] == ("C", None)
    assert run(6, post("k", 200, "A")) == 1 and now() == {"k": ("A", None), "other": ("stays", None)}
    versions = docs.document_versions(spark, out).where("request_key = 'k'").orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to) for r in versions] == [(1, 3), (3, 4), (4, 5), (5, 6), (6, None)]


TYPES = '{"post": {"slug": "post", "name": "Posts", "rest_base": "posts"}}'
HEADERS = "HTTP/1.1 200 OK\r\nX-WP-Total: 1\r\nX-WP-TotalPages: 1\r\n"


def write_captures(spark, folder, sites, title):
    spark.createDataFrame([(s, "types", "types", 503, "", "", 1) for s in sites] + [(s, "types", "types", 200, TYPES, "", 2) for s in sites], schemas.TYPES_CAPTURE).write.parquet(f"{folder}/types")
    page = '[{"id": 3, "title": {"rendered": "%s"}, "link": "%s/p", "date": "2024-02-03T04:05:06", "date_gmt": "2024-02-03T04:05:06", "author": 8}]'
    spark.createDataFrame([(s, "post|1", "collection", "post", 1, 200, HEADERS, page % (title, s), "", 1) for s in sites], schemas.COLLECTIONS_CAPTURE).write.parquet(f"{folder}/collections")
    spark.createDataFrame([(s, 0, "users|0", 200, '[{"id": 8, "name": "Ann", "description": ""}]', "", 1) for s in sites], schemas.USERS_CAPTURE).write.parquet(f"{folder}/users")
    roots = [(s, "root", 200, '{"name": "Old"}', "", 1) for s in sites] + [(s, "root", 200, '{"name": "Site"}', "", 2) for s in sites]
    spark.createDataFrame(roots, schemas.ROOTS_CAPTURE).write.parquet(f"{folder}/roots")


def test_runs_over_other_sites_leave_the_rest(spark):
    """A retried types response keeps its site, one name per site, and a run replaces its own sites alone."""
    root = tempfile.mkdtemp(prefix="leafcast-runs-", dir="/tmp")
    out, one, two = f"{root}/out", "https://one.org", "https://two.org"
    write_captures(spark, f"{root}/c1", [one, two], "First")
    paths = jobs.site_index_job(spark, f"{root}/c1", out, OPTS, run_id=1)
    assert jobs.read_index(spark, out, "errors").count() == 0
    files = {(p, os.path.getmtime(os.path.join(p, f))) for p, _, fs in os.walk(out) for f in fs if "two.org" in p}
    write_captures(spark, f"{root}/c2", [one], "Second")
    jobs.site_index_job(spark, f"{root}/c2", out, OPTS, run_id=2)
    assert files == {(p, os.path.getmtime(os.path.join(p, f))) for p, _, fs in os.walk(out) for f in fs if "two.org" in p}
    rows = {(r.site, r.title) for r in jobs.read_index(spark, out, "index_rows").collect()}
    assert rows == {(one, "Second"), (two, "First")}
    lines = jobs.read_index(spark, out, "index_lines").where(F.col("site") == one).orderBy(*report.LINE_ORDER).collect()
    assert [r.text for r in lines][:2] == ["# Site", "View original: https://one.org"]
    for name in jobs.INDEX_TABLES:  # the declared schemas are those of the files
        if name != "errors":
            found = spark.read.parquet(f"{out}/{name}").schema
            assert {f.name: f.dataType for f in found if f.name != "run_id"} == {f.name: f.dataType for f in jobs.read_index(spark, out, name).schema if f.name != "run_id"}, name
    # The text's files in order are the lines in order, and the offsets are places in that text.
    folder = next(p for p, _, fs in os.walk(f"{paths['index_text']}/run_id=2") if "one.org" in p)
    text = b"".join(open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert text.decode() == "".join(r.text + "\n" for r in lines)
    assert all(text[r.byte_offset:r.byte_offset + r.n_bytes].decode() == r.text + "\n" for r in lines)
    # A run that never wrote its manifest changes nothing.
    jobs._write_run(spark.createDataFrame([(one, "x")], "site string, title string"), f"{out}/index_rows", 3)
    assert {(r.site, r.title) for r in jobs.read_index(spark, out, "index_rows").collect()} == rows


def test_many_refetched_keys_are_dealt_once(spark, monkeypatch):
    """With more refetched keys than are joined as they stand: the same captures, by one shuffle of the bodies and no join."""
    path = tempfile.mkdtemp(prefix="leafcast-captures-", dir="/tmp") + "/t"
    rows = [(s, f"k{i % 40}", 200 if i % 3 else 503, f"b{i % 60}", "", i % 7) for i in range(200) for s in ("a", None)] + [("a", None, 200, "n", "", None)] * 3
    spark.createDataFrame(rows, CAPTURE).repartition(3).write.parquet(path)
    captures = spark.read.schema(CAPTURE).parquet(path)
    few = sorted((tuple(r) for r in cap.latest_per_key(captures).collect()), key=str)
    monkeypatch.setattr(cap, "REFETCHED_KEYS", 10)
    dealt = cap.latest_per_key(captures)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted((tuple(r) for r in dealt.collect()), key=str) == few and len(few) == 81


def test_captured_posts_are_made_in_one_pass(spark):
    """Repeated captures do not repeat the joins, and customers are joined before terms and fragments."""
    from conftest import SMALL
    from leafcast.sources import adapters

    made = adapters.full_posts_capture_v(spark, SMALL)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and "Union" not in plan
    by_time = {(r.fetched_at, r.n) for r in made.where("id = 143").groupBy("fetched_at").agg(F.count("*").alias("n")).collect()}
    assert by_time == {(1, 1), (2, 2)}
