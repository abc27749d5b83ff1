"""End-to-end jobs over captured tables written to disk (the sinks of W2-W5)."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from leafcast.options import ADAPTER_OPTIONS
from leafcast.plans import jobs
from leafcast.sources import adapters


def test_site_index_and_documents_jobs(spark):
    root = tempfile.mkdtemp(prefix="leafcast-jobs-", dir="/tmp")
    cap_dir, out_dir = os.path.join(root, "captures"), os.path.join(root, "out")
    adapters.types_capture_v(spark, SMALL).write.parquet(f"{cap_dir}/types")
    adapters.collections_v(spark, SMALL).write.parquet(f"{cap_dir}/collections")
    adapters.user_chunks_v(spark, SMALL).write.parquet(f"{cap_dir}/users")
    spark.createDataFrame([(adapters.SITE, "root", 200, '{"name": "Example"}', "", 1)], jobs.ROOTS_CAPTURE).write.parquet(f"{cap_dir}/roots")
    adapters.full_posts_capture_v(spark, SMALL).write.parquet(f"{cap_dir}/posts")

    paths = jobs.site_index_job(spark, cap_dir, f"{out_dir}/index", ADAPTER_OPTIONS)
    lines = spark.read.parquet(paths["index_lines"]).orderBy("site", "kind", "section", "pos", "detail").collect()
    by_site = {s: [r.text for r in lines if r.site == s] for s in adapters.CAPTURED_SITES}
    assert [by_site[s][0] for s in adapters.CAPTURED_SITES] == [
        "# Example", "# two.example.com", "# three.example.com", "# four.example.com", "# five.example.com"]
    entry = by_site[adapters.SITE].index(next(t for t in by_site[adapters.SITE] if t.startswith("- [Order ")))
    assert [t.split(":")[0] for t in by_site[adapters.SITE][entry + 1:entry + 3]] == ["  - Post ID", "  - Date"]
    assert by_site[adapters.SECOND_SITE][-2:] == ["## Post types that could not be read", "- [1-URGENT] 1-URGENT"]
    errors = {(r.site, r.type_key) for r in spark.read.parquet(paths["errors"]).collect()}
    assert errors == {(adapters.SITE, "5-LOW"), (adapters.SECOND_SITE, "3-MEDIUM"), (adapters.THIRD_SITE, None), (adapters.FIFTH_SITE, None)}
    listed = spark.read.parquet(paths["index_rows"]).groupBy("site").count().collect()
    assert {r.site for r in listed} == {adapters.SITE, adapters.SECOND_SITE, adapters.FOURTH_SITE} and all(r["count"] > 0 for r in listed)

    docs_dir = f"{out_dir}/documents"
    first = jobs.documents_job(spark, f"{cap_dir}/posts", docs_dir, ADAPTER_OPTIONS, run_id=1)
    second = jobs.documents_job(spark, f"{cap_dir}/posts", docs_dir, ADAPTER_OPTIONS, run_id=2)
    assert first == 1500 and second == 0
    assert spark.read.parquet(docs_dir).where(F.col("error").isNull() & F.col("body").startswith("---\n")).count() > 40
