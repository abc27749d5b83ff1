"""End-to-end jobs: captured tables in, index and document tables out (W2-W5 sinks).

Input folders hold parquet tables of captured responses (schemas in ``leafcast.schemas``):
``types`` (one type-map response per site), ``collections`` (collection pages keyed
``type_key|page``), ``users`` (user lookup chunks), ``roots`` (site roots, optional) and
``posts`` (single-post responses).
Outputs are parquet tables partitioned by run and site; a manifest written last tells which run a site's
results are from, so each site is replaced on its own and only by a run that finished.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafcast import schemas
from leafcast.operators import documents as docs
from leafcast.operators import html_jobs, report
from leafcast.options import Options
from leafcast.plans import site_index
from leafcast.session import materialize, path_exists, release
from leafcast.sources import captures as cap

TYPES_CAPTURE, ROOTS_CAPTURE = schemas.TYPES_CAPTURE, schemas.ROOTS_CAPTURE
COLLECTIONS_CAPTURE, USERS_CAPTURE = schemas.COLLECTIONS_CAPTURE, schemas.USERS_CAPTURE
#: Tables of a site index, each below its folder by run and site.
INDEX_TABLES = tuple(schemas.INDEX_TABLES)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _write_run(df: DataFrame, path: str, run_id: int, folders: tuple[str, ...] = ("run_id", "site")) -> None:
    """Rows below ``run_id=<run_id>/site=<site>``; a run that is repeated replaces what it wrote, other runs and sites stay."""
    (df.withColumn("run_id", F.lit(run_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path))


def write_index_text(lines: DataFrame, path: str) -> None:
    """W4 as text: a site's files, read in the order of their names, are its index line by line.

    Lines are dealt by ranges of site and place, so a large site has many files and no task more than its range.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("site", *report.LINE_ORDER)
    (lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("site", "text")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").text(path))


def site_index_job(spark: SparkSession, captures_dir: str, out_dir: str, opts: Options, run_id: int | None = None) -> dict[str, str]:
    """Entry A over captured tables; writes rows, summary, type report, errors, lines and text, then the run's manifest.

    The manifest names the sites that this run replaces. ``read_index`` follows it, so a run over some sites leaves the
    others as they are, and a run that fails before its end leaves everything as it was. ``run_id`` must grow (default: the time).
    """
    run_id = int(time.time() * 1000) if run_id is None else run_id
    base = captures_dir.rstrip("/")
    types = _read(spark, f"{base}/types", TYPES_CAPTURE)
    ci = site_index.from_captures(
        spark, types, _read(spark, f"{base}/collections", COLLECTIONS_CAPTURE),
        _read(spark, f"{base}/users", USERS_CAPTURE), opts,
    )
    out = out_dir.rstrip("/")
    paths = {name: f"{out}/{name}" for name in (*INDEX_TABLES, "index_text", "manifest")}
    for name, df in (("index_rows", ci.index.rows), ("type_summary", ci.index.summary), ("type_report", ci.types), ("errors", ci.errors)):
        # Clustered by site first, so a site is one file and not one per task.
        _write_run(df.repartition("site"), paths[name], run_id)
    roots = None
    if path_exists(spark, f"{base}/roots"):
        roots = cap.site_name(_read(spark, f"{base}/roots", ROOTS_CAPTURE))
    # Titles are for every site that was captured, also one whose types are all unreadable.
    lines = report.index_lines(report.site_names(types, roots), ci.index.authors, ci.index.summary, ci.index.rows,
                               unreadable=ci.types)
    placed = materialize(report.with_byte_offsets(materialize(lines, "index-lines")), "index-lines")
    _write_run(placed.repartitionByRange("site", *report.LINE_ORDER).sortWithinPartitions("site", *report.LINE_ORDER), paths["index_lines"], run_id)
    write_index_text(placed, f"{paths['index_text']}/run_id={run_id}")
    _write_run(types.select("site").distinct().coalesce(1), paths["manifest"], run_id, ("run_id",))
    release(spark)
    return paths


def read_index(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table of ``INDEX_TABLES`` as it is now: each site's rows of the last run that finished and had the site."""
    out = out_dir.rstrip("/")
    last = spark.read.schema("run_id bigint, site string").parquet(f"{out}/manifest").groupBy("site").agg(F.max("run_id").alias("run_id"))
    # The schema is declared, as a table without rows has no file to tell it.
    return spark.read.schema(schemas.INDEX_TABLES[name]).parquet(f"{out}/{name}").join(last, ["site", "run_id"])


def documents_job(spark: SparkSession, posts_dir: str, out_dir: str, opts: Options, mode: str = "markdown",
                  run_id: int | None = None, partitions: int | None = None) -> int:
    """Entry B, incremental: converts posts whose source changed and appends them (W2 sink).

    Captures are spread by their bytes over ``partitions`` (``html_jobs.spread``); 0 keeps the splits of the input.

    Returns the number of documents written by this run (0 when nothing changed).
    """
    run_id = int(time.time() * 1000) if run_id is None else run_id
    captures = html_jobs.spread(_read(spark, posts_dir, schemas.POST_CAPTURE), F.octet_length("body"), partitions)
    posts = cap.full_post(cap.latest_per_key(captures))
    todo = docs.incremental_documents(spark, posts, out_dir, opts, mode, run_id=run_id)
    todo.repartition("site", F.pmod(F.xxhash64("request_key"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))) \
        .write.mode("append").partitionBy("site", "run_id").parquet(out_dir)
    if not path_exists(spark, out_dir):
        return 0
    return spark.read.parquet(out_dir).where(F.col("run_id") == run_id).count()
