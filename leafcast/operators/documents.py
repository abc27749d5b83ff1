"""Per-post documents (Markdown with front matter, slim HTML, raw)."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafcast.functions import dates, text, yaml
from leafcast.functions import terms as fterms
from leafcast.operators import html_jobs
from leafcast.options import Options
from leafcast.session import path_exists

DOC_KEYS = ["site", "request_key", "rest_base", "id"]
# Fixed value: head of the HTML document mode.
HTML_HEAD = '<html><head><meta charset="UTF-8"><meta name="robots" content="noindex, nofollow">'


def front_matter(post_id: Column, date_gmt: Column, title: Column, terms: Column, author_name: Column,
                 link: Column, opts: Options, api_url: Column | None = None) -> Column:
    """YAML front matter block ('---' fences, then a blank line)."""
    groups = fterms.terms_by_taxonomy(terms)
    tax_lines = F.array_join(
        F.transform(groups, lambda g: F.concat(g["taxonomy"], F.lit(": "), yaml.yaml_list(g["names"]))), "\n"
    )
    author = F.coalesce(author_name, F.lit(""))
    lines = [
        F.lit("---"),
        F.concat(F.lit("post_id: "), yaml.yaml_int(F.coalesce(post_id, F.lit(0)))),
        F.concat(F.lit("date: "), yaml.yaml_scalar(dates.format_datetime(date_gmt, opts.zone))),
        F.concat(F.lit("title: "), yaml.yaml_scalar(title)),
        F.when(F.size(groups) > 0, tax_lines),
        F.when(author != "", F.concat(F.lit("author: "), yaml.yaml_scalar(author))),
        F.concat(F.lit("permalink: "), yaml.yaml_scalar(F.coalesce(link, F.lit("")))),
    ]
    if opts.show_api_endpoint and api_url is not None:
        lines.append(F.concat(F.lit("api_endpoint: "), yaml.yaml_scalar(api_url)))
    lines.append(F.lit("---"))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def source_hash(posts: DataFrame, mode: str, opts: Options) -> Column:
    """Hash of everything a document is made from, options included (drives incremental runs)."""
    cols = [c for c in ("request_key", "title_raw", "content", "link", "date_gmt", "author_name", "error")
            if c in posts.columns]
    options = (opts.zone, opts.form_mode, opts.keep_attrs, opts.drop_tags, opts.unwrap_tags, opts.show_api_endpoint)
    parts = [F.lit(mode), F.lit(repr(options))] + [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    parts.append(F.coalesce(F.to_json(F.col("terms")), F.lit("")))
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def build_documents(posts: DataFrame, opts: Options, mode: str = "markdown", partitions: int | None = 0) -> DataFrame:
    """Entry B for a corpus of full posts (``leafcast.sources.captures.full_post`` shape).

    Output: site, request_key, rest_base, id, mode, title, body, error, src_hash. One pass over the
    input: rows whose fetch or parse failed go through the same plan with no content
    (the tree pass skips them) and keep their error; converter failures are errors too. Posts stay in
    the partitions they are in: spread the captures by bytes before they are parsed (``html_jobs.spread``), or name ``partitions``.
    """
    return _documents(posts.withColumn("src_hash", source_hash(posts, mode, opts)), opts, mode, partitions)


def _documents(hashed: DataFrame, opts: Options, mode: str, partitions: int | None = 0) -> DataFrame:
    """The documents of posts that have their ``src_hash``."""
    upstream = F.nullif(F.coalesce(F.col("error"), F.lit("")), F.lit(""))
    src = hashed.withColumn("_up_err", upstream)
    content = F.when(F.col("_up_err").isNull(), text.lf_normalize(F.coalesce(F.col("content"), F.lit(""))))
    title = text.title_flat(F.col("title_raw"))
    if mode == "raw":
        out = src.select(*DOC_KEYS, "src_hash", "_up_err", title.alias("title"),
                         text.collapse_blank_lines(content).alias("body"), F.lit(None).cast("string").alias("_job_err"))
    elif mode == "html":
        prepared = src.select(*DOC_KEYS, "src_hash", "_up_err", title.alias("title"), text.collapse_blank_lines(content).alias("_c"))
        slimmed = html_jobs.slim_job(prepared, DOC_KEYS + ["src_hash", "_up_err", "title"], "_c", opts, partitions)
        esc = text.html_escape(F.col("title"))
        body = F.concat(F.lit(HTML_HEAD), F.lit("<title>"), esc, F.lit("</title></head><body><h1>"), esc, F.lit("</h1>"),
                        F.coalesce(F.col("slim"), F.lit("")), F.lit("</body></html>"))
        out = slimmed.select(*DOC_KEYS, "src_hash", "_up_err", "title", body.alias("body"), F.lit(None).cast("string").alias("_job_err"))
    else:
        meta = src.select(*DOC_KEYS, "src_hash", "_up_err", "title_raw", content.alias("_c"), "date_gmt", "terms",
                          "author_name", "link")
        md = html_jobs.markdown_job(meta, DOC_KEYS + ["src_hash", "_up_err", "date_gmt", "terms", "author_name", "link"],
                                    "_c", "title_raw", opts, partitions)
        fm = front_matter(F.col("id"), F.col("date_gmt"), F.col("title"), F.col("terms"), F.col("author_name"),
                          F.col("link"), opts, F.concat(F.col("site"), F.lit("/wp-json/wp/v2/"), F.col("rest_base"), F.lit("/"),
                                                        F.col("id").cast("string"), F.lit("?_embed=author,wp:term")))
        out = md.select(*DOC_KEYS, "src_hash", "_up_err", "title", F.concat(fm, F.col("markdown")).alias("body"),
                        F.col("error").alias("_job_err"))
    err = F.coalesce(F.col("_up_err"), F.col("_job_err"))
    return out.select(*DOC_KEYS, F.lit(mode).alias("mode"), "title", F.when(err.isNull(), F.col("body")).alias("body"),
                      err.alias("error"), "src_hash")


VERSION_KEYS = ("site", "request_key")


def document_versions(spark, out_path: str) -> DataFrame:
    """Versions of each key: site, request_key, src_hash, error, valid_from and valid_to (run ids; null: current).

    A run appends a row only where the source differs from the key's current version, so each row is a version. Only
    these narrow columns of the history are read.
    """
    digest = F.unhex("src_hash").alias("_hash")  # moved and sorted as bytes: the order of its lower-case hex digits
    rows = spark.read.parquet(out_path).select(*VERSION_KEYS, digest, "error", F.col("run_id").cast("bigint").alias("valid_from"))
    w = Window.partitionBy(*VERSION_KEYS).orderBy("valid_from", "_hash")
    return rows.withColumn("valid_to", F.lead("valid_from").over(w)).select(
        *VERSION_KEYS, F.lower(F.hex("_hash")).alias("src_hash"), "error", "valid_from", "valid_to",
    )


def incremental_documents(spark, posts: DataFrame, out_path: str, opts: Options, mode: str = "markdown",
                          run_id: int | None = None) -> DataFrame:
    """Documents of the posts whose source hash is not that of their key's current version (a left anti join).

    So a source that fails and recovers, or changes and goes back, is a new version each time. The caller appends the
    result to ``out_path``; a run over unchanged input and options converts nothing. ``posts`` holds one row per
    key (``sources.captures.latest_per_key``); ``run_id`` must grow from run to run (default: the time).
    """
    run_id = int(time.time() * 1000) if run_id is None else run_id
    todo = posts.withColumn("src_hash", source_hash(posts, mode, opts))
    if path_exists(spark, out_path):
        rows = spark.read.parquet(out_path).select(*VERSION_KEYS, "src_hash", "run_id")
        # Keys without nulls on both sides, so what is grouped by key is joined where it is; digests are moved as bytes.
        keys = {f"_d_{k}": F.coalesce(k, F.lit("")) for k in VERSION_KEYS} | {f"_n_{k}": F.col(k).isNull() for k in VERSION_KEYS}
        digest = F.unhex("src_hash").alias("_hash")
        current = rows.groupBy(*(c.alias("_c" + k) for k, c in keys.items())).agg(F.max(F.struct("run_id", digest)).alias("_last"))
        # The hash is made before the join, which then carries only what the mode's documents are made from.
        asked = todo.select(*(c for c in todo.columns if c not in (*VERSION_KEYS, "src_hash")), *(c.alias(k) for k, c in keys.items()), digest)
        # Equal digests, not written as an equality: as a key of the join it would have the current versions shuffled again.
        same = (F.col("_hash") <= F.col("_last._hash")) & (F.col("_hash") >= F.col("_last._hash"))
        for k in keys:
            same = same & (F.col(k) == F.col("_c" + k))
        restored = {k: F.when(~F.col(f"_n_{k}"), F.col(f"_d_{k}")) for k in VERSION_KEYS} | {"src_hash": F.lower(F.hex("_hash"))}
        todo = asked.join(current, same, "left_anti").select(*(restored[c].alias(c) if c in restored else c for c in todo.columns))
    return _documents(todo, opts, mode).withColumn("run_id", F.lit(run_id).cast("bigint"))


def latest_documents(spark, out_path: str) -> DataFrame:
    """Current version of each request key of a site; failed fetches have keys of their own like any other.

    The superseded versions, known from narrow columns alone, are taken out by an anti join.
    """
    docs = spark.read.parquet(out_path)
    old = document_versions(spark, out_path).where("valid_to IS NOT NULL")
    old = old.select(*(F.col(k).alias("_o_" + k) for k in VERSION_KEYS), F.col("valid_from").alias("_o_run"))
    gone = F.col("run_id") == F.col("_o_run")
    for k in VERSION_KEYS:
        gone = gone & F.col(k).eqNullSafe(F.col("_o_" + k))
    return docs.join(old, gone, "left_anti")
