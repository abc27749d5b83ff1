"""HTML corpus jobs (H1-H9 slim, M1-M14 Markdown) as DataFrame -> DataFrame functions.

The slim job is column expressions only (``slim``). The Markdown job is native column passes
around one Arrow batch pass (``mapInArrow``) holding the per-document rendering of ``htmltree``. The JVM -> Python
boundary is crossed once per partition; rows that fail to convert keep their key and
carry an ``error`` text instead of failing the job. Before either pass rows are spread by
their bytes (``spread``) so every task gets an even share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafcast.functions import arrays, text, urls
from leafcast.operators import slim as slimming
from leafcast.operators.numbering import ROW_BITS
from leafcast.options import Options
from leafcast.session import bound_batches

# Document wrapper tags removed as text before parsing (H2), and the
# Markdown link targets that get a readable form (C9): '](' + http(s) URL + first ')'.
WRAPPER_TAGS = r"(?i)</?(?:html|body)\b[^>]*>"
LINK_TOKENS = r"\]\(https?://[^\n]+?\)|\]|[^\]]+"


def strip_wrappers(html: Column) -> Column:
    """H2: remove <html>/<body> start and end tags so every body's content survives."""
    return F.regexp_replace(html, WRAPPER_TAGS, "")


def prettify_link_targets(md: Column) -> Column:
    """Every Markdown link target ``](http...)`` shown decoded, with a Unicode host."""
    tokens = F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(LINK_TOKENS), 0)
    pretty = F.transform(
        tokens,
        lambda t: F.when(
            t.startswith("]("),
            F.concat(F.lit("]("), urls.prettify_url(t.substr(F.lit(3), F.length(t) - 3)), F.lit(")")),
        ).otherwise(t),
    )
    return F.when(md.isNotNull(), F.array_join(pretty, ""))


def spread(df: DataFrame, size: Column, partitions: int | None = None) -> DataFrame:
    """Rows dealt to an explicit number of partitions in ranges of about equal bytes, before work that costs by the byte.

    One large row group, or a small upstream result that adaptive execution would coalesce, must not become a single
    task, nor some long documents one task's share. Sizes are added up over the rows as the input has them; what the driver
    gets is the first row of each range. Rows whose tasks are even already stay where they are: none has more than
    one and a half times a core's share of the bytes. ``df`` is to be a table or a written result. ``size`` is a row's bytes. ``partitions`` is ``spark.sql.shuffle.partitions`` by
    default; 0 keeps the input as it is, right for inputs of many splits, and a stream is dealt by hash.
    """
    if partitions == 0:
        return df
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.isStreaming:
        return df.repartition(n, F.xxhash64(*df.columns))
    # The number of a row tells its task and place; a scan gives the same ones again.
    sized = df.select(F.monotonically_increasing_id().alias("at"), (F.coalesce(size, F.lit(0)) + 1).cast("bigint").alias("n")).withColumn("task", F.shiftright("at", ROW_BITS))
    inside = Window.partitionBy("task").orderBy("at")
    tasks = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    totals = sized.groupBy("task").agg(F.sum("n").alias("all"))
    largest, whole = totals.agg(F.max("all"), F.sum("all")).first()
    if largest is None or largest * min(n, df.sparkSession.sparkContext.defaultParallelism) <= 1.5 * whole:
        return df
    starts = totals.select("task", F.coalesce(F.sum("all").over(tasks), F.lit(0)).alias("before"), F.sum("all").over(Window.partitionBy()).alias("whole"))
    placed = sized.withColumn("to", F.sum("n").over(inside)).join(starts, "task")
    part = F.floor((F.col("before") + F.col("to") - F.col("n")) * F.lit(n) / F.col("whole"))
    firsts = sorted(r[0] for r in placed.groupBy(part.alias("part")).agg(F.min("at").alias("first")).select("first").collect())  # n rows at most
    if len(firsts) < 2:
        return df
    edges = F.array(*(F.lit(f).cast("bigint") for f in firsts))
    number = arrays.bound(F.monotonically_increasing_id(), lambda at: arrays.n_below(edges, at + 1) - 1)  # one number per row
    return df.withColumn("_part", F.least(F.greatest(number, F.lit(0)), F.lit(n - 1)).cast("int")).repartitionById(n, F.col("_part")).drop("_part")


def _arrow_job(df: DataFrame, keys: Sequence[str], source: str, fn: Callable[[str], str], partitions: int | None) -> DataFrame:
    key_fields = [df.schema[k] for k in keys]
    out_schema = StructType(key_fields + [StructField("out", StringType()), StructField("error", StringType())])
    df = spread(df.select(*keys, F.col(source).alias("_src")), F.octet_length("_src"), partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs, errs = [], []
            for doc in b.column(b.schema.get_field_index("_src")).to_pylist():
                try:
                    outs.append(fn(doc))
                    errs.append(None)
                except Exception as e:  # one bad document must not fail the partition
                    outs.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(outs, pa.string()), pa.array(errs, pa.string())],
                                             names=list(keys) + ["out", "error"])

    return bound_batches(df).mapInArrow(run, out_schema)


def slim_job(df: DataFrame, keys: Sequence[str], html_col: str, opts: Options, partitions: int | None = None) -> DataFrame:
    """H1: slim every document (H2, then H3-H9) with column expressions; blank and NULL input is returned as is.

    Returns keys and ``slim``. Documents are spread first as for the Markdown job; with
    ``partitions=0``, right for inputs of many splits, there is no shuffle.
    """
    spread_rows = spread(df.select(*keys, html_col), F.octet_length(html_col), partitions)
    prepared = spread_rows.select(*keys, strip_wrappers(F.col(html_col)).alias("_html"), F.col(html_col).alias("_src"))
    slim = F.when(text.php_trim(F.col("_src")) == "", F.col("_src")).otherwise(
        slimming.slim(F.col("_html"), tuple(opts.keep_attrs), tuple(opts.drop_tags), tuple(opts.unwrap_tags))
    )
    return prepared.select(*keys, slim.alias("slim"))


def markdown_job(df: DataFrame, keys: Sequence[str], html_col: str, title_col: str, opts: Options,
                 partitions: int | None = None) -> DataFrame:
    """M1: C4 -> C8 -> tree render -> C9 -> '# title' + body -> C5.

    ``title_col`` holds the raw title (C3 is applied here). Returns keys, ``title``,
    ``markdown`` and ``error``. A NULL document is skipped (NULL markdown, no error).
    """
    from leafcast.operators.htmltree import markdown

    form = opts.form_mode
    pre = df.select(
        *keys, text.title_flat(F.col(title_col)).alias("title"),
        text.icon_replace(text.lf_normalize(F.col(html_col))).alias("_html"),
    )
    rendered = _arrow_job(pre, list(keys) + ["title"], "_html", lambda h: markdown(h, form), partitions)
    body = prettify_link_targets(F.col("out"))
    doc = text.collapse_blank_lines(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), body))
    ok = F.col("error").isNull() & F.col("out").isNotNull()
    return rendered.select(*keys, "title", F.when(ok, doc).alias("markdown"), "error")
