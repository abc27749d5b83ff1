"""W4 + W5: the site index as ordered text lines, one row per line.

A site's index is never gathered into one row or one task: every line carries its
``(site, kind, section, pos, detail)`` sort key, so a writer can emit it sorted (for example
``sortWithinPartitions`` after partitioning by site) and a reader can page through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafcast.functions import urls
from leafcast.operators.numbering import running_sum

# Section headings of the text layout.
AUTHORS_HEADING = "## Authors"
UNREADABLE_HEADING = "## Post types that could not be read"
#: Kinds of lines in the order of the text.
HEAD, AUTHORS, TYPES, UNREADABLE = range(4)


#: Sort key of a site's lines.
LINE_ORDER = ("kind", "section", "pos", "detail")


def with_byte_offsets(lines: DataFrame) -> DataFrame:
    """Lines with their place in the site's text: ``byte_offset``, and ``n_bytes`` with the line feed.

    Offsets are sums over tasks first, so a site may have any number of lines. ``lines`` is to be a written result.
    """
    sized = lines.withColumn("n_bytes", (F.octet_length("text") + 1).cast("bigint"))
    return running_sum(sized, ["site"], LINE_ORDER, "n_bytes", "byte_offset")


def _line(df: DataFrame, kind: int, section, pos, text, detail: int = 0) -> DataFrame:
    """``section`` tells types apart, ``pos`` entries, ``detail`` the lines of an entry."""
    sec = F.lit(section) if isinstance(section, int) else section
    return df.select(
        "site", F.lit(kind).cast("long").alias("kind"), sec.cast("long").alias("section"), pos.cast("long").alias("pos"),
        F.lit(detail).cast("long").alias("detail"), text.alias("text"),
    )


def site_names(sites: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Site name per site: from S5 results when given, else the host of the site URL."""
    s = sites.select("site").distinct()
    if names is not None:
        s = s.join(names.select("site", F.col("site_name").alias("_n")), "site", "left")
        return s.select("site", F.coalesce("_n", urls.url_host(F.col("site"))).alias("site_name"))
    return s.select("site", urls.url_host(F.col("site")).alias("site_name"))


def index_lines(names: DataFrame, authors: DataFrame, summary: DataFrame, rows: DataFrame,
                unreadable: DataFrame | None = None, agent: bool = False, mirror: str = "") -> DataFrame:
    """Lines of each site's index: title, original URL, authors, one section per type, unreadable types.

    Below each entry come its post id, date, author and permalink. ``agent``: the variant for
    agents, with the absolute Markdown URL under ``mirror`` (build ``rows`` with ``agent`` too).
    Unreadable types keep the order of the types response.
    """
    parts = [
        _line(names, HEAD, 0, F.lit(0), F.concat(F.lit("# "), F.col("site_name"))),
        _line(names, HEAD, 0, F.lit(1), F.concat(F.lit("View original: "), urls.prettify_url(urls.normalize_url(F.col("site"))))),
        _line(authors.select("site").distinct(), AUTHORS, 0, F.lit(0), F.lit(AUTHORS_HEADING)),
        _line(authors, AUTHORS, 0, F.col("rank"), F.concat(F.lit("### "), F.col("name"))),
        _line(authors.where(F.col("description") != ""), AUTHORS, 0, F.col("rank"), F.col("description"), 1),
    ]
    sec = F.col("type_pos")
    parts.append(_line(summary, TYPES, sec, F.lit(0), F.concat(F.lit("## ["), F.col("slug"), F.lit("] "), F.col("type_name"))))
    parts.append(_line(summary.where(F.col("note") != ""), TYPES, sec, F.lit(0), F.col("note"), 1))
    r = rows.join(summary.select(F.col("site").alias("_s"), F.col("type_key").alias("_t"), "type_pos"),
                  (F.col("site") == F.col("_s")) & (F.col("type_key") == F.col("_t")), "inner")
    # An entry and its details are one row turned into lines, so the rows are read once.
    entry = F.array(
        F.concat(F.lit("- "), F.col("line")),
        F.concat(F.lit("  - Post ID: "), F.col("id").cast("string")),
        F.concat(F.lit("  - Date: "), F.coalesce("date", F.lit(""))),
        F.when(F.col("author_name") != "", F.concat(F.lit("  - Author: "), F.col("author_name"))),
        F.when(F.lit(agent), F.concat(F.lit("  - Markdown: "), F.lit(mirror.rstrip("/") + "/"), F.col("href"))),
        F.concat(F.lit("  - Permalink: "), F.col("permalink")),
    )
    lines = r.select("site", "type_pos", "rank", F.posexplode(entry).alias("detail", "text")).where("text IS NOT NULL")
    parts.append(lines.select(
        "site", F.lit(TYPES).cast("long").alias("kind"), sec.cast("long").alias("section"), F.col("rank").cast("long").alias("pos"),
        F.col("detail").cast("long").alias("detail"), "text",
    ))
    if unreadable is not None:
        u = unreadable.where(F.col("class") == "unreadable")
        parts.append(_line(u.select("site").distinct(), UNREADABLE, 0, F.lit(0), F.lit(UNREADABLE_HEADING)))
        parts.append(_line(u, UNREADABLE, 0, F.col("type_pos") + 1, F.concat(F.lit("- ["), F.col("type_key"), F.lit("] "), F.col("name"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
