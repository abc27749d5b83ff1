"""Post-type operators: S1 type map, F1-F4 filters, F10 readability, G2 totals, G3/J4 summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafcast import schemas
from leafcast.functions import http, rules
from leafcast.options import Options

TYPE_MAP_SCHEMA = schemas.TYPE_MAP_JSON

# Fixed value: the truncation note (the English message of the reference).
SHOWING_LATEST = "Showing the latest %d of %d items."


def parse_type_map(captures: DataFrame) -> DataFrame:
    """A captured types response (JSON object keyed by type) -> one row per type.

    ``type_pos`` keeps the object's key order (the order sections are shown in). A failed
    response has no types, whatever its body says.
    """
    ok = http.outcome_body(F.coalesce(F.col("status"), F.lit(0)), F.col("body"))
    parsed = captures.select("site", F.from_json(ok, TYPE_MAP_SCHEMA).alias("m"))
    return parsed.select(
        "site", F.posexplode(F.map_entries(F.coalesce("m", F.create_map().cast(TYPE_MAP_SCHEMA)))).alias("type_pos", "e")
    ).select(
        "site", "type_pos", F.col("e.key").alias("type_key"), F.col("e.value.slug").alias("slug"),
        F.col("e.value.name").alias("name"), F.col("e.value.rest_base").alias("rest_base"),
    )


def type_map_errors(captures: DataFrame) -> DataFrame:
    """Fatal types responses as rows (site, type_key NULL, error): a failed fetch, or a body that is no JSON object."""
    st = F.coalesce(F.col("status"), F.lit(0))
    no_map = F.from_json("body", TYPE_MAP_SCHEMA).isNull()
    error = (
        F.when(~http.is_success(st), http.outcome_error(st, F.col("error") if "error" in captures.columns else F.lit("")))
        .when(no_map, F.lit("not a JSON object"))
    )
    return captures.select("site", F.lit(None).cast("string").alias("type_key"), F.concat(F.lit("types: "), error).alias("error")).where(
        "error IS NOT NULL"
    )


def filter_types(types: DataFrame, opts: Options) -> DataFrame:
    """Drop types without slug, with a slug or name matching a rule, or without rest_base."""
    slug_rules = rules.compile_rules(opts.exclude_type_slugs)
    name_rules = rules.compile_rules(opts.exclude_type_names)
    return types.where(
        F.col("slug").isNotNull()
        & ~rules.matches_any(F.col("slug"), slug_rules)
        & ~rules.matches_any(F.coalesce(F.col("name"), F.lit("")), name_rules)
        & F.col("rest_base").isNotNull()
    )


def with_type_pos(types: DataFrame) -> DataFrame:
    """Section order for types that carry no map position: by type key within a site."""
    w = Window.partitionBy("site").orderBy("type_key")
    return types.withColumn("type_pos", F.row_number().over(w) - 1)


def type_readability(first_pages: DataFrame) -> DataFrame:
    """classify each type's first-page capture: readable / unreadable (401, 404) / fatal.

    ``first_pages`` has ``site, type_key, name, status, error`` (and ``type_pos``, kept if
    there). Unreadable types are listed by name (the key when the name is missing); fatal
    rows carry an error text.
    """
    kept = ["type_pos"] if "type_pos" in first_pages.columns else []
    st = F.coalesce(F.col("status"), F.lit(0))
    cls = (
        F.when(http.is_success(st), F.lit("readable"))
        .when(st.isin(401, 404), F.lit("unreadable"))
        .otherwise(F.lit("fatal"))
    )
    return first_pages.select(
        "site", *kept, "type_key", F.coalesce("name", "type_key").alias("name"), st.alias("status"), cls.alias("class"),
        F.when(cls == "fatal", F.concat(F.lit("slug: "), F.col("type_key"),
                                        F.when(http.outcome_error(st, F.col("error")) != "",
                                               F.concat(F.lit(", "), http.outcome_error(st, F.col("error"))))
                                        .otherwise(F.lit("")))).otherwise(F.lit("")).alias("error"),
    )


def type_totals(first_pages: DataFrame, opts: Options) -> DataFrame:
    """Totals from the first page's headers (junk -> 0; missing pages header -> 1) and page plan."""
    h = http.header_map(F.col("headers_raw"))
    total = http.header_int(F.try_element_at(h, F.lit("x-wp-total")))
    pages_text = F.try_element_at(h, F.lit("x-wp-totalpages"))
    pages = F.when(pages_text.isNull(), F.lit(1).cast("bigint")).otherwise(http.header_int(pages_text))
    return first_pages.select(
        "site", "type_key", total.alias("total_found"), pages.alias("total_pages"),
        (pages > F.lit(int(opts.max_pages_per_type))).alias("truncated"),
    )


def type_summary(types: DataFrame, totals: DataFrame, listed: DataFrame) -> DataFrame:
    """G3 + J4: per type, its listed count (after exclusions) and the truncation note.

    Types with no listed post keep their section (left join from the types).
    """
    counts = listed.groupBy("site", "type_key").agg(F.count(F.lit(1)).alias("listed"))
    j = types.join(totals, ["site", "type_key"], "left").join(counts, ["site", "type_key"], "left")
    listed_n = F.coalesce(F.col("listed"), F.lit(0)).cast("long")
    note = F.when(F.col("truncated"), F.format_string(SHOWING_LATEST, listed_n, F.col("total_found"))).otherwise(F.lit(""))
    return j.select(
        "site", "type_pos", "type_key", "slug", F.col("name").alias("type_name"), "total_found", "total_pages", "truncated",
        listed_n.alias("listed"), note.alias("note"),
    )
