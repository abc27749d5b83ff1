"""Captured HTTP responses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafcast.functions.text import TRIM_CHARS, php_trim


def header_entries(raw: Column) -> Column:
    """Raw header block -> array<struct<name,value>>, last duplicate name kept (in its place).

    Lines are split on CRLF after trimming the block; only lines with ':' count; the
    first ':' separates name and value; names are lower-cased; both sides trimmed.
    """
    lines = F.split(F.btrim(F.coalesce(raw, F.lit("")), F.lit(TRIM_CHARS)), "\r\n")
    with_colon = F.filter(lines, lambda l: F.instr(l, ":") > 0)
    entries = F.transform(
        with_colon,
        lambda l: F.struct(
            F.lower(php_trim(F.substring_index(l, ":", 1))).alias("name"),
            php_trim(F.substr(l, F.instr(l, ":") + 1)).alias("value"),
        ),
    )
    # One pass from the end: a name seen already is dropped, so the block is parsed once.
    kept = F.aggregate(
        F.reverse(entries), F.array().cast("array<struct<name:string,value:string>>"),
        lambda acc, e: F.when(F.exists(acc, lambda o: o["name"] == e["name"]), acc).otherwise(F.array_append(acc, e)),
    )
    return F.reverse(kept)


def header_map(raw: Column) -> Column:
    """map<lower-cased name, value>."""
    return F.map_from_entries(header_entries(raw))


MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1


def header_int(text: Column) -> Column:
    """Leading integer of a header value, 0 without one, held within 64 bits."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1)
    wide = digits.try_cast("decimal(38,0)")
    held = F.least(F.greatest(wide, F.lit(MIN_LONG)), F.lit(MAX_LONG)).cast("bigint")
    beyond = F.when(F.startswith(digits, F.lit("-")), F.lit(MIN_LONG)).otherwise(F.lit(MAX_LONG))
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(held, beyond))


def is_success(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 300), F.lit(False))


def outcome_error(status: Column, transport_error: Column) -> Column:
    """S7: '' on success, 'HTTP <status>' on a non-2xx answer, the transport error on status 0."""
    return (
        F.when(is_success(status), F.lit(""))
        .when(F.coalesce(status, F.lit(0)) == 0, F.coalesce(transport_error, F.lit("")))
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
    )


def outcome_body(status: Column, body: Column) -> Column:
    """The body only for a successful response."""
    return F.when(is_success(status), body)
