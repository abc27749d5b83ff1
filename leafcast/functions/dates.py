"""date_gmt (UTC wall time text) shown in a target zone with its offset."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date_gmt layouts (yyyy-MM-dd, then optionally T or a space and HH:mm,
# HH:mm:ss or HH:mm:ss.fraction, then optionally Z or an offset), and the zone used when none
# or an invalid one is set.
GMT_PATTERN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
OFFSET_PATTERN = r"([+-])(\d{2}):?(\d{2})$"
DEFAULT_ZONE = "UTC"
# Short ids the JVM accepts as zone names (java.time.ZoneId.SHORT_IDS keys).
JVM_SHORT_IDS = frozenset(
    "ACT AET AGT ART AST BET BST CAT CNT CST CTT EAT ECT EST HST IET IST JST MIT MST NET NST "
    "PLT PNT PRT PST SST VST".split()
)
_OFFSET = re.compile(r"^(?:UTC|GMT)?[+-](?:\d{1,2}|\d{2}:?\d{2})$")


def resolve_zone(zone: str | None) -> str:
    """Validate a zone option once on the driver; invalid or missing -> the default zone."""
    if not zone:
        return DEFAULT_ZONE
    z = zone.strip()
    if _OFFSET.match(z) or z in JVM_SHORT_IDS:
        return z
    try:
        ZoneInfo(z)
        return z
    except Exception:
        return DEFAULT_ZONE


def parse_gmt(gmt: Column) -> Column:
    """date_gmt text -> TIMESTAMP_NTZ (NULL when blank or unparseable).

    Zone-free: the text is checked against the accepted layouts once and the fields are
    read at fixed positions and rebuilt as a wall time, so neither the session time zone
    (a DST gap would shift the value) nor the session's ANSI setting (invalid dates such
    as Feb 30 give NULL) changes the result.
    """
    field = lambda start, n: F.substring(gmt, start, n).try_cast("int")
    timed, seconds = F.length(gmt) > 10, F.substring(gmt, 17, 1) == ":"
    zero = F.lit(0)
    wall = F.try_make_timestamp_ntz(
        field(1, 4), field(6, 2), field(9, 2),
        F.when(timed, field(12, 2)).otherwise(zero), F.when(timed, field(15, 2)).otherwise(zero),
        F.when(timed & seconds, field(18, 2)).otherwise(zero),
    )
    part = lambda n: F.regexp_extract(gmt, OFFSET_PATTERN, n)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    ahead = F.when(part(1) == "-", -minutes).otherwise(minutes)
    # A wall time with an offset is that far from UTC; the common layouts have none.
    utc = F.when(timed & gmt.rlike(OFFSET_PATTERN), wall - F.make_dt_interval(mins=ahead)).otherwise(wall)
    return F.when(gmt.rlike(GMT_PATTERN), utc)


def ntz_iso(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> 'yyyy-MM-ddTHH:mm:ss' (whole seconds), without the session time zone."""
    text = ts.cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def format_datetime(gmt: Column, zone: str | None) -> Column:
    """'Y-m-d H:i:s +hh:mm' in the zone, '' for blank or unparseable input.

    Every step is independent of the session time zone (``date_format`` and
    ``timestamp_diff`` are not: they pass through it): the offset is the difference of
    two wall times as an ``INTERVAL MINUTE``, the text is the NTZ string form. The parsed
    and local times are evaluated unconditionally (a NULL flows through ``concat``), so
    Spark computes each shared sub-expression once per row.
    """
    tz = resolve_zone(zone)
    utc = parse_gmt(gmt)
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    offset = (local - utc).cast("interval minute").cast("bigint")
    minutes = F.abs(offset)
    text = F.concat(
        F.substring(local.cast("string"), 1, 19), F.lit(" "),
        F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
    )
    return F.coalesce(text, F.lit(""))


EPOCH = "1970-01-01 00:00:00"


def gmt_sort_key(gmt: Column) -> Column:
    """Sort key of a date_gmt: its UTC wall time; blank or unparseable sorts as the epoch."""
    return F.coalesce(parse_gmt(gmt), F.lit(EPOCH).cast("timestamp_ntz"))


def date_label(date_text: Column, show_date: str | None) -> Column:
    """'full' -> the date, 'date-only' -> first space-separated token, else ''."""
    if show_date == "full":
        return date_text
    if show_date == "date-only":
        return F.split(date_text, " ").getItem(0)
    return F.lit("")
