"""Text column functions: whitespace, line endings, HTML escaping, icon replacement.

Every function maps Column -> Column and stays inside Spark's expression engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# - "whitespace" in Unicode-aware patterns: tab, LF, VT, FF, CR and every Z-category char
#   (space, no-break space, ideographic space U+3000, ...).
UNICODE_WS = r"[\t\n\x0B\f\r\x{85}\x{180E}\p{Z}]"
# - characters removed by a plain trim(): space, tab, LF, CR, NUL, VT.
TRIM_CHARS = " \t\n\r\x00\x0b"
# - blank-line runs: two or more whitespace-only lines collapse to one blank line.
BLANK_RUN = r"(?:[ \t]*\n){2,}"
# - an empty Font Awesome icon element (fa, fab, fas, far, fal, fad as a class word).
ICON_ELEMENT = r"""(?i)<i\b[^>]*\bclass\s*=\s*["'][^"']*\bfa[bsrld]?\b[^"']*["'][^>]*>\s*</i>"""
ICON_TEXT = "■"


def php_trim(c: Column) -> Column:
    """trim() with the default character set (not only spaces)."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def collapse_ws(c: Column) -> Column:
    """Each run of Unicode whitespace becomes one ASCII space."""
    return F.regexp_replace(c, UNICODE_WS + "+", " ")


def title_flat(c: Column) -> Column:
    """One-line title; a missing title is the empty string."""
    return php_trim(collapse_ws(F.coalesce(c, F.lit(""))))


def lf_normalize(c: Column) -> Column:
    """C4: CRLF and lone CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def collapse_blank_lines(c: Column) -> Column:
    """Runs of blank (whitespace-only) lines become a single blank line."""
    return F.regexp_replace(c, BLANK_RUN, "\n\n")


def icon_replace(c: Column) -> Column:
    """Empty Font Awesome <i> elements become a black square."""
    return F.regexp_replace(c, ICON_ELEMENT, ICON_TEXT)


def html_escape(c: Column) -> Column:
    """Escape & < > " ' for HTML text and attribute values (& first)."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def nl2br(c: Column) -> Column:
    """C13: '<br />' before each line break (CRLF, LFCR, LF or CR kept after it)."""
    return F.regexp_replace(c, r"(\r\n|\n\r|\n|\r)", "<br />$1")
