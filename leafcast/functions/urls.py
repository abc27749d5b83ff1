"""URL column functions.

URLs are split with the RFC 3986 reference regex rather than ``parse_url``: Spark's
``parse_url`` uses a strict URI parser that rejects non-ASCII hosts and spaces, which
are exactly the inputs these functions exist for. Host names go through the JDK's
IDN class with ``try_reflect`` (a failed conversion keeps the original host).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL grammar pieces.
URL_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
HOST_PORT = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
API_PATH = r"/wp-json/wp/v2/([^/]+)/(\d+)"
STRAY_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, group)


def url_host(url: Column) -> Column:
    """Host of an absolute URL ('' when there is none); user info and port removed."""
    authority = _part(url, 2)
    host_port = F.regexp_extract(authority, r"^(?:.*@)?(.*)$", 1)
    return F.regexp_extract(host_port, HOST_PORT, 1)


def _url_port(url: Column) -> Column:
    authority = _part(url, 2)
    host_port = F.regexp_extract(authority, r"^(?:.*@)?(.*)$", 1)
    return F.regexp_extract(host_port, HOST_PORT, 2)


def idn_to_ascii(host: Column) -> Column:
    """Punycode a non-ASCII host; ASCII hosts and failed conversions pass through."""
    converted = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(converted, host)).otherwise(host)


def idn_to_unicode(host: Column) -> Column:
    converted = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toUnicode"), host)
    return F.coalesce(converted, host)


def normalize_url(url: Column, without_params: bool = False) -> Column:
    """Canonical http(s) URL, or NULL for relative URLs and other schemes.

    Lower-cased scheme and host, host in punycode, port kept, user info dropped,
    every trailing '/' of the path removed; query and fragment kept unless
    ``without_params``.
    """
    scheme = F.lower(_part(url, 1))
    host = url_host(url)
    port = _url_port(url)
    path = F.rtrim(_part(url, 3), F.lit("/"))
    base = F.concat(
        scheme, F.lit("://"), F.lower(idn_to_ascii(host)),
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")),
        path,
    )
    full = base if without_params else F.concat(base, _part(url, 4), _part(url, 5))
    ok = url.isNotNull() & scheme.isin("http", "https") & (host != "")
    return F.when(ok, full)


def url_decode_lenient(url: Column) -> Column:
    """urldecode(): '+' is a space, %XX decoded, a '%' not followed by two hex digits kept."""
    return F.call_function("try_url_decode", F.regexp_replace(url, STRAY_PERCENT, "%25"))


def prettify_url(url: Column) -> Column:
    """URL-decode, then show a punycode host in Unicode (every occurrence of it)."""
    decoded = url_decode_lenient(url)
    host = url_host(decoded)
    return F.when(
        host.contains("xn--"), F.replace(decoded, host, idn_to_unicode(host))
    ).otherwise(decoded)


def same_site(base: Column, url: Column) -> Column:
    """F8: URL equal to the site base or below it (query/fragment ignored); NULL-safe false."""
    b = normalize_url(base, without_params=True)
    u = normalize_url(url, without_params=True)
    return F.coalesce(b.isNotNull() & u.isNotNull() & ((u == b) | u.startswith(F.concat(b, F.lit("/")))), F.lit(False))


def raw_url_encode(c: Column) -> Column:
    """rawurlencode(): RFC 3986 unreserved characters kept, everything else %XX."""
    enc = F.url_encode(c)
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    return F.replace(enc, F.lit("%7E"), F.lit("~"))


def api_rest_base(href: Column) -> Column:
    """rest_base of a '/wp-json/wp/v2/<rest_base>/<id>' link ('' when absent)."""
    return F.regexp_extract(href, API_PATH, 1)


def api_post_id(href: Column) -> Column:
    """Numeric id of a '/wp-json/wp/v2/<rest_base>/<id>' link (0 when absent)."""
    return F.coalesce(F.regexp_extract(href, API_PATH, 2).try_cast("long"), F.lit(0).cast("long"))
