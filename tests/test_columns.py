"""Goldens for the column functions, run through DataFrames."""

from pyspark.sql import functions as F

from conftest import apply
from leafcast.functions import clients, dates, http, text, urls, yaml


def test_normalize_url(spark):
    cases = [
        ("HtTp://Shop.Test", False, "http://shop.test"),
        ("https://shop.test/list//", False, "https://shop.test/list"),
        ("https://shop.test/list?q=2&r#top", False, "https://shop.test/list?q=2&r#top"),
        ("https://shop.test/list?q=2&r#top", True, "https://shop.test/list"),
        ("list/only", False, None),
        ("mailto:me@shop.test", False, None),
        ("https://me:secret@SHOP.test:444/x/", False, "https://shop.test:444/x"),
    ]
    for url, np_, exp in cases:
        assert apply(spark, [url], lambda c: urls.normalize_url(c, without_params=np_)) == [exp], url
    (idn,) = apply(spark, ["https://bücher.test/ü/"], urls.normalize_url)
    assert idn.startswith("https://xn--bcher-kva.test/")


def test_prettify_url(spark):
    assert apply(spark, ["http://shop.test/%C3%A4+b%2Fc"], urls.prettify_url) == ["http://shop.test/ä b/c"]
    assert apply(spark, ["https://xn--bcher-kva.test/"], urls.prettify_url) == ["https://bücher.test/"]
    assert apply(spark, ["https://s.test/%g1+y%21"], urls.prettify_url) == ["https://s.test/%g1 y!"]


def test_same_site(spark):
    df = spark.createDataFrame([
        ("https://shop.test", "https://shop.test/a/b", True),
        ("https://shop.test", "https://shop.test", True),
        ("https://shop.test", "https://other.test/shop.test", False),
        ("https://shop.test", "https://shop.testing/x", False),
        ("https://shop.test/de", "https://shop.test/de/x", True),
        ("https://shop.test/de", "https://shop.test/dekor", False),
        ("https://shop.test", "a/b", False),
    ], "b string, u string, exp boolean")
    for r in df.select(urls.same_site(F.col("b"), F.col("u")).alias("got"), "exp").collect():
        assert r.got == r.exp


def test_header_map(spark):
    raw = "HTTP/2 404\r\nETag:  \"a:b\" \r\nno colon here\r\nX-Empty:\r\n"
    (m,) = apply(spark, [raw], http.header_map)
    assert m == {"etag": '"a:b"', "x-empty": ""}
    (m,) = apply(spark, ["A: 1\r\nB: 2\r\na: 3\r\nA: 4"], http.header_map)
    assert m == {"b": "2", "a": "4"}
    assert apply(spark, ["", None], http.header_map) == [{}, {}]
    numbers = ["12", " +7x", "-3", "x", "", None, "3000000000", "9" * 25, "-" + "9" * 60]
    assert apply(spark, numbers, http.header_int) == [12, 7, -3, 0, 0, 0, 3000000000, (1 << 63) - 1, -(1 << 63)]


def test_capture_outcome(spark):
    df = spark.createDataFrame([(200, "hello", ""), (404, "nf", ""), (0, None, "timeout")], "status int, body string, error string")
    got = df.select(http.is_success(F.col("status")).alias("s"), http.outcome_body(F.col("status"), F.col("body")).alias("b"),
                    http.outcome_error(F.col("status"), F.col("error")).alias("e")).collect()
    assert [(r.s, r.b, r.e) for r in got] == [(True, "hello", ""), (False, None, "HTTP 404"), (False, None, "timeout")]


def test_yaml_scalar(spark):
    plain = ["Word", "two-parts", "back\\slash"]
    assert apply(spark, plain, yaml.yaml_scalar) == plain
    quoted = ["two words", "key: v", "9:30", "x, y", "# c", " edge", "", "false", "no", "3.5", "7", "~", "-", "全角　空白"]
    assert apply(spark, quoted, yaml.yaml_scalar) == ['"' + v + '"' for v in quoted]
    assert apply(spark, ['say "x"', "c:\\d e"], yaml.yaml_scalar) == ['"say \\"x\\""', '"c:\\\\d e"']
    assert apply(spark, [41, 0, -2], yaml.yaml_int, "bigint") == ["41", "0", "-2"]
    lists = [["one", "two"], ["p", "q, r"], []]
    assert apply(spark, lists, yaml.yaml_list, "array<string>") == ["[ one, two ]", '[ p, "q, r" ]', "[]"]


def test_format_datetime(spark):
    def shown(values, zone="UTC"):
        return apply(spark, values, lambda c: dates.format_datetime(c, zone))

    noon = "2024-02-29T12:30:15"
    assert shown([noon], "Europe/Paris") == ["2024-02-29 13:30:15 +01:00"]
    assert shown([noon], "Asia/Kathmandu") == ["2024-02-29 18:15:15 +05:45"]
    assert shown([noon], "-0330") == ["2024-02-29 09:00:15 -03:30"]
    assert shown([noon], "No/Zone") == ["2024-02-29 12:30:15 +00:00"]
    forms = [noon + "Z", noon + ".75", noon + "+09:00", noon + "-0330", "2024-02-29 12:30", "2024-02-29T12:30-01:00", "2024-02-29", noon + ".5Z"]
    assert shown(forms) == [
        "2024-02-29 12:30:15 +00:00", "2024-02-29 12:30:15 +00:00", "2024-02-29 03:30:15 +00:00", "2024-02-29 16:00:15 +00:00",
        "2024-02-29 12:30:00 +00:00", "2024-02-29 13:30:00 +00:00", "2024-02-29 00:00:00 +00:00", "2024-02-29 12:30:15 +00:00"]
    assert shown(["", "soon", None, "2023-02-29", "2024-02-29T25:00:00", "2024-02-29T12:30:15+9"]) == [""] * 6


def test_date_label(spark):
    v = "2031-11-03 07:15:00 +09:00"
    assert apply(spark, [v], lambda c: dates.date_label(c, "full")) == [v]
    assert apply(spark, [v], lambda c: dates.date_label(c, "date-only")) == ["2031-11-03"]
    assert apply(spark, [v], lambda c: dates.date_label(c, "none")) == [""]


def test_title_flat_and_text(spark):
    assert apply(spark, ["  Order\t12\n　F  "], text.title_flat) == ["Order 12 F"]
    assert apply(spark, ["a\r\nb\rc"], text.lf_normalize) == ["a\nb\nc"]
    assert apply(spark, ["a\n\n \t\n  b"], text.collapse_blank_lines) == ["a\n\n  b"]
    assert apply(spark, ['x <i class="fa fa-star"></i> y <i class="fab x"> </i>'], text.icon_replace) == ["x ■ y ■"]
    assert apply(spark, ['<a href="x">&\''], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#039;"]
    assert apply(spark, ["a\nb"], text.nl2br) == ["a<br />\nb"]


def test_is_agent(spark):
    uas = ["-", "", "Googlebot/2.1", "CLAUDE", "Mozilla/5.0 Firefox", "curl/8"]
    assert apply(spark, uas, clients.is_agent) == [True, False, True, True, False, True]


def test_negotiate_lang(spark):
    headers = ["ja,en-US;q=0.9", "en;q=0.5,ja;q=0.5", "fr", "", "ja;q=0", "fr;q=1, ja;q=0.2, en-GB;q=0.7"]
    assert apply(spark, headers, clients.negotiate_lang) == ["ja", "en", "en", "en", "ja", "en"]


def test_render_mode(spark):
    df = spark.createDataFrame([(True, False, "x"), (False, True, "x"), (False, False, "x"), (True, False, " Google ")],
                               "raw boolean, html boolean, ua string")
    got = [r.m for r in df.select(clients.render_mode(F.col("raw"), F.col("html"), F.col("ua")).alias("m")).collect()]
    assert got == ["raw", "html", "markdown", "html"]


def test_raw_url_encode_and_api_path(spark):
    assert apply(spark, ["a b*~+é/"], urls.raw_url_encode) == ["a%20b%2A~%2B%C3%A9%2F"]
    assert apply(spark, ["https://e.com/wp-json/wp/v2/posts/42?x"], urls.api_rest_base) == ["posts"]
    assert apply(spark, ["https://e.com/wp-json/wp/v2/posts/42?x", "/feed/"], urls.api_post_id) == [42, 0]
