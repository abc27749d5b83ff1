"""Slim job (H1-H9) and Markdown job (M1-M14) over DataFrames, on documents of our own."""

import pytest
from pyspark.sql import functions as F

from leafcast.operators import html_jobs, htmltree
from leafcast.options import Options


def slim(spark, html, **options):
    df = spark.createDataFrame([(1, html)], "k int, html string")
    return html_jobs.slim_job(df, ["k"], "html", Options(**options)).first().slim


SLIM = [
    # attributes: kept ones in their order, others gone, quotes made double, names lowered
    ("<TD Class=q ColSpan=3 data-z='1'>v</TD>", '<td colspan="3">v</td>', {}),
    ("<img alt='say \"hi\"' src=p.png loading>", '<img alt="say &quot;hi&quot;" src="p.png">', {}),
    ('<input disabled value="a > b" alt="x">', '<input alt="x">', {}),
    # rel beside an href
    ('<a href="/one">1</a>', '<a href="/one" rel="noreferrer">1</a>', {}),
    ('<a rel=" me  ugc " href="/two">2</a>', '<a rel="me ugc noreferrer" href="/two">2</a>', {"keep_attrs": ("href", "rel")}),
    ('<a rel="ugc noreferrer" href="/3">3</a>', '<a rel="ugc noreferrer" href="/3">3</a>', {"keep_attrs": ("href", "rel")}),
    ('<a rel="ugc">no href</a>', '<a rel="ugc">no href</a>', {"keep_attrs": ("href", "rel")}),
    # dropped and unwrapped elements
    ("<p>one<script>if (a < b) '<p>'</script>two</p><STYLE>p{}</STYLE>", "<p>onetwo</p>", {}),
    ("<ul><li>a<aside>x<aside>y</aside>z</aside>b</li></ul>", "<ul><li>ab</li></ul>", {"drop_tags": ("aside",)}),
    ("<p><em>very <em>deep</em></em> text</p>", "<p>very deep text</p>", {"unwrap_tags": ("em",)}),
    # white space, lines and blocks that keep theirs
    ("<div>\r\n\r\n   two \t words   　 end</div>\n\n<hr>", "<div> two words end</div> <hr>", {}),
    ("<p>run <code>a  b</code>  on</p><pre class=k>\n  x\n\n\ty </pre>  ", "<p>run <code>a  b</code> on</p><pre>\n  x\n\n\ty </pre>", {}),
    ("<!-- a\n\n   b --><p>c</p>", "<!-- a\nb --><p>c</p>", {}),
    # wrappers and prologue
    ('<!doctype html><html><head><title>t</title></head><body class="b"><p>c</p></body></html>', "<p>c</p>", {}),
    ("<body>one</body><body>two</body>", "onetwo", {}),
    ("2 < 3 & 4 &amp; 5 &gt; 1", "2 < 3 & 4 &amp; 5 &gt; 1", {}),
    ("  \n ", "  \n ", {}), ("", "", {}), (None, None, {}),
]


@pytest.mark.parametrize(("html", "expected", "options"), SLIM)
def test_slim(spark, html, expected, options):
    assert slim(spark, html, **options) == expected


def test_slim_is_native_and_keeps_deep_and_long_documents(spark):
    deep = "<section>" * 4000 + "<b id=i>x</b>" + "</section>" * 4000
    df = spark.createDataFrame([(1, deep), (2, "<p a=1>w  w</p>\n" * 20000)], "k int, html string")
    job = html_jobs.slim_job(df, ["k"], "html", Options())
    assert "Python" not in job._jdf.queryExecution().optimizedPlan().toString() and "Arrow" not in job._jdf.queryExecution().optimizedPlan().toString()
    out = {r.k: r.slim for r in job.collect()}
    assert out[1] == deep.replace(" id=i", "") and out[2] == ("<p>w w</p> " * 20000).strip()


def markdown(spark, html, form="keep", title="Name"):
    df = spark.createDataFrame([(1, html, title)], "k int, html string, title string")
    r = html_jobs.markdown_job(df, ["k"], "html", "title", Options(form_handling=form)).first()
    assert r.error is None
    return r.markdown.removeprefix("# Name\n\n")


MARKDOWN = [
    # headings, paragraphs, emphasis, breaks, escapes
    ("<h3>Sub  title</h3><p>one<b> two </b>three<br>four", "### Sub title\n\none **two** three\nfour"),
    ("<p># 5 * 3 [x] a_b</p>", "\\# 5 \\* 3 \\[x\\] a\\_b"),
    ("<p>1 &lt; 2 &amp; 3</p>", "1 &lt; 2 &amp; 3"),
    # links and images
    ('<a href="/p" title="T">l</a> <a>none</a> <img src="i.png" alt="pic"><img alt="lost">', '[l](/p "T") none ![pic](i.png)'),
    # lists, lists in lists, lists without an item around them, blocks in items
    ("<ul><li>a<ol start=4><li>b<li>c</ol><li>d</ul>", "- a\n  4. b\n  5. c\n- d"),
    ("<ol><li>a</li><ul><li>kept</li></ul><li>b</li></ol>", "1. a\n  - kept\n2. b"),
    ("<ul><li>see<pre>x\n  y</pre>end</li></ul>", "- see\n  ```\n  x\n    y\n  ```\n  end"),
    # fences: the code's language, then the block's, then its first class
    ('<pre class="wp-block-code"><code class="lang-rust">fn f() {}\n</code></pre>', "```rust\nfn f() {}\n```"),
    ('<pre class="wide language-sql">SELECT 1</pre>', "```sql\nSELECT 1\n```"),
    ('<pre class="dot">a -&gt; b</pre>', "```dot\na -> b\n```"),
    ("<pre>  keep\n\n\n  all</pre>", "```\n  keep\n\n  all\n```"),
    ("<p><code>a`b</code> <code>`c`</code>", "``a`b`` `` `c` ``"),
    # tables stay HTML; text between rows and cells goes, columns go, spans of one go
    ("<table>lost<colgroup><col></colgroup><caption> C </caption><tr>lost<th colspan=2 rowspan=1>h</th></tr><tr><td>a<br>b<td>c</table>",
     "<table>\n\n<caption>C</caption>\n<tr>\n<th colspan=\"2\">h</th>\n</tr>\n<tr>\n<td>\n\na\nb\n\n</td>\n<td>c</td>\n</tr>\n\n</table>"),
    # blocks, quotes, rules, what is left out
    ("<aside>x</aside><dl><dt>t<dd>d</dl>", "x\n\nt\n\nd"),
    ("<blockquote><p>q<pre>1\n2</pre></blockquote><hr>", "> q\n>\n> ```\n> 1\n> 2\n> ```\n\n- - - - - -"),
    ("<head><title>t</title></head><script>s</script><style>s</style><custom>in</custom><!-- c -->", "in"),
    ("a\x020\x03\x04b", "a�0��b"),
]


@pytest.mark.parametrize(("html", "expected"), MARKDOWN)
def test_markdown(spark, html, expected):
    assert markdown(spark, html) == expected


def test_markdown_forms(spark):
    html = "<p>up</p><form><label>Mail</label><select><option>x</select></form><p>down</p>"
    assert markdown(spark, html) == "up\n\n<form>\n\nMailx\n\n</form>\n\ndown"
    assert markdown(spark, html, "remove") == "up\n\n<form />\n\ndown"


def test_markdown_document_passes(spark):
    html = '<p><i class="fas fa-check"></i> <a href="https://xn--wgv71a119e.example/x%20y">go</a></p>\r\n\r\n\r\n<p>z</p>'
    assert markdown(spark, html, title=" Name\n") == "■ [go](https://日本語.example/x y)\n\nz"


def test_any_depth_converts():
    for tag in ("div", "b", "ul", "blockquote", "table"):
        assert "deep" in htmltree.markdown(f"<{tag}>" * 3000 + ("<td>deep" if tag == "table" else "deep"))


def test_null_and_failing_documents_are_rows(spark):
    df = spark.createDataFrame([(1, "fine"), (2, None), (3, "bad")], "k int, html string")

    def convert(doc):
        if doc == "bad":
            raise ValueError("cannot convert " + "x" * 900)
        return doc

    rows = {r.k: r for r in html_jobs._arrow_job(df, ["k"], "html", convert, None).collect()}
    assert rows[1].out == "fine" and rows[2].out is None and rows[2].error is None
    assert rows[3].out is None and rows[3].error == "ValueError: cannot convert " + "x" * 900


def test_link_targets(spark):
    df = spark.createDataFrame([("[a](https://h/%41) ] [b](/rel%20x) [c](http://h/y%20z)",)], "m string")
    assert df.select(html_jobs.prettify_link_targets(F.col("m")).alias("p")).first().p == "[a](https://h/A) ] [b](/rel%20x) [c](http://h/y z)"


@pytest.mark.parametrize("files", [1, 6])
def test_documents_are_spread_by_bytes(spark, files):
    """A few very long documents at the end of many short ones: the largest task has at most twice the median bytes."""
    from leafcast.session import materialize

    rows = [(i, "x" * (50 if i < 900 else 5000)) for i in range(1000)]
    df = materialize(spark.createDataFrame(rows, "id int, html string").coalesce(1).repartitionByRange(files, "id"), "test-spread")
    dealt = html_jobs.spread(df, F.octet_length("html"), 8)
    assert sorted((r.id, len(r.html)) for r in dealt.collect()) == [(i, len(t)) for i, t in rows]
    sizes = sorted(r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("html")).alias("n")).collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    assert html_jobs.spread(df.where("id < 0"), F.octet_length("html"), 8).count() == 0


def test_even_rows_stay_where_they_are(spark):
    """Rows whose tasks hold about the same bytes are not shuffled; uneven ones are."""
    n = spark.sparkContext.defaultParallelism
    even = spark.range(0, 4000, 1, n).select("id", F.lit("x" * 50).alias("html"))
    uneven = spark.range(0, 4000, 1, n).select("id", F.when(F.col("id") < 40, F.lit("x" * 5000)).otherwise("x").alias("html"))
    plan = lambda df: html_jobs.spread(df, F.octet_length("html"), n)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(even)
    assert n < 3 or "Exchange" in plan(uneven)


def test_runs_of_white_space(spark):
    """Single spaces are left alone, every other run becomes one space, as by the plain class."""
    from itertools import product

    from leafcast.operators import slim as sl

    texts = ["".join(p) for k in range(1, 6) for p in product(" \t\n a", repeat=k)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, runs = F.regexp_replace("t", sl.SPACES + "+", " "), F.regexp_replace("t", sl.SPACE, " ")
    assert df.where(plain != runs).count() == 0
    assert df.where(F.regexp_count(F.lit(" a b "), F.lit(sl.SPACE)) > 0).count() == 0
