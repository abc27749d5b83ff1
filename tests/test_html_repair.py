"""H8: closing what documents leave open, against a stack written plainly and against random tags."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafcast.operators.html_repair import BLOCKS, CLOSES, RANKS, VOID, balanced


def repair(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "k int, html string")
    return [r.out for r in df.select("k", balanced(F.col("html")).alias("out")).orderBy("k").collect()]


CASES = [
    ("<p>one<p>two", "<p>one</p><p>two</p>"),
    ("<b>x<i>y</b>z</i>", "<b>x<i>y</i></b>z"),
    ("</div>text</p></br>", "text"),
    ("<p>a<hr>b<br>c", "<p>a</p><hr>b<br>c"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>"),
    ("<b><table><tr><td>x</b>y</table>z", "<b><table><tr><td>xy</td></tr></table>z</b>"),
    ("<dl><dt>a<dd>b<dt>c", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<div/>a<img/>", "<div/></div>a<img/>"),
    ("<SPAN>a</Span>", "<SPAN>a</span>"),
    ("<!-- <p> --><script>if (a < b) '</div>'</script><style>p{}</style>", "<!-- <p> --><script>if (a < b) '</div>'</script><style>p{}</style>"),
    ("<section><p>a</section>b", "<section><p>a</p></section>b"),
    ("2 < 3 & 4", "2 < 3 & 4"), ("", ""), (None, None),
]


def test_repair(spark):
    assert repair(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def plain(pieces):
    """The rules with a list as the stack; pieces are (kind, name)."""
    rank = {n: r for names, r in RANKS for n in names}
    stack, out = [], []

    def close(names, stops):
        i = next((i for i in reversed(range(len(stack))) if stack[i] in names), None)
        if i is not None and not any(stops(n) for n in stack[i + 1:]):
            while len(stack) > i:
                out.append(f"</{stack.pop()}>")

    for kind, name in pieces:
        if kind == "text":
            out.append(name)
        elif kind == "end":
            if name not in VOID:
                close((name,), lambda n: rank.get(n, 0) > rank.get(name, 0))
        else:
            for starts, shut, walls in CLOSES:
                if name in starts:
                    close(shut, lambda n: n in walls)
            out.append(f"<{name}>")
            if name not in VOID:
                stack.append(name)
    return "".join(out) + "".join(f"</{n}>" for n in reversed(stack))


def test_equals_a_plain_stack_on_random_tags(spark):
    rng = random.Random(3)
    names = ["p", "b", "i", "div", "ul", "li", "table", "tr", "td", "th", "tbody", "dl", "dd", "dt", "select", "option", "br", "hr", "h2", "a", "button"]
    docs, want = [], []
    for _ in range(400):
        pieces = [(k := rng.choice(("start", "start", "end", "text")), f"t{rng.randrange(9)} " if k == "text" else rng.choice(names)) for _ in range(rng.randrange(60))]
        docs.append("".join(n if k == "text" else f"</{n}>" if k == "end" else f"<{n}>" for k, n in pieces))
        want.append(plain(pieces))
    assert repair(spark, docs) == want
    assert repair(spark, want) == want  # a repaired document stays as it is


@pytest.mark.parametrize("doc", ["<p>a" * 100_000, "<p>w</b></p>" * 50_000])
def test_long_documents_take_time_in_proportion(spark, doc):
    start = time.time()
    (out,) = repair(spark, [doc])
    assert out == ("<p>a</p>" * 100_000 if "</b>" not in doc else "<p>w</p>" * 50_000)
    assert time.time() - start < 60


def test_rules_name_each_start_tag_once():
    names = [n for starts, _, _ in CLOSES for n in starts]
    assert len(names) == len(set(names)) and set(BLOCKS) <= set(names)
