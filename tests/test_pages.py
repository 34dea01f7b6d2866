"""Pages against the standard HTML parser: events and markdown of whole pages, and of small odd ones."""

from __future__ import annotations

import random

from html_events import events, markdown
from pyspark.sql import functions as F
from weftline.operators import markdown as M
from weftline.operators import tokens as T

ODD = [
    "a &amp b &notit; &copy;&copy &#169; &#xA9 &#x80; &#0; &#xD800; &#1114112; &; &x; &lt;b&gt; & &#; &CounterClockwiseContourIntegral; &ampamp; x",
    "<p title='a > b' class=x>one</p><a href=\"q?a=1&amp;b=2&copy=3\">two</a><a href='r'>three</a><a href=bare>four</a><a>five</a> ",
    "<script>if (a < b && c > d) { x = '<p>&amp;</p>' }</script><style>p > a {}</style><SCRIPT type='a'>y</Script ><script></script>z ",
    "<!-- a <b> -- > <![CDATA[ x <p> ]]><!DOCTYPE html><?php x ?></ p><br/><p/><ul><li>1<ul/><li>2</ul><my-p>no</my-p> < b <3 <",
    "<div class='a note'>n</div><div class=\"plain\">p</div><div>q</div><h1>A<br>b</h1><h7>x</h7><pre><code>a &lt; b</code></pre> <code>c</code><table><tr><th>1</th><td>2</td></tr></table> ",
    "tail &am", "tail &amp;", "<script>open &amp; <p>lost", "x <a href='", "", "\n", "<a href='/x'>li<i>nk</i></a><b>o</b>",
]


def reported(spark, pages):
    found = {}
    for r in M.page_events(spark.createDataFrame(list(enumerate(pages)), "k int, html string"), "k").orderBy("k", "i").collect():
        out = found.setdefault(r.k, [])
        if r.text is not None:
            out.append(("text", (out.pop()[1] if out and out[-1][0] == "text" else "") + r.text))
        elif r.name and r.close:
            out.append(("end", r.name))
        elif r.name:
            out.append(("start", r.name, r.href, r["class"]))
            out += [("end", r.name)] if r.alone else []
    return [found[k] for k in range(len(pages))]


def test_events_of_whole_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    assert reported(spark, pages) == [events(p) for p in pages]
    made = {r.k: r.markdown for r in M.to_markdown(spark.createDataFrame(list(enumerate(pages)), "k int, html string"), "k").collect()}
    assert [made[k] for k in range(len(pages))] == [markdown(p) for p in pages]
    assert all("©" in m and "</p>" in m and "&copy;" not in m for m in made.values())


def test_events_of_odd_pages(spark):
    rng = random.Random(8)
    bits = ["<p>", "</p>", "a ", "&amp;", "&copy", "&#65;", "<script>", "x<y", "</script>", "<b class='q>'>", "<!-- c -->", "<br/>", "\n", "<a href=\"u&amp;v\">", "</a>", "<li>", "&nope; ", "1 < 2 "]
    pages = [*ODD, *("".join(rng.choices(bits, k=rng.randrange(1, 14))) + " ." for _ in range(300))]
    for page, got in zip(pages, reported(spark, pages), strict=True):
        assert got == events(page), page


def test_null_page(spark):
    assert reported(spark, [None]) == [[]]
    assert [r.markdown for r in M.to_markdown(spark.createDataFrame([(1, None)], "k int, html string"), "k").collect()] == ["\n"]


def test_pages_are_cut_once(spark):
    page = "<ul>" + "".join(f"<li><a href='/{k}?a&amp;b'>n&copy;{k}</a> <b>x</b></li>" for k in range(700)) + "</ul><a>open "
    df = spark.createDataFrame([(1, page)], "k int, html string")
    made = M.to_markdown(df, "k")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1  # beside the generator it ran again for each piece
    assert "unboundedfollowing" not in plan.lower()  # a frame that is gone over again for each piece
    assert [r.markdown for r in made.collect()] == [markdown(page)]


def test_blocks_are_typed_without_patterns_for_their_ends(spark):
    blocks = ["\f\x0b\t \n```\nx\n``` \r\n", "\n  | a | b |\n | c |\n\n", " \n**Tip:** x \n", "\r\nvoid f(a)\n", " \n ", "\u00a0```", "__Very  Important__: y", "**Note:**\n", "a | b\nc"]
    df = spark.createDataFrame([(b,) for b in blocks], "b string").select(T.content_type(F.col("b")).alias("t"))
    assert [r.t for r in df.collect()] == ["CODE_EXAMPLE", "TABLE_ROW", "PRO_TIP", "SIGNATURE", "PROSE", "PROSE", "VERY_IMPORTANT", "PROSE", "PROSE"]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()  # it ran for every kind that a block may be
