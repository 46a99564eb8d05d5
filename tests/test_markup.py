"""Pages as trees: nested tables and lists, tags that are left open, odd attributes, linear time, posts and pictures."""

import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import markup, pages


def shape(html):
    text, nodes = markup.read(html)
    return [(n["path"], " ".join(text[n["begin"] : n["end"]].split())) for n in nodes]


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<table><tr><td>a<table><tr><td>b</table>c<td>d<tr><td>e</table>f", [("table", "a b c d e"), ("table/tr", "a b c d"), ("table/tr/td", "a b c"), ("table/tr/td/table", "b"), ("table/tr/td/table/tr", "b"), ("table/tr/td/table/tr/td", "b"), ("table/tr/td", "d"), ("table/tr", "e"), ("table/tr/td", "e")]),
        ("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", [("ul", "1 2 3 4"), ("ul/li", "1 2 3"), ("ul/li/ul", "2 3"), ("ul/li/ul/li", "2"), ("ul/li/ul/li", "3"), ("ul/li", "4")]),
        ("<p>a<p>b<div>c</p>d</div>e", [("p", "a"), ("p", "b"), ("div", "c d")][:2] + [("div", "cd")]),
        ("<div><td>x</div>y</td></div>z", [("div", "x y"), ("div/td", "xy")][:1] + [("div/td", "xy")]),
        ("a<br>b<!-- <p> -->c<script>'<p>'</script>d<title>t<b></title>", [("br", ""), ("script", ""), ("title", "t<b>")]),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", [("dl", "a b c"), ("dl/dt", "a"), ("dl/dd", "b"), ("dl/dt", "c"), ("select", "12"), ("select/option", "1"), ("select/option", "2")]),
        ("</p></x>1 < 2 <3 &lt;b&gt; <", []),
        ("", []),
    ],
)
def test_shapes(html, wanted):
    got = shape(html)
    assert [(p, t.replace(" ", "")) for p, t in got] == [(p, t.replace(" ", "")) for p, t in wanted]


def test_attributes():
    _, (a, img) = markup.read("""<A HREF='x>y' Title="q 'r' &amp;" checked  data-n=5 href=second><img/src=a.png alt="">""")
    assert dict(a["attrs"]) == {"href": "x>y", "title": "q 'r' &", "checked": "", "data-n": "5"} and dict(img["attrs"]) == {"src": "a.png", "alt": ""}
    assert dict(markup.read('<a x="open')[1][0]["attrs"])


@pytest.mark.parametrize("piece,close", [("<div>", ""), ('<a "', ""), ("<li>x", ""), ("<!--", ""), ("<", ""), ("<p>a", ""), ("<a x='", ""), ("<table><tr><td>", ""), ("<b>", "</i>"), ("<td><b>", "</div>"), ("<title>", "")])
def test_linear_time(piece, close):
    def seconds(n):
        began = time.process_time()
        markup.read(piece * n + close * n)
        return time.process_time() - began

    n = 400_000 // max(len(piece), 4)
    assert seconds(n) < 8 * seconds(n // 4) + 0.5


def test_posts_with_tables_inside(spark):
    html = '<div id="post_1"><a class="b xi2">ann</a><table><tr><td id="postmessage_1">one<table><tr><th>k<td>v</table>two<ul><li>x</ul><img src=" i.png "></td></tr></table></div><div id="post_2"><td id="postmessage_2"> </td></div><img src="//h/o.jpg"><img file="/z.gif" src="q">'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").withColumn("page", markup.tree("html"))
    out = df.select(pages.posts(F.col("page")).alias("p"), pages.images(F.col("page"), F.lit("https://a.example/b/c")).alias("i"), pages.table_fields(F.col("page")).alias("f"), markup.page_text(F.col("page")).alias("t")).collect()
    assert [tuple(p)[:4] for p in out[0]["p"]] == [("1", 1, "ann", "one\nk\nv\ntwo\nx")]
    assert out[0]["i"] == ["https://a.example/b/i.png", "https://h/o.jpg", "https://a.example/z.gif"]
    assert [tuple(f) for f in out[0]["f"]] == [("k", "v")]
    assert out[1]["p"] is None and out[2]["p"] == [] and out[2]["t"] == ""


def test_trees_leave_in_slices():
    import pyarrow as pa

    html = ["<p>a" * 1000, None, *["<b>x</b>"] * 600, "<p>b" * (markup.SLICE_CHARS // 4), "<i>y"]
    parts = list(markup.tree.func(iter([pa.array(html[:300]), pa.array(html[300:])])))
    assert max(map(len, parts)) <= markup.SLICE_PAGES and len(parts) == 5
    assert [r and (r["text"], len(r["nodes"])) for p in parts for r in p.to_pylist()] == [h and (markup.read(h)[0], len(markup.read(h)[1])) for h in html]


def test_trees_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    html = pa.array(["<p a=1>x<b>y</b>" * 1024] * 40)
    tracemalloc.start()
    try:
        assert sum(map(len, markup.tree.func(iter([html])))) == 40
        assert tracemalloc.get_traced_memory()[1] < 20e6  # elements as dicts, a million characters at once: 45 MB
    finally:
        tracemalloc.stop()


def test_quick_and_slow_ways_agree():
    quoted = """t &lt;<A  HREF="x>&amp;y" href="2" Class="a b"\n>u</a><td></TD >v<script a="1">'<p>'</script>w"""
    odd = quoted.replace('href="2"', "href=2")  # such a tag is read attribute by attribute
    assert markup.read(quoted) == markup.read(odd)
    assert [n["attrs"] for n in markup.read(quoted)[1]] == [[("href", "x>&y"), ("class", "a b")], [], [("a", "1")]]
