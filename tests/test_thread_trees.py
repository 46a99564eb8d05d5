"""Trees of thread pages: made once a page, of the elements that are looked at only, with the same results."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import markup, pages
from brindle.plans import pages as plans

PAGE = (
    '<img src="logo.png"><a href="f.php?fid=3&amp;filter=typeid&amp;typeid=8">b</a><title>t - x</title><table>'
    '<tr><th>a<th>b<td>1<td>2</tr><tr><th>c<td>3<table><tr><th>d<td>4</table></tr><tr><th>none</tr></table>'
    '<div id="post_1"><a class="b xi2">ann</a><b><span id="postmessage_1">one<div class="q blockcode">code</div><img file="z.gif"></span></b></div>'
    '<div id="post_2"><a class="xi2">bob</a><td id="postmessage_2">two<a href="x?aid=7">f.txt</a><a href="x?aid=7">g.txt</a></td></div>'
)


def _read(spark, tree):
    p = F.col("page")
    df = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string").withColumn("page", tree("html"))
    parts = [pages.posts(p), pages.code_blocks(p), pages.table_fields(p), pages.attachments(p), pages.images(p, F.lit("https://h/a/b")), pages.board_meta(p, ("9",), F.lit("0")), pages.thread_title(p), markup.page_text(p)]
    return df.select(*[x.alias(f"c{i}") for i, x in enumerate(parts)]).collect()


def test_only_what_is_looked_at(spark):
    whole, part = _read(spark, markup.tree), _read(spark, pages.thread_tree)
    assert whole == part
    first = whole[0]
    assert [tuple(x) for x in first["c2"]] == [("a", "1"), ("b", "1"), ("c", "3\nd\n4"), ("d", "4")]
    assert first["c4"] == ["https://h/a/z.gif", "https://h/a/logo.png"] and first["c6"] == "t"
    assert tuple(first["c5"]) == ("3", "8") and [tuple(x) for x in first["c3"]] == [("7", "f.txt")]
    posts = spark.createDataFrame([(PAGE,)], "html string").withColumn("page", pages.post_tree("html")).select(pages.posts(F.col("page")).alias("p"))
    assert posts.first()["p"] == first["c0"]
    kept = spark.createDataFrame([(PAGE,)], "html string").select(pages.thread_tree("html")["nodes"].alias("n")).first()["n"]
    assert {"tr", "b", "table"}.isdisjoint(n["tag"] for n in kept) and len(kept) < len(markup.read(PAGE)[1])


@pytest.mark.parametrize("name", ["s09_thread_page", "x62_author_posts"])
def test_pages_are_read_once(spark, name):
    plan = getattr(plans, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_all_posts_of_an_author(spark, tmp_path):
    piece = '<div id="post_{0}"><a class="xi2">{1}</a><td id="postmessage_{0}">said {0}</td></div>'
    html = "".join(piece.format(i, "bob" if i % 4 == 3 else "ann") for i in range(12))
    found = pages.posts(F.col("page"))
    df = spark.createDataFrame([(html,)], "html string").withColumn("page", pages.post_tree("html"))
    own, some = df.select(pages.author_posts(found), pages.author_posts(found, 5)).first()
    assert [p["pid"] for p in own] == [str(i) for i in range(12) if i % 4 != 3] and some == own[:5]
    orders = [(k, k // 40, "F" if k % 40 % 3 else "O", str(k % 5)) for k in range(80)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = plans.x57_thread(spark, str(tmp_path)).select("o_custkey", "name", "size").collect()
    assert sorted(map(tuple, rows)) == sorted((c, p, k % 60) for k, c, s, p in orders if s == "O")
