"""Registered queries of page reading on pages that are made from the driver tables, and the same in SQL.

The pages hold what the tables have, so the SQL tells what must be read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import links, markup, pages
from brindle.operators import boards, facets, frames
from brindle.plans.catalogue import query, table
from brindle.session import Scratch


def _joined(rows, key: str, order: str, piece):
    """One page a key: pieces of markup in order."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("piece")))).alias("ps"))
    return grouped.select(key, F.concat(F.lit("<html><title>List - x</title><table>"), F.array_join(F.transform("ps", lambda p: p["piece"]), "\n"), F.lit("</table></html>")).alias("html"))


def _by_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("page", F.floor(F.col("c_custkey") / 40))


@query("SELECT c_custkey // 40 AS page, c_custkey AS tid, c_custkey % 9 = 0 AS sticky, 'thread-' || c_custkey || '-1-1.html?a=1&b=2' AS url, c_name || ' & co' AS title, '2024-1-' || (c_custkey % 28 + 1) AS posted FROM customer")
def s07_list_page(spark, sf_dir):
    """Rows of list pages of forty customers, each row twice."""
    k = F.col("c_custkey").cast("string")
    kind = F.when(F.col("c_custkey") % 9 == 0, "stick").otherwise("normal")
    row = F.concat(F.lit('<tbody id="'), kind, F.lit("thread_"), k, F.lit('"><tr><td><a href="/x">x</a> <A class="s" href="thread-'), k, F.lit('-1-1.html?a=1&amp;b=2">'), "c_name", F.lit(" <b>& co</b></A><em>2024-1-"), (F.col("c_custkey") % 28 + 1).cast("string"), F.lit("</em></td></tr></tbody>"))
    html = _joined(_by_page(spark, sf_dir), "page", "c_custkey", F.concat(row, row))
    return html.select("page", F.explode(pages.list_rows(F.col("html"))).alias("r")).select("page", "r.*")


@query("SELECT c_custkey // 40 AS page, c_custkey AS tid, 'read.php?fid=3&tid=' || c_custkey AS url, c_name AS title FROM customer WHERE c_custkey % 10 <> 3")
def s08_anchor_page(spark, sf_dir):
    """Links of another kind of list page; those with short or listed titles go."""
    k = F.col("c_custkey").cast("string")
    title = F.when(F.col("c_custkey") % 20 == 3, "x").when(F.col("c_custkey") % 10 == 3, "next").otherwise(F.col("c_name"))
    row = F.concat(F.lit('<td><a name="n" href="read.php?fid=3&amp;tid='), k, F.lit('#top">'), title, F.lit("</a></td>"))
    html = _joined(_by_page(spark, sf_dir), "page", "c_custkey", row)
    return html.select("page", F.explode(pages.anchor_rows(F.col("html"), skip=("next",))).alias("r")).select("page", "r.*")


def _threads(spark, sf_dir):
    """One thread a customer: posts with a table, a list without closing tags, code, pictures and a quoted bracket inside."""
    k = F.col("o_orderkey").cast("string")
    inner = F.concat(F.lit("<table><tr><th>priority<td>"), "o_orderpriority", F.lit('</table><ul><li>one<li title="a > b">two</ul><div class="x blockcode"><ol><li>code '), k, F.lit("</ol></div>"))
    seen = F.concat(F.lit('<img src="/i/'), k, F.lit('.jpg" file="//img.example/'), k, F.lit('.jpg"><img src="smilies/1.gif">'))
    body = F.concat(F.lit("said &amp; done"), inner, F.lit("end"), seen, F.lit(' posted at <span title="2024-2-3 4:05">x</span><a href="f?aid='), k, F.lit('">a'), k, F.lit(".txt</a>"))
    body = F.when(F.col("o_orderkey") % 11 == 0, "<br>").otherwise(body)
    piece = F.concat(F.lit('<div class="p" id="post_'), k, F.lit('"><a class="xi2" href="u">'), "o_orderstatus", F.lit('</a><table><tr><td class="t_f" id="postmessage_'), k, F.lit('">'), body, F.lit("</td></tr></table></div>"))
    html = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", piece)
    head = F.lit('<img src="logo.png"><a href="f.php?fid=7&amp;x=1">b</a><a href="f.php?fid=12&amp;filter=typeid&amp;typeid=5">c</a>')
    return html.select("o_custkey", F.concat(head, "html").alias("html")).withColumn("page", pages.thread_tree("html"))


_POSTS = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS floor FROM orders WHERE o_orderkey % 11 <> 0"


@query(f"""SELECT o_custkey, o_orderkey::VARCHAR AS pid, floor, o_orderstatus AS author, 'said & done' || chr(10) || 'priority' || chr(10) || o_orderpriority || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'code ' || o_orderkey || chr(10) || 'end posted at xa' || o_orderkey || '.txt' AS content FROM ({_POSTS})""")
def x93_posts(spark, sf_dir):
    """Posts of threads with tables and lists in them; posts without text are none."""
    found = _threads(spark, sf_dir).select("o_custkey", F.explode(pages.posts(F.col("page"))).alias("p"))
    return found.select("o_custkey", "p.pid", "p.floor", "p.author", "p.content")


@query(f"SELECT o_custkey, least(5, count(*) FILTER (WHERE o_orderstatus = first)) AS n, min(first) AS author FROM (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM ({_POSTS})) GROUP BY o_custkey")
def x62_author_posts(spark, sf_dir):
    """How many posts of a thread are by its author, five at most."""
    own = pages.author_posts(pages.posts(F.col("page")), 5)
    return _threads(spark, sf_dir).select("o_custkey", own.alias("own")).where(F.size("own") > 0).select("o_custkey", F.size("own").alias("n"), F.get("own", F.lit(0))["author"].alias("author"))


@query(f"""SELECT o_custkey, count(*) AS blocks, min('code ' || o_orderkey) AS least, count(*) AS files, min('a' || o_orderkey || '.txt') AS file, TIMESTAMP '2024-02-03 04:05:00' AS posted, '12' AS board, '5' AS kind, 'List' AS title,
string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS fields, string_agg('https://img.example/' || o_orderkey || '.jpg', '|' ORDER BY o_orderkey) FILTER (WHERE floor <= 6) || CASE WHEN count(*) < 6 THEN '|https://t.example/a/logo.png' ELSE '' END AS images FROM ({_POSTS}) GROUP BY o_custkey""")
def s09_thread_page(spark, sf_dir):
    """What else a thread page has: code blocks, attachments, fields, pictures, its date, board, type and title."""
    p, h = F.col("page"), F.col("html")
    seen = pages.images(p, F.lit("https://t.example/a/b?c=d"), noise="smilies/")
    read = _threads(spark, sf_dir).select("o_custkey", pages.code_blocks(p).alias("c"), pages.attachments(p, r"\.txt$", "^b").alias("a"), pages.table_fields(p).alias("f"), seen.alias("i"), pages.posted_at(h).cast("timestamp_ntz").alias("posted"), pages.board_meta(p, ("12", "13"), F.lit("0")).alias("b"), pages.thread_title(p).alias("title"))
    names = F.transform("a", lambda x: x["name"])
    return read.where(F.size("c") > 0).select("o_custkey", F.size("c").alias("blocks"), F.array_min("c").alias("least"), F.size("a").alias("files"), F.array_min(names).alias("file"), "posted", F.col("b.board").alias("board"), F.col("b.type").alias("kind"), "title", F.array_join(F.transform("f", lambda x: x["value"]), "|").alias("fields"), F.array_join("i", "|").alias("images"))


_BARE = r"regexp_replace(html, '<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<textarea[^>]*>.*?</textarea>|<noscript[^>]*>.*?</noscript>', '', 'gs')"


@query(f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower({_BARE}), '<([a-z][^\\s/>]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def s09_elements(spark, sf_dir):
    """Elements of web pages by name, but for scripts and styles."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.tree("html")["nodes"]).alias("n"))
    return found.where(~F.col("n.tag").isin("script", "style", "textarea", "noscript")).groupBy("page_id", F.col("n.tag").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 1 THEN 'é' WHEN p_partkey % 3 = 2 THEN '名' ELSE '名é' END AS text FROM part")
def s10_decoded(spark, sf_dir):
    """Texts read from bytes in one of three encodings."""
    m, gbk, latin = F.col("p_partkey") % 3, F.unhex(F.lit("C3FB")), F.unhex(F.lit("E9"))
    name = F.encode("p_name", "UTF-8")
    raw = F.when(m == 0, F.concat(F.unhex(F.lit("EFBBBF")), name, F.encode(F.lit("名é"), "UTF-8"))).when(m == 1, F.concat(name, latin)).otherwise(F.concat(name, gbk))
    return table(spark, sf_dir, "part").select("p_partkey", pages.decoded(raw).alias("text"))


_CARDS = """'intro' || chr(10) || '【影 片名称】：' || p_name || chr(10) || ' [大小]: ' || p_size || 'GB' || chr(10) || 'more' || chr(10) || '「格式」' || p_type || chr(10) || '【影片名称】：again'"""


@query("SELECT p_partkey, unnest([1, 2, 3, 4]) AS place, unnest(['影片名称', '大小', '格式', '影片名称']) AS label, unnest([p_name, p_size || 'GB' || chr(10) || 'more', p_type, 'again']) AS value FROM part")
def x50_cards(spark, sf_dir):
    """Labelled fields in three kinds of brackets, one of them over two lines and one repeated."""
    text = F.expr(_CARDS.replace("chr(10)", "char(10)"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pages.cards(text)).alias("i", "c")).select("p_partkey", (F.col("i") + 1).alias("place"), "c.label", "c.value")


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind, CASE WHEN p_partkey % 2 = 1 THEN left(p_brand, 6) END AS format, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 2 END AS n FROM part")
def x52_metadata(spark, sf_dir):
    """Fields as a map: aliases, the first filled value, cut, and one of two exclusive labels."""
    even = F.col("p_partkey") % 2 == 0
    text = F.concat(F.lit("【title】\n【name】"), "p_name", F.lit("\n【title】other\n"), F.when(even, F.concat(F.lit("【kind】"), F.left("p_type", F.lit(6)), F.lit("\n"))).otherwise(""), F.lit("【format】"), "p_brand")
    found = pages.metadata(pages.cards(text), {"title": "name"}, (("kind", "format"),), 200)
    m = table(spark, sf_dir, "part").select("p_partkey", "p_type", found.alias("m"))
    kind = F.when(F.col("m")["kind"] == F.left("p_type", F.lit(6)), F.col("p_type"))
    return m.select("p_partkey", F.col("m")["name"].alias("name"), kind.alias("kind"), F.left(F.col("m")["format"], F.lit(6)).alias("format"), F.size(F.map_keys("m")).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'z' || p_size WHEN 1 THEN 'a' || p_size WHEN 2 THEN NULL ELSE p_name END AS secret FROM part")
def x53_password(spark, sf_dir):
    """Passwords by the order of some ways to write them."""
    s = F.col("p_size").cast("string")
    text = F.expr("case p_partkey % 4 when 0 then concat('password: a', p_size, ' 【key】z', p_size) when 1 then concat('x password: a', p_size) when 2 then 'none' else concat('key is [', p_name, ']') end")
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), text.alias("t")).select("p_partkey", pages.password(F.col("t"), [r"【key】\s*(\S+)", r"password:\s*(\S+)", r"key is \[([^\]]+)\]"]).alias("secret"))


@query("SELECT p_partkey, unnest(['a.example', 'b.example']) AS host, unnest(['s' || p_partkey, 't' || p_partkey]) AS id, unnest(['q' || p_size, 'c' || p_size]) AS password FROM part")
def x48_share_links(spark, sf_dir):
    """Links to shared folders with their codes: one in the link, one in the text near it; a repeated link counts once."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("see https://a.example/s/s"), k, F.lit("?password=q"), s, F.lit(" or\nhttps://www.b.example/s/t"), k, F.lit(" code: c"), s, F.lit("\nhttps://b.example/s/t"), k)
    found = pages.share_links(text, ("a.example", "b.example"), r"code:\s*(\w+)")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("x")).select("p_partkey", "x.*")


@query("SELECT page_id, (length(html) - length(replace(html, 'href=\"', '')))::BIGINT // 6 AS n, len(list_distinct(regexp_extract_all(lower(html), 'href=\"[^\"]*\"'))) AS different FROM pages")
def x61_link_counts(spark, sf_dir):
    """Links of pages, all and different ones."""
    n, different = pages.link_counts(F.col("html"), r'(?i)href="[^"]*"')
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n"), different.alias("different"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '5-LOW') THEN 'attached' ELSE 'all' END AS way FROM orders GROUP BY o_custkey")
def x81_corpus(spark, sf_dir):
    """Where links are looked for: in attachments if they have any."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("attached"))
    text = pages.corpus(F.array(F.lit("body")), F.col("attached"), "5-LOW")
    return o.select("o_custkey", F.when(text.startswith("body"), "all").otherwise("attached").alias("way"))


@query("SELECT parent, CASE WHEN count(*) = 1 THEN min(k) ELSE parent END AS head, count(*) AS parts FROM (SELECT DISTINCT split_part(k, ':', 1) AS parent, k FROM (SELECT c_nationkey || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE ':' || (c_custkey % (c_nationkey % 3 + 1)) END AS k FROM customer)) GROUP BY parent")
def x11_scan_heads(spark, sf_dir):
    """What is scanned of boards with one part or more."""
    n = F.col("c_nationkey")
    key = F.concat(n.cast("string"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(":"), (F.col("c_custkey") % (n % 3 + 1)).cast("string"))))
    return boards.scan_heads(table(spark, sf_dir, "customer").select(key.alias("board")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN f ELSE CASE WHEN f % 2 = 0 THEN f || ':' || p ELSE f END END AS target FROM (SELECT s_suppkey, s_nationkey::VARCHAR AS f, (s_suppkey % 3)::VARCHAR AS p FROM supplier) WHERE (s_suppkey % 4 = 0 OR (p <> '2' AND (f % 2 <> 0 OR p = '1')))".replace("f %", "f::INT %"))
def x87_routed(spark, sf_dir):
    """Rows of common lists go to their part if that is enabled, to the list if they have none or it has no parts."""
    enabled = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(":1")).alias("board"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("f"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 3).cast("string")).alias("p"))
    return boards.route_rows(rows, enabled, "f", "p", ("2",)).select("s_suppkey", "target")


@query("""SELECT l_orderkey, arg_min(nullif(title, ''), l_suppkey * 100000 + l_partkey) FILTER (WHERE src <> 's2' AND title <> '') AS title, count(DISTINCT who) AS people, count(DISTINCT src) AS sources
FROM (SELECT l_orderkey, l_suppkey, l_partkey, 's' || (l_suppkey % 4) AS src, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 't' || l_partkey END AS title, 'p' || (l_partkey % 6) AS who FROM lineitem) GROUP BY l_orderkey""")
def x60_merged_metadata(spark, sf_dir):
    """What several sources say of an order, put together; one of them isn't trusted with titles."""
    i = table(spark, sf_dir, "lineitem")
    title = F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("l_partkey").cast("string")))
    parts = i.select("l_orderkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), title.alias("title"), F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 6).cast("string"))).alias("people"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("o"))
    out = boards.merge_metadata(parts, "l_orderkey", ("s2",), "o")
    return out.select("l_orderkey", "title", F.size("people").alias("people"), F.size("sources").alias("sources"))


@query("SELECT r_name AS scope, n_name AS name, substr(r_name, 1, 2) || '-' || (n_nationkey % 3) AS prefix FROM region JOIN nation ON n_regionkey = r_regionkey")
def x92_scope_prefixes(spark, sf_dir):
    """The prefixes of each scope, from nested boards."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).cast("string").alias("k"))).alias("children"))
    nested = table(spark, sf_dir, "region").join(n, "r_regionkey")
    return nested.select(F.col("r_name").alias("scope"), F.explode("children").alias("c")).select("scope", "c.name", F.concat(F.left("scope", F.lit(2)), F.lit("-"), "c.k").alias("prefix"))


@query("""WITH p AS (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS floor, count(*) OVER (PARTITION BY o_custkey) AS n FROM p WHERE o_orderstatus = first)
SELECT o_custkey, upper(sha1(o_orderkey::VARCHAR)) AS hash, o_orderpriority AS name, 'name_then_link' AS layout, o_orderkey % 60 AS size FROM f""")
def x57_thread(spark, sf_dir):
    """A whole thread read: posts of its author, links in them, and the name and size that stand before each."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("【name】："), "o_orderpriority", F.lit("<br>【size】："), (F.col("o_orderkey") % 60).cast("string"), F.lit("<br>magnet:?xt=urn:btih:"), F.sha1(k))
    piece = F.concat(F.lit('<div id="post_'), k, F.lit('"><a class="xi2">'), "o_orderstatus", F.lit('</a><td id="postmessage_'), k, F.lit('">'), body, F.lit("</td></div>"))
    html = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", piece)
    html = html.withColumn("page", pages.post_tree("html"))
    own = pages.author_posts(pages.posts(F.col("page")))
    text = pages.corpus(F.transform(own, lambda p: p["content"]), F.array().cast("array<string>"), "magnet:")
    lines = Scratch(spark, "thread").save(html.select("o_custkey", text.alias("t")).select("o_custkey", F.posexplode(F.split("t", "\n")).alias("at", "line")))
    labelled = lambda label: lines.where(F.col("line").startswith(f"【{label}】")).select("o_custkey", "at", F.regexp_extract("line", "】：(.*)", 1).alias(label))
    found = lines.select("o_custkey", "at", F.explode(links.magnet_links(F.col("line"))).alias("m")).select("o_custkey", "at", "m.hash")
    named = frames.named_links(labelled("name"), found, "o_custkey", "at", "name")
    sized = frames.named_links(labelled("size"), named.drop("layout"), "o_custkey", "at", "size")
    return sized.select("o_custkey", "hash", "name", "layout", F.col("size").cast("long").alias("size"))


@query("""WITH n AS (SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 2000), t AS (SELECT l_orderkey, min(l_returnflag) AS value FROM n GROUP BY l_orderkey), c AS (SELECT value, count(*) AS n FROM t GROUP BY value), s AS (SELECT value, round_even(n * (SELECT count(DISTINCT l_orderkey) FROM lineitem) / (SELECT sum(n) FROM c), 0)::BIGINT AS n FROM c)
SELECT value, (n + CASE WHEN value = (SELECT arg_max(value, (n, value)) FROM s) THEN (SELECT count(DISTINCT l_orderkey) FROM lineitem) - (SELECT sum(n) FROM s) ELSE 0 END)::BIGINT AS n FROM s""")
def a17_estimated_facet(spark, sf_dir):
    """A facet of the newest rows, scaled to all orders."""
    items = table(spark, sf_dir, "lineitem")
    newest = items.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").limit(2000)
    total = items.agg(F.countDistinct("l_orderkey")).first()[0]
    return facets.scale(newest.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("value")).groupBy("value").agg(F.count("*").alias("n")), total)


@query("""SELECT user_id, concat_ws(',', CASE WHEN count(DISTINCT event_type) * 4 < count(*) THEN 'few_names' END, CASE WHEN count(*) FILTER (WHERE event_type = before) * 5 > count(*) THEN 'runs' END, CASE WHEN count(*) FILTER (WHERE event_type = '') * 10 > count(*) THEN 'empty' END) AS issues
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 AND event_type = 'view' THEN '' ELSE event_type END AS event_type FROM events)) GROUP BY user_id""")
def a24_issues(spark, sf_dir):
    """What is wrong with the names of each batch."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") == "view"), "").otherwise(F.col("event_type")).alias("name"))
    return facets.name_issues(facets.judge_names(e, "user_id", "name", "event_id"), 0.25, 0.2, 0.1).select("user_id", F.array_join("issues", ",").alias("issues"))


@query("SELECT page_id, (url LIKE '%.example.org/%' OR url LIKE '%.example.net/%') AND NOT url LIKE '%/es/%' AS allowed FROM pages")
def x17_allowed(spark, sf_dir):
    """Addresses that may be fetched: of listed hosts or below them, not private, and not of some paths."""
    return table(spark, sf_dir, "pages").select("page_id", links.is_allowed(F.col("url"), ["example.org", "example.net"], r"/es/").alias("allowed"))
