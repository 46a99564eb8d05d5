"""Registered queries of frames, layouts and verdicts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import classify, clean, links
from brindle.operators import frames, ranking
from brindle.plans.catalogue import query, table, tasks_of

_ASSETS = "SELECT l_orderkey AS t, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'n' || (l_linenumber % 3) END AS name, 'l' || l_partkey AS link, l_quantity::BIGINT AS size, CASE WHEN l_suppkey % 4 > 0 THEN 'i' || (l_partkey % 5) END AS image, CASE WHEN l_suppkey % 7 = 0 THEN 40 ELSE 0 END AS stated FROM lineitem"
_FILLED = f"""SELECT t, name, count(DISTINCT link) AS n_links, count(DISTINCT image) AS n_images, CASE WHEN max(stated) > 3 THEN max(stated) WHEN (SELECT sum(m) FROM (SELECT max(size) AS m FROM ({_ASSETS}) y WHERE y.t = x.t AND y.name = x.name GROUP BY link)) > 3 THEN (SELECT sum(m) FROM (SELECT max(size) AS m FROM ({_ASSETS}) y WHERE y.t = x.t AND y.name = x.name GROUP BY link)) ELSE 0 END::BIGINT AS size,
array_to_string(list_sort(list_distinct(list(image) FILTER (WHERE image IS NOT NULL))), ' ') AS images FROM ({_ASSETS}) x GROUP BY t, name"""


def _filled(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("l_linenumber") % 3).cast("string")))
    image = F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("i"), (F.col("l_partkey") % 5).cast("string")))
    assets = i.select(F.col("l_orderkey").alias("t"), name.alias("name"), F.concat(F.lit("l"), F.col("l_partkey").cast("string")).alias("link"), F.col("l_quantity").cast("long").alias("size"), image.alias("image"), F.when(F.col("l_suppkey") % 7 == 0, 40).otherwise(0).cast("long").alias("stated"))
    return frames.fill(assets, "t", "name", "link", "size", "image", "stated", 3, tasks=tasks_of(i))


@query(f"SELECT t, name, n_links, n_images, size, coalesce(images, '') AS images, (name <> '')::INT + 1 + (size > 0)::INT AS filled FROM ({_FILLED})")
def x74_filled_rows(spark, sf_dir):
    """What each name of an order has: links, images, a size, and how many of its slots are filled."""
    return _filled(spark, sf_dir).select("t", "name", "n_links", "n_images", "size", F.array_join("images", " ").alias("images"), F.size("slots").alias("filled"))


@query(f"""WITH f AS MATERIALIZED ({_FILLED}), th AS (SELECT o_orderkey AS t, 'N' || (o_orderkey % 3) AS title, CASE WHEN o_custkey % 2 = 0 THEN 2 + o_orderkey % 3 END AS expected, (o_orderkey % 60)::BIGINT AS total, o_orderkey % 5 AS links FROM orders),
p AS (SELECT f.t, count(*) AS n, sum(n_links) AS n_links, count(*) FILTER (WHERE name = '') AS unnamed, count(*) FILTER (WHERE name = lower(title)) AS as_title, count(*) FILTER (WHERE size = 0) AS unsized, sum(size) AS s, max(size) AS mx, count(DISTINCT coalesce(images, '')) AS sets, min(n_images) AS li FROM f JOIN th USING (t) GROUP BY f.t)
SELECT th.t, CASE WHEN n IS NULL THEN 'no_link' WHEN n = 1 THEN 'single' ELSE 'multi' END AS kind, concat_ws(',', CASE WHEN n IS NULL THEN 'no_link' END, CASE WHEN unnamed > 0 THEN 'unnamed' END, CASE WHEN as_title > 0 AND n > 1 THEN 'title_as_name' END, CASE WHEN n < expected THEN 'too_few' END, CASE WHEN n_links < links THEN 'links_missing' END) AS hard,
concat_ws(',', CASE WHEN unsized > 0 THEN 'unsized' END, CASE WHEN total > 0 AND unsized = 0 AND abs(s - total) > total * 0.15::DOUBLE THEN 'sum_off' END, CASE WHEN total > 0 AND n > 1 AND mx = total THEN 'echo' END) AS soft, concat_ws(',', CASE WHEN n > 1 AND sets = 1 AND li > 0 THEN 'shared_images' END, CASE WHEN li = 0 THEN 'no_images' END) AS tags FROM th LEFT JOIN p USING (t)""")
def x74_frame(spark, sf_dir):
    """Frames of orders: what is wrong with the names, counts, links and sizes of each."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    threads = o.select(k.alias("t"), F.concat(F.lit("N "), (k % 3).cast("string")).alias("title"), F.when(F.col("o_custkey") % 2 == 0, 2 + k % 3).alias("expected"), (k % 60).alias("total"), (k % 5).alias("links"))
    out = frames.validate(_filled(spark, sf_dir), threads, "t", "name", "title", "expected", "total", "links")
    return out.select("t", "kind", *[F.array_join(c, ",").alias(c) for c in ("hard", "soft", "tags")])


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase', 'error')), f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS names, count(*) FILTER (WHERE event_type = 'purchase') AS links, min(event_id) FILTER (WHERE event_type = 'signup') AS first, max(event_id) FILTER (WHERE event_type = 'signup') AS last, min(event_id) FILTER (WHERE event_type = 'purchase') AS link, count(*) FILTER (WHERE event_type = 'error') AS sizes FROM e GROUP BY user_id),
l AS (SELECT *, CASE WHEN names = 0 AND sizes >= 2 THEN 'size_then_link' WHEN names = 0 AND links >= 48 THEN 'no_name_pack' WHEN names = 0 THEN 'no_name' WHEN names > 1 AND last < link THEN 'names_then_links' WHEN link < first THEN 'link_then_name' ELSE 'name_then_link' END AS layout FROM f WHERE links > 0),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE event_type = 'signup'), c AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER w AS before, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS nth FROM e WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT c.user_id, c.event_id, layout, coalesce(n.event_id, -1) AS name FROM c JOIN l ON l.user_id = c.user_id LEFT JOIN n ON n.user_id = c.user_id AND n.k = CASE layout WHEN 'names_then_links' THEN least(nth, names) WHEN 'link_then_name' THEN least(before + 1, names) ELSE before END WHERE event_type = 'purchase'""")
def x56_layouts(spark, sf_dir):
    """Purchases with the signup that they belong to by the layout of each user's events."""
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "event_id")
    out = frames.named_links(of("signup").withColumn("name", F.col("event_id")), of("purchase"), "user_id", "event_id", "name", of("error"))
    return out.select("user_id", "event_id", "layout", F.coalesce("name", F.lit(-1)).alias("name"))


@query("""SELECT page_id, CASE WHEN length(html) < 900 THEN 'retry' WHEN url LIKE '%m.%' THEN 'skipped' WHEN html LIKE '%the %' THEN 'import' WHEN url LIKE '%page=%' THEN 'stub' ELSE 'need_attachments' END AS outcome, CASE WHEN length(html) < 900 THEN 'empty' WHEN url LIKE '%m.%' THEN 'mobile' WHEN html LIKE '%the %' THEN 'ok' WHEN url LIKE '%page=%' THEN 'list' ELSE 'nothing found' END AS reason FROM pages""")
def x31_verdict(spark, sf_dir):
    """Verdicts on pages by the first of some gates that holds."""
    html, url = F.col("html"), F.col("url")
    gates = [("retry", "empty", F.length(html) < 900), ("skipped", "mobile", url.contains("m.")), ("import", "ok", html.contains("the ")), ("stub", "list", url.contains("page="))]
    return table(spark, sf_dir, "pages").select("page_id", classify.verdict(gates, "need_attachments", "nothing found").alias("v")).select("page_id", "v.outcome", "v.reason")


@query("""SELECT code, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT 'https://' || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END || '.example/' || (p_size % 4)))[1:6], ' ') AS covers FROM (SELECT *, 'BRAND-' || lpad(split_part(p_brand, '#', 2), 3, '0') AS code FROM part) GROUP BY code""")
def x59_code_index(spark, sf_dir):
    """An index of codes: the rows that name each, and its covers in the order of their hosts."""
    code = F.concat(F.lit("see brand"), F.lpad(F.split_part("p_brand", F.lit("#"), F.lit(2)), 3, "0"))
    cover = F.concat(F.lit("https://"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"), F.lit(".example/"), (F.col("p_size") % 4).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(links.codes(code, "brand")).alias("code"), cover.alias("cover"))
    per = rows.groupBy("code").agg(F.countDistinct("p_partkey").alias("n"), F.array_sort(F.collect_set("cover")).alias("c"))
    return per.select("code", "n", F.array_join(links.by_host(F.col("c"), ["a.example", "b.example"], 6), " ").alias("covers"))


@query("SELECT upper(sha1(p_name)) AS hash, min(p_name) AS title, max(p_size)::BIGINT AS size, count(*) AS n FROM part GROUP BY 1")
def x84_by_hash(spark, sf_dir):
    """Titles and sizes by the hash of a link."""
    link = F.concat(F.lit("magnet:?xt=urn:btih:"), F.sha1("p_name"), F.lit("&xl="), F.col("p_size").cast("string"))
    found = table(spark, sf_dir, "part").select("p_name", F.explode(links.magnet_links(link)).alias("m"))
    return found.groupBy("m.hash").agg(F.min("p_name").alias("title"), F.max("m.size").alias("size"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ed' WHEN 1 THEN 'largest' ELSE 'first' END AS chosen FROM part")
def x49_primary(spark, sf_dir):
    """The main link: an archive, else the largest, else, where none has a size, the first."""
    kind = F.col("p_partkey") % 3
    one = lambda name, size: F.struct(F.lit(name).alias("name"), size.cast("long").alias("size"))
    found = F.array(one("first", F.lit(0)), one("largest", F.when(kind == 2, 0).otherwise(F.col("p_size") + 5)), F.when(kind == 0, one("ed.zip", F.lit(1))).otherwise(one("other", F.lit(0))))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(links.primary(found)["name"], F.lit(".zip"), F.lit("")).alias("chosen"))


@query("SELECT p_partkey, 'magnet:?xt=urn:btih:' || upper(sha1(p_name)) AS link FROM part")
def x42_repaired(spark, sf_dir):
    """Links that were written with full-width signs, blanks and invisible characters, repaired by a table of rules."""
    broken = F.concat(F.lit("magnet：？xt＝urn:btih: "), F.regexp_replace(F.upper(F.sha1("p_name")), "(.{10})", "$1​"))
    return table(spark, sf_dir, "part").select("p_partkey", clean.repaired(broken, [("[​­]", ""), ("：", ":"), ("？", "?"), ("＝", "="), (r"btih:\s+", "btih:")]).alias("link"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'han' ELSE 'latin' END AS script FROM part")
def x43_clean_titles(spark, sf_dir):
    """Titles without what sources put behind them, and their script."""
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " - Site One").when(F.col("p_partkey") % 3 == 1, ".mp4").otherwise(" [1080p]"))
    rules = [(r"\s+-\s+Site One$", ""), (r"(?i)\.(mp4|mkv)$", ""), (r"\s*\[\d+p\]$", "")]
    return table(spark, sf_dir, "part").select("p_partkey", clean.repaired(title, rules).alias("title"), clean.script(F.when(F.col("p_partkey") % 2 == 0, "片名").otherwise(F.col("p_name"))).alias("script"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN 'Title ' || p_partkey ELSE left(upper(md5(p_name)), 8) END AS name FROM part")
def x41_sub_names(spark, sf_dir):
    """Names of parts: their own, a label of the description, the title, or the hash; weak and technical ones don't count."""
    m = F.col("p_partkey") % 4
    h = F.upper(F.md5("p_name"))
    own = F.when(m == 0, F.col("p_name")).when(m == 1, "IMG_0001").otherwise("★")
    label = F.when(m == 1, F.col("p_type"))
    title = F.when(m == 2, F.concat(F.lit("Title "), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", classify.resolved_name([own, label, title], h, r"(?i)^(img|video|dsc)[_-]?\d+$").alias("name"))


@query("""WITH r AS (SELECT o_orderstatus AS status, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
q AS (SELECT status, n, min(v) FILTER (WHERE place = round_even((n - 1) * 0.1, 0)) AS low, min(v) FILTER (WHERE place = round_even((n - 1) * 0.9, 0)) AS high FROM r GROUP BY status, n)
SELECT status, round(CASE WHEN n < 100 THEN 0 ELSE low - (high - low) * 0.5 END, 4) AS low, round(CASE WHEN n < 100 THEN 1 ELSE high + (high - low) * 0.5 END, 4) AS high FROM q""")
def a22_plan(spark, sf_dir):
    """The window around the outer quantiles of the prices of each status, and a fallback where there are few."""
    orders, out = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("v")), None
    for status in [r[0] for r in orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]:
        low, high = ranking.spread_plan(orders.where(F.col("o_orderstatus") == status), "v", [0.1, 0.5, 0.9], 100, (0.0, 1.0), 0.5)
        one = spark.range(1).select(F.lit(status).alias("status"), F.round(F.lit(low), 4).alias("low"), F.round(F.lit(high), 4).alias("high"))
        out = one if out is None else out.union(one)
    return out
