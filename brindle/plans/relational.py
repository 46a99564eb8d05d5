"""Registered queries of threads, facets, queues and merges on the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import facets, merge, queue, ranking, sampling, threads
from brindle.plans.catalogue import query, table


def _items(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *columns)


@query("""SELECT l_orderkey, m.l_shipdate AS l_shipdate, m.l_extendedprice AS l_extendedprice FROM (
SELECT l_orderkey, max({'l_shipdate': l_shipdate, 'l_extendedprice': l_extendedprice}) AS m FROM lineitem GROUP BY l_orderkey)
ORDER BY m.l_shipdate DESC, m.l_extendedprice DESC, l_orderkey LIMIT 50 OFFSET 20""")
def g10_thread_page(spark, sf_dir):
    """The page of fifty orders after the first twenty, newest item first."""
    return threads.thread_page(_items(spark, sf_dir, "l_shipdate", "l_extendedprice"), "l_orderkey", ["l_shipdate", "l_extendedprice"], 50, 20)


@query("""SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY seen, l_partkey) AS place
FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS seen FROM lineitem GROUP BY l_orderkey, l_partkey)""")
def g11_assemble(spark, sf_dir):
    """Each order's distinct parts, numbered as they are first seen."""
    return threads.ordered_values(_items(spark, sf_dir, "l_partkey", "l_linenumber"), "l_orderkey", "l_partkey", ["l_linenumber"])


@query("""SELECT o_custkey, arg_max(o_orderpriority, (score, o_orderkey)) AS chosen, max(score) AS score FROM (
SELECT *, CASE WHEN p = '' THEN 0 ELSE 10 + CASE WHEN p LIKE '%-%' THEN 20 ELSE 0 END + 5 + CASE WHEN o_orderstatus <> '' THEN 2 ELSE 0 END END AS score
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS p FROM orders)) GROUP BY o_custkey""")
def g12_board_choice(spark, sf_dir):
    """Each customer's most telling pair of status and priority; later orders win ties."""
    p = F.expr("case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then substr(o_orderpriority, 3) else o_orderpriority end")
    scored = table(spark, sf_dir, "orders").withColumn("score", threads.board_score(F.col("o_orderstatus"), p))
    return scored.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("score", "o_orderkey")).alias("chosen"), F.max("score").alias("score"))


@query("""SELECT o_custkey, o_orderpriority, place FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY min((o_orderdate, o_orderkey)), o_orderpriority) AS place
FROM orders GROUP BY o_custkey, o_orderpriority) WHERE place <= 3""")
def g14_merge_capped(spark, sf_dir):
    """The first three distinct priorities of each customer."""
    return threads.ordered_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], 3)


@query("""SELECT regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') AS name_key, arg_min(p_name || ' ' || p_brand, p_partkey) AS display, count(*) AS n FROM part GROUP BY name_key""")
def g17_by_name(spark, sf_dir):
    """Parts by normalised name, each with the display name of its first."""
    key = F.regexp_replace(F.lower(F.concat("p_name", "p_brand")), "[^a-z0-9]", "")
    return table(spark, sf_dir, "part").groupBy(key.alias("name_key")).agg(F.min_by(F.concat_ws(" ", "p_name", "p_brand"), "p_partkey").alias("display"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN left(c_name, 17) ELSE c_name END AS name FROM customer),
p AS (SELECT c_mktsegment, name, left(name, i) AS start FROM n CROSS JOIN range(4, 18) r(i) WHERE i < length(name)),
m AS (SELECT n.c_mktsegment, n.name, min(p.name) AS longer FROM n JOIN p ON n.c_mktsegment = p.c_mktsegment AND n.name = p.start GROUP BY ALL HAVING count(*) = 1)
SELECT n.c_mktsegment, n.name, coalesce(longer, n.name) AS kept_name FROM n LEFT JOIN m ON n.c_mktsegment = m.c_mktsegment AND n.name = m.name""")
def g18_truncated(spark, sf_dir):
    """Names of all customers, some cut short, joined with the one longer name they start."""
    c = table(spark, sf_dir, "customer")
    return threads.merge_truncated(c.select("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.left("c_name", F.lit(17))).otherwise(F.col("c_name")).alias("name")), "c_mktsegment", "name")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus = 'P', o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def g20_primary(spark, sf_dir):
    """Each customer's main order: one of status P, else the dearest."""
    return threads.primary(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey", "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey")


@query("""SELECT event_id, user_id, coalesce(mark, -1) AS mark FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS mark FROM events) WHERE event_type = 'purchase'""")
def x56_position_join(spark, sf_dir):
    """Purchases with the last signup before them."""
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("mark"))
    return threads.last_before(marks, e.where("event_type = 'purchase'").select("user_id", "event_id"), "user_id", "event_id", "mark").select("event_id", "user_id", F.coalesce("mark", F.lit(-1)).alias("mark"))


@query("""SELECT DISTINCT coalesce(CASE WHEN regexp_extract(url, '^[a-z]+://(m\\.)', 1) <> '' AND regexp_extract(url, 'tid=([0-9]+)', 1) <> '' THEN 'tid:m:' || regexp_extract(url, 'tid=([0-9]+)', 1) END, 'url:' || nullif(trim(url), ''), 'hash:' || upper(md5(html))) AS k,
coalesce(nullif(trim(url), ''), upper(md5(html))) AS plain FROM (SELECT html, CASE WHEN page_id % 5 = 0 THEN ' ' WHEN page_id % 3 = 0 THEN url || '&tid=' || (page_id % 7) ELSE url END AS url FROM pages)""")
def g01_thread_keys(spark, sf_dir):
    """Two kinds of thread keys of addresses with and without numbers."""
    url = F.expr("case when page_id % 5 = 0 then ' ' when page_id % 3 = 0 then concat(url, '&tid=', page_id % 7) else url end")
    p = table(spark, sf_dir, "pages").select(url.alias("url"), F.md5("html").alias("h")).withColumn("forum", F.when(text.is_mobile(F.col("url")), "m").otherwise(""))
    return p.select(threads.thread_key(F.col("url"), F.col("h"), F.col("forum"), "tid", ("m",)).alias("k"), threads.thread_key(F.col("url"), F.col("h"), variant="plain").alias("plain")).distinct()


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE trim(event_type) <> '' GROUP BY event_type ORDER BY n DESC, reason LIMIT 80")
def a10_reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").where("btrim(event_type) <> ''").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(80)


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> ''")
def a12_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_brand <> ''").select("p_brand", "p_type").distinct()


@query("SELECT count(DISTINCT nullif(trim(source), '')) + count(*) FILTER (WHERE coalesce(trim(source), '') = '') AS threads, count(*) AS n FROM documents")
def a13_thread_total(spark, sf_dir):
    """Distinct keys of rows that have one, and rows without one."""
    key = F.nullif(F.btrim("source"), F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)).alias("threads"), F.sum("n").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, min(l_returnflag) a, min(l_linestatus) b, min(l_suppkey % 3)::VARCHAR c FROM lineitem GROUP BY l_orderkey)
SELECT 'flag' AS facet, a AS value, count(*) AS n FROM t GROUP BY a UNION ALL SELECT 'status', b, count(*) FROM t GROUP BY b UNION ALL SELECT 'source', c, count(*) FROM t GROUP BY c""")
def a16_facets(spark, sf_dir):
    """Three facets of orders in one pass."""
    return facets.two_level(table(spark, sf_dir, "lineitem"), "l_orderkey", {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "source": F.col("l_suppkey") % 3})


@query("""WITH b AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand), s AS (SELECT value, round_even(n * 777 / (SELECT sum(n) FROM b), 0)::BIGINT AS n FROM b)
SELECT value, (n + CASE WHEN value = (SELECT arg_max(value, (n, value)) FROM s) THEN 777 - (SELECT sum(n) FROM s) ELSE 0 END)::BIGINT AS n FROM s""")
def a18_facet_scale(spark, sf_dir):
    """Brands scaled to a total of 777."""
    return facets.scale(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")), 777)


@query("SELECT split_part(p_brand, '#', 1) || left(split_part(p_brand, '#', 2), 1) AS value, count(*) AS n FROM part GROUP BY 1")
def a19_roll_up(spark, sf_dir):
    """Brands rolled up to the first digit of their number."""
    name = F.expr("concat(split_part(p_brand, '#', 1), left(split_part(p_brand, '#', 2), 1), case when length(p_brand) > 7 then concat(' · ', p_brand) else '' end)")
    return facets.roll_up(table(spark, sf_dir, "part").groupBy(name.alias("value")).agg(F.count("*").alias("n")))


@query("""SELECT user_id % 10 AS bucket, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY bucket""")
def a23_pivot(spark, sf_dir):
    """Kinds of events by bucket of users."""
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return e.groupBy("bucket").pivot("event_type", ["click", "error", "view"]).agg(F.count("event_id")).na.fill(0)


@query("""SELECT user_id, count(*) AS n_rows, count(DISTINCT event_type) AS n_names, count(*) FILTER (WHERE event_type = before) AS n_same, 0.0::DOUBLE AS empty_share
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id""")
def a24_judge(spark, sf_dir):
    return facets.judge_names(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""SELECT l_orderkey, CASE WHEN count(*) > 1 THEN sum(l_quantity) ELSE max(l_extendedprice) END AS size FROM lineitem GROUP BY l_orderkey""")
def a25_total_size(spark, sf_dir):
    """The sum of an order's sizes, or the own size of a single row."""
    return _items(spark, sf_dir, "l_quantity", "l_extendedprice").groupBy("l_orderkey").agg(F.when(F.count("*") > 1, F.sum("l_quantity")).otherwise(F.max("l_extendedprice")).alias("size"))


@query("SELECT coalesce(max(event_id), 0) AS latest, count(*) AS n FROM events WHERE event_type = 'error'")
def a27_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("latest"), F.count("*").alias("n"))


@query("""SELECT prefix, p_partkey FROM (SELECT prefix, p_partkey, row_number() OVER (PARTITION BY prefix ORDER BY TRY_CAST(split_part(p_brand, '#', 2) AS INT) NULLS LAST, p_partkey) AS rn
FROM (SELECT unnest(['red', 'blue', 'hot', 'none']) AS prefix) LEFT JOIN part ON starts_with(p_name, prefix || ' ')) WHERE rn = 1 AND p_partkey IS NOT NULL""")
def j04_prefix_top1(spark, sf_dir):
    """The first part of each prefix by the number of its brand; the prefixes are an argument and so broadcast."""
    prefixes = spark.createDataFrame([(p,) for p in ("red", "blue", "hot", "none")], "prefix string")
    hits = table(spark, sf_dir, "part").withColumn("prefix", F.split_part("p_name", F.lit(" "), F.lit(1))).join(F.broadcast(prefixes), "prefix", "left_semi")
    return ranking.top_per_key(hits, ["prefix"], [F.asc_nulls_last(F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int")), F.col("p_partkey")]).select("prefix", "p_partkey")


@query("""SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), c_mktsegment) AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def j12_update_from(spark, sf_dir):
    """A column filled from another table where it is blank."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), "c_mktsegment").alias("status"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.u <> '' AND b.u <> '' AND a.u <> b.u THEN a.u ELSE coalesce(b.u, a.u) END AS u,
CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.u <> '' AND b.u <> '' AND a.u <> b.u THEN a.t WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN coalesce(nullif(b.t, ''), a.t) ELSE coalesce(b.t, a.t) END AS t
FROM (SELECT o_orderkey k, o_orderpriority u, o_orderstatus t FROM orders WHERE o_totalprice > 100000) a FULL JOIN (SELECT o_orderkey k, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE '1-URGENT' END u, CASE o_orderkey % 5 WHEN 0 THEN '' ELSE 'N' END t FROM orders WHERE o_totalprice <= 250000) b ON a.k = b.k""")
def k02_owned_merge(spark, sf_dir):
    """A merge in which a row stays as it is if both name different owners."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_totalprice > 100000").selectExpr("o_orderkey k", "o_orderpriority u", "o_orderstatus t")
    new = o.where("o_totalprice <= 250000").selectExpr("o_orderkey k", "case o_orderkey % 4 when 0 then '' else '1-URGENT' end u", "case o_orderkey % 5 when 0 then '' else 'N' end t")
    return merge.merge(old, new, "k", {"u": merge.keep_new, "t": merge.keep_filled}, merge.other_owner("u"))


@query("""WITH f AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 10)),
o AS (SELECT p_brand AS name, min(p_partkey) AS id FROM part WHERE p_partkey < 10 GROUP BY p_brand)
SELECT name, id FROM o UNION ALL SELECT name, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name) FROM f""")
def k04_insert_absent(spark, sf_dir):
    """Names that aren't there yet get the ids after the greatest."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey < 10").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    return merge.insert_absent(old, p.where("p_size > 10").select(F.col("p_brand").alias("name"), F.lit(0).alias("x")), "name", "id")


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT') OR l_partkey % 3 = 0
OR NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_partkey % 3 = 0)""")
def k07_keep_set(spark, sf_dir):
    """Urgent orders keep only some parts; orders that keep none of them stay whole."""
    items = _items(spark, sf_dir, "l_partkey", "l_quantity")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.keep_only(items, items.where("l_partkey % 3 = 0").join(urgent, "l_orderkey", "left_semi"), "l_orderkey", "l_partkey")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'manual: ' || event_type ELSE event_type END AS outcome, CASE WHEN event_id % 3 = 0 THEN 'a,reviewed' WHEN event_id % 3 = 1 THEN 'a' ELSE 'a,reviewed' END AS tags FROM events""")
def k12_review(spark, sf_dir):
    """A review is set on a third of the rows, and set and taken back on another."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("outcome"), F.when(F.col("event_id") % 3 == 2, F.array(F.lit("a"), F.lit("reviewed"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    on = merge.review(F.col("outcome"), F.col("tags"), "manual: ", "reviewed")
    e = e.withColumns({"o1": on[0], "t1": on[1]})
    off = merge.review(F.col("o1"), F.col("t1"), "manual: ", "reviewed", undo=True)
    m = F.col("event_id") % 3
    return e.select("event_id", F.when(m == 0, F.col("o1")).when(m == 1, off[0]).otherwise(F.col("outcome")).alias("outcome"), F.array_join(F.when(m == 0, F.col("t1")).when(m == 1, off[1]).otherwise(F.col("tags")), ",").alias("tags"))


@query("""SELECT DISTINCT l_partkey AS url FROM lineitem WHERE l_quantity > 30 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def k13_enqueue(spark, sf_dir):
    """Keys that the queue doesn't hold yet, each once."""
    held = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("url"))
    return queue.enqueue(held, table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("url"), "l_quantity"), "url").select("url")


@query("""WITH e AS (SELECT user_id, event_id, ts, value, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skip' WHEN 'error' THEN 'retry' END AS kind FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
m AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE kind IN ('done', 'skip')), -1) AS ended FROM e GROUP BY user_id),
s AS (SELECT e.user_id, count(*) FILTER (WHERE kind = 'retry') AS fails, arg_max(kind, event_id) AS last, arg_max(ts + to_microseconds(round(greatest(30.0, value) * 1000000)::BIGINT), event_id) AS until FROM e JOIN m ON e.user_id = m.user_id AND event_id >= ended GROUP BY e.user_id)
SELECT user_id, fails, CASE WHEN last = 'done' THEN 'done' WHEN last = 'skip' THEN 'skipped' WHEN fails >= 3 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN last = 'retry' AND fails < 3 THEN until END AS retry_after FROM s""")
def k15_fold_log(spark, sf_dir):
    """Each user's queue state after all events."""
    kind = F.expr("case event_type when 'purchase' then 'done' when 'signup' then 'skip' when 'error' then 'retry' end")
    return queue.fold_log(table(spark, sf_dir, "events").withColumn("kind", kind).where("kind is not null"), "user_id", "event_id", "kind", "ts", "value")


@query("""WITH n AS (SELECT l_partkey AS code, max(l_linenumber) AS priority, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) FILTER (WHERE l_returnflag <> 'N') AS mode, bool_or(l_discount > 0.08) AS force FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey)
SELECT coalesce(n.code, p_partkey) AS code, greatest(n.priority, p_size) AS priority, coalesce(n.mode, p_type) AS mode, coalesce(n.force, false) AS force FROM n FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON n.code = p_partkey""")
def k19_batch(spark, sf_dir):
    """Codes enqueued in a batch over those that wait."""
    held = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("priority"), F.col("p_type").alias("mode"), F.lit(False).alias("force"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("priority"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("mode"), (F.col("l_discount") > 0.08).alias("force"), "l_shipdate", "l_orderkey", "l_linenumber")
    return queue.enqueue_codes(held, new, ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, CASE WHEN rn <= 100 THEN 'running' ELSE status END AS status, CASE WHEN rn <= 100 THEN 1 ELSE 0 END AS attempts FROM (
SELECT o_orderkey, status, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY o_totalprice DESC, o_orderkey) END AS rn FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'done' END AS status FROM orders))""")
def k20_claim(spark, sf_dir):
    """The hundred dearest waiting orders set to running."""
    q = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.expr("case o_orderstatus when 'O' then 'pending' else 'done' end").alias("status"), F.lit(0).alias("attempts"))
    return queue.claim(q, 100, "o_orderkey", [F.desc("o_totalprice")]).select("o_orderkey", "status", "attempts")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 600 SECOND THEN 'pending' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events""")
def k21_reclaim(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"))
    return queue.reclaim(q, F.to_timestamp(F.lit("2024-01-05 00:00:00")), 600, "ts").select("event_id", "status")


@query("""SELECT code, max(event_id) FILTER (WHERE event_type = 'error') AS event_id FROM (SELECT *, user_id || '/' || floor(value / 20)::INT AS code FROM events) GROUP BY code HAVING NOT bool_or(event_type IN ('view', 'click')) AND count(*) FILTER (WHERE event_type = 'error') > 0""")
def k22_retry_failed(spark, sf_dir):
    """The latest failed row of each user and range of values that has none waiting."""
    status = F.expr("case event_type when 'view' then 'pending' when 'click' then 'running' else event_type end")
    code = F.concat_ws("/", "user_id", F.floor(F.col("value") / 20).cast("int"))
    return queue.retryable(table(spark, sf_dir, "events").withColumns({"status": status, "code": code}), "code", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id >= (SELECT min(event_id) FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 501))")
def k25_retention(spark, sf_dir):
    """The newest rows of a log; the cut is one id."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    cut = e.select("event_id").orderBy(F.desc("event_id")).limit(501).agg(F.min("event_id").alias("cut"))
    return e.crossJoin(F.broadcast(cut)).where("event_id >= cut").drop("cut")


@query("""SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN NULL ELSE c_nationkey END AS parent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2""")
def k27_dangling(spark, sf_dir):
    """Children whose parent is gone have none."""
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("parent"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("parent"), "left").select("c_custkey", "parent")


@query("""SELECT event_id FROM events WHERE (event_type <> 'error' OR ts + to_microseconds(round(value * 1000000)::BIGINT) <= TIMESTAMP '2024-01-03 00:00:00') AND NOT (event_type = 'error' AND value > 50)""")
def p17_queue_state(spark, sf_dir):
    """Rows that are due and not abnormal."""
    bad = F.col("event_type") == "error"
    until = F.when(bad, F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)")))
    q = table(spark, sf_dir, "events").select("event_id", until.alias("retry_after"), F.lit(0).alias("fail_count"), F.when(bad & (F.col("value") > 50), "slow").alias("last_error"))
    return q.where(queue.is_ready(F.to_timestamp(F.lit("2024-01-03 00:00:00"))) & ~queue.is_abnormal()).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '%42%' OR o_orderpriority ILIKE '%42%' OR o_custkey = 42")
def p18_queue_search(spark, sf_dir):
    """Orders of which any column holds a text."""
    return table(spark, sf_dir, "orders").where(text.contains_any(["o_custkey", "o_orderpriority"], "42")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE <= DATE '1998-01-01' - 30 OR o_orderkey % 9 = 0")
def p25_age_gate(spark, sf_dir):
    """Orders of an age, or of unknown age."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("posted"))
    return o.where(queue.old_enough(F.col("posted"), F.lit("1998-01-01"), 30)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE split_part(p_brand, '#', 2) IN ('1', '12') OR p_brand = 'Brand#7'")
def p23_whitelist(spark, sf_dir):
    """Parts whose whole key or second part of it is listed."""
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#7") | F.split_part("p_brand", F.lit("#"), F.lit(2)).isin("1", "12")).select("p_partkey")


@query("SELECT o_orderkey, has_more FROM (SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 150 AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100)")
def t03_paging(spark, sf_dir):
    """A page, and whether there are more."""
    return ranking.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 100).select("o_orderkey", "has_more")


@query("SELECT p.pos AS pos, o_orderkey, o_totalprice FROM orders JOIN (SELECT unnest([7, 3, 99]) AS k, unnest([0, 1, 2]) AS pos) p ON o_orderkey = k")
def t08_input_order(spark, sf_dir):
    """Rows by their place in a given list."""
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 99)], "pos int, o_orderkey long")
    return table(spark, sf_dir, "orders").join(F.broadcast(wanted), "o_orderkey").select("pos", "o_orderkey", "o_totalprice").orderBy("pos")


@query("""SELECT p_brand, p_type, p_partkey FROM part ORDER BY CAST(split_part(p_brand, '#', 2) AS INT), p_size, p_partkey LIMIT 200""")
def t09_code_order(spark, sf_dir):
    """The first two hundred codes by the numbers in them."""
    first, second = text.code_numbers(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").orderBy(first, second, "p_partkey").limit(200).select("p_brand", "p_type", "p_partkey")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id) AS rn FROM events) WHERE rn > 1""")
def w01_duplicates(spark, sf_dir):
    """Rows that a deletion of all but the best of each user takes."""
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(order)).where("rn > 1").select("user_id", "event_id")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events), s AS (SELECT user_id, day, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM d GROUP BY ALL)
SELECT user_id, day, kinds = lag(kinds) OVER (PARTITION BY user_id ORDER BY day) AS same FROM s""")
def w04_same_set(spark, sf_dir):
    """Whether a user's day has the same kinds of events as the day before."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return s.select("user_id", "day", (F.col("kinds") == F.lag("kinds").over(Window.partitionBy("user_id").orderBy("day"))).alias("same"))


@query("SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING), 6) AS failure_rate FROM events")
def z03_failure_rate(spark, sf_dir):
    """The share of errors among a user's last ten events."""
    return queue.failure_rate(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", 10).select("event_id", F.round("failure_rate", 6).alias("failure_rate"))


@query("SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 40")
def z06_tail(spark, sf_dir):
    return queue.tail(table(spark, sf_dir, "events").select("event_id"), "event_id", 100, 40)


@query("SELECT user_id, ts::DATE AS day, count(*) AS used, greatest(0, 3 - count(*)) AS \"left\" FROM events GROUP BY user_id, ts::DATE")
def z11_daily_left(spark, sf_dir):
    return queue.daily_left(table(spark, sf_dir, "events"), "user_id", "ts", 3)


@query("SELECT 150 AS n, 150 AS different, 0 AS excluded, true AS within, true AS same UNION ALL SELECT (SELECT count(*) FROM range(1, 401) WHERE range NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)), (SELECT count(*) FROM range(1, 401) WHERE range NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)), 0, true, true")
def x75_sample(spark, sf_dir):
    """What holds of two samples of ids: their size, that ids differ, that none is excluded, their range, and that they come again."""
    held, out = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey")), None
    for high, n in ((100000, 150), (400, 400)):
        drawn, again = (sampling.sample_ids(held, "o_custkey", 1, high, n) for _ in range(2))
        facts = drawn.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("different"), F.bool_and(F.col("o_custkey").between(1, high)).alias("within"))
        hit = drawn.join(held, "o_custkey", "left_semi").agg(F.count("*").alias("excluded"))
        same = drawn.join(again, "o_custkey", "left_anti").agg((F.count("*") == 0).alias("same"))
        row = facts.crossJoin(hit).crossJoin(same).select("n", "different", "excluded", "within", "same")
        out = row if out is None else out.union(row)
    return out
