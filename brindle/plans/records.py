"""Registered queries of deletions, upserts, requeueing, filters, orders and joins, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import classify, links, text
from brindle.functions.classify import Rule
from brindle.operators import queue, ranking, records, threads
from brindle.plans.catalogue import query, table
from brindle.session import Scratch
from brindle.sources.tables import Catalog


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY l_orderkey")
def k06_delete_cascade(spark, sf_dir):
    """Rows that are left after deletions of orders and of parts reach the items of both."""
    items, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    left = records.delete_keys({"items": (items, "l_orderkey")}, orders.where("o_orderstatus = 'P'"), "o_orderkey")["items"]
    left = records.delete_keys({"items": (left, "l_partkey")}, part.where("p_type = 'PROMO'"), "p_partkey")["items"]
    return left.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_partkey AS url, l_returnflag = 'N' AS stub, count(*) AS n FROM lineitem GROUP BY ALL), real AS (SELECT DISTINCT url FROM s WHERE NOT stub), f AS (SELECT p_partkey AS url FROM part WHERE p_size < 20 AND p_partkey NOT IN (SELECT url FROM real))
SELECT url, stub, n FROM s WHERE NOT (stub AND url IN (SELECT url FROM f)) UNION ALL SELECT url, true, 0 FROM f""")
def k05_add_stubs(spark, sf_dir):
    """Stubs for parts that have no real row."""
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("url"), (F.col("l_returnflag") == "N").alias("stub")).agg(F.count("*").alias("n"))
    new = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("url"), F.lit(True).alias("stub"), F.lit(0).cast("long").alias("n"))
    return records.add_stubs(stored, new, "url", F.col("stub"))


@query("""WITH k AS (SELECT o_custkey AS forum, o_orderkey % 50 AS tid, o_orderkey AS h FROM orders) SELECT forum, tid, h FROM k WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderpriority = '1-URGENT' AND x.o_custkey = forum AND x.o_orderkey % 50 = tid)
OR EXISTS (SELECT 1 FROM orders x WHERE x.o_orderpriority = '1-URGENT' AND x.o_custkey = forum AND x.o_orderkey = h)""")
def k08_keep_set_by_tid(spark, sf_dir):
    """Rows of a thread are cut down to those kept, where the thread is known by forum and number."""
    url = F.concat(F.lit("x?tid="), (F.col("o_orderkey") % 50).cast("string"), F.lit("&y=1"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("forum"), links.tid(url).alias("tid"), F.col("o_orderkey").alias("h"), "o_orderpriority")
    from brindle.operators import merge

    keyed = rows.withColumn("scope", F.struct("forum", "tid"))
    return merge.keep_only(keyed, keyed.where("o_orderpriority = '1-URGENT'"), "scope", "h").select("forum", "tid", "h")


@query("""SELECT page_id, h, stub FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN upper(substr(sha256(url), 1, 32)) ELSE upper(md5(url)) END AS h, page_id % 4 < 2 AS stub FROM pages) s
WHERE h NOT IN (SELECT upper(substr(sha256(url), 1, 32)) FROM pages WHERE page_id % 3 = 0) AND NOT (stub AND url IN (SELECT url FROM pages WHERE page_id % 3 = 0))""")
def k09_drop_stubs(spark, sf_dir):
    """Pages without the stubs of some addresses, found by their hash or by what they name."""
    p = table(spark, sf_dir, "pages")
    h = F.when(F.col("page_id") % 4 == 0, text.short_hash(F.col("url"))).otherwise(F.upper(F.md5("url")))
    stored = p.select("page_id", "url", h.alias("h"), (F.col("page_id") % 4 < 2).alias("stub"))
    return records.drop_stubs(stored, p.where("page_id % 3 = 0").select("url"), "url", "h", text.short_hash(F.col("url")), F.col("stub")).select("page_id", "h", "stub")


@query("SELECT 0::BIGINT AS n, 5 AS n_columns")
def k10_purge(spark, sf_dir):
    """A table emptied: no rows, all columns."""
    left = records.purge(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return left.agg(F.count("*").alias("n")).withColumn("n_columns", F.lit(len(left.columns)))


@query("""SELECT o_orderkey, coalesce(g.board, o_orderpriority) AS board FROM orders LEFT JOIN (SELECT l_partkey AS k, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) FILTER (WHERE l_linestatus = 'O') AS board FROM lineitem GROUP BY l_partkey) g ON g.k = o_custkey""")
def k11_fill_boards(spark, sf_dir):
    """A column set for many rows at once to the last of what is given, where that isn't empty."""
    stored = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("board"))
    given = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("").alias("board"), "l_shipdate", "l_orderkey", "l_linenumber")
    return records.fill_from(stored, given, "k", ["board"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("o_orderkey", "board")


_QUEUE = "event_id AS url, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN event_type = 'error' THEN 'e' END AS last_error, CASE WHEN event_type = 'purchase' THEN 'paid ' || user_id END AS outcome, CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS fail_count"


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*["event_id AS url", "user_id", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'skipped' ELSE 'pending' END AS status", "CASE WHEN event_type = 'error' THEN 'e' END AS last_error", "CASE WHEN event_type = 'purchase' THEN concat('paid ', user_id) END AS outcome", "CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS fail_count"])


@query(f"""SELECT coalesce(n.url, q.url) AS url, coalesce(n.user_id, q.user_id) AS user_id, CASE WHEN n.url IS NOT NULL THEN 'pending' ELSE q.status END AS status, CASE WHEN n.url IS NULL THEN q.last_error END AS last_error, CASE WHEN n.url IS NULL THEN q.outcome END AS outcome, CASE WHEN n.url IS NOT NULL THEN 0 ELSE q.fail_count END AS fail_count
FROM (SELECT {_QUEUE} FROM events) q FULL JOIN (SELECT o_custkey * 7 AS url, arg_max(o_orderkey % 1000, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'P') AS user_id FROM orders GROUP BY 1) n ON n.url = q.url""")
def k14_requeue_new(spark, sf_dir):
    """Rows that come again wait as new ones and keep what they don't give."""
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7).alias("url"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 1000).alias("user_id"), "o_orderdate", "o_orderkey")
    return records.requeue_new(_queue(spark, sf_dir), new, "url", ["o_orderdate", "o_orderkey"])


@query(f"""SELECT url, user_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN NOT hit THEN last_error END AS last_error, CASE WHEN NOT hit THEN outcome END AS outcome, CASE WHEN hit THEN 0 ELSE fail_count END AS fail_count
FROM (SELECT *, coalesce((status = 'skipped' AND outcome ILIKE 'paid 1%') OR (status IN ('failed', 'skipped') AND user_id IN (3, 5)), false) AS hit FROM (SELECT {_QUEUE} FROM events))""")
def k16_requeue_kind(spark, sf_dir):
    """Rows of one kind of outcome, and rows of some numbers that were given up, wait again."""
    which = ((F.col("status") == "skipped") & discarded_kind(F.col("outcome"), {"paid": ["paid 1%"]}, "paid")) | (F.col("status").isin("failed", "skipped") & F.col("user_id").isin(3, 5))
    return records.requeue(_queue(spark, sf_dir), which)


def discarded_kind(outcome, kinds: dict[str, list[str]], kind: str):
    """Whether an outcome is of a kind, known by LIKE patterns; a kind without patterns takes all, an unknown one is an error."""
    patterns = kinds[kind]
    return reduce(lambda a, b: a | b, [outcome.ilike(p) for p in patterns]) if patterns else F.lit(True)


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.outcome, o.outcome) AS outcome, coalesce(n.title, o.title) AS title FROM (SELECT p_partkey AS k, p_type AS outcome, p_name AS title FROM part WHERE p_size < 40) o
FULL JOIN (SELECT l_partkey AS k, arg_max(left(l_returnflag || l_linestatus, 1), (l_shipdate, l_orderkey, l_linenumber)) FILTER (WHERE l_returnflag <> 'N') AS outcome, arg_max(left('title ' || l_orderkey, 8), (l_shipdate, l_orderkey, l_linenumber)) AS title FROM lineitem GROUP BY 1) n ON n.k = o.k""")
def k17_probes(spark, sf_dir):
    """An upsert that keeps what isn't given and cuts texts."""
    stored = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("outcome"), F.col("p_name").alias("title"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("outcome"), F.concat(F.lit("title "), F.col("l_orderkey").cast("string")).alias("title"), "l_shipdate", "l_orderkey", "l_linenumber")
    return records.upsert_filled(stored, new, ["k"], ["l_shipdate", "l_orderkey", "l_linenumber"], {"outcome": 1, "title": 8})


_META = """SELECT coalesce(o.k, n.k) AS k, coalesce(n.status, o.status) AS status, CASE WHEN n.k IS NULL THEN o.title WHEN o.k IS NULL THEN n.title WHEN n.status = 'ok' THEN {0} ELSE o.title END AS title,
CASE WHEN n.k IS NULL THEN o.people WHEN o.k IS NULL THEN n.people WHEN n.status = 'ok' AND len(n.people) > 0 THEN n.people ELSE o.people END AS people
FROM (SELECT o_orderkey AS k, 'old' AS status, o_orderpriority AS title, [o_orderstatus] AS people FROM orders WHERE o_totalprice > 100000) o
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'missing' END AS status, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'new' END AS title, CASE WHEN o_custkey % 5 = 0 THEN [] ELSE ['a', 'b'] END AS people FROM orders WHERE o_totalprice <= 250000) n ON n.k = o.k"""


def _meta(spark, sf_dir, overwrite):
    o = table(spark, sf_dir, "orders")
    stored = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("status"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus").alias("people"))
    c = F.col("o_custkey")
    new = o.where("o_totalprice <= 250000").select(F.col("o_orderkey").alias("k"), F.when(c % 2 == 0, "ok").otherwise("missing").alias("status"), F.when(c % 3 == 0, "").otherwise("new").alias("title"), F.when(c % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("people"))
    out = records.upsert_by_status(stored, new, "k", overwrite, ["title"], ["people"])
    return out.withColumn("people", F.array_join("people", ","))


@query(f"SELECT k, status, title, array_to_string(people, ',') AS people, false AS overwrite FROM ({_META.format('''coalesce(nullif(n.title, ''), o.title)''')}) UNION ALL SELECT k, status, title, array_to_string(people, ','), true FROM ({_META.format('n.title')})")
def k18_by_status(spark, sf_dir):
    """Metadata merged by the rules of a new row's status, with and without overwriting."""
    return _meta(spark, sf_dir, False).withColumn("overwrite", F.lit(False)).union(_meta(spark, sf_dir, True).withColumn("overwrite", F.lit(True)))


@query("""WITH s AS (SELECT upper(md5(p_name)) AS h, arg_max(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'stub:' || p_partkey ELSE 'l' || p_partkey END, p_partkey) AS link FROM part GROUP BY 1), o AS (SELECT upper(md5(p_name)) AS h, min('l0' || p_type) AS link FROM part WHERE p_name LIKE '%d%' GROUP BY 1)
SELECT coalesce(o.h, s.h) AS h, CASE WHEN s.h IS NULL OR (o.h IS NOT NULL AND starts_with(s.link, 'stub:')) THEN o.link ELSE s.link END AS link FROM o FULL JOIN (SELECT * FROM s WHERE link <> '') s ON s.h = o.h""")
def k24_restore(spark, sf_dir):
    """A backup put back: its last row a hash, without those that have no link; stubs replace nothing real."""
    from brindle.sources import backup

    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    link = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("stub:"), k.cast("string"))).otherwise(F.concat(F.lit("l"), k.cast("string")))
    saved = backup.last_by_key(p.select(F.lit("f").alias("file"), k.alias("place"), F.md5("p_name").alias("h"), link.alias("link")), "h")
    stored = p.where("p_name like '%d%'").groupBy(F.upper(F.md5("p_name")).alias("h")).agg(F.min(F.concat(F.lit("l0"), "p_type")).alias("link"))
    return records.restore(stored, saved, "h", "link", lambda c: c.startswith("stub:"))


@query("SELECT l_orderkey, n_nationkey + 100 AS tag FROM (SELECT l_orderkey, l_suppkey % 30 AS t FROM lineitem) JOIN nation ON n_nationkey = t")
def k24_tags(spark, sf_dir):
    """Ids of tags replaced by those that the same names have here; names that aren't known go."""
    n = table(spark, sf_dir, "nation")
    saved, stored = n.select(F.col("n_nationkey").cast("long").alias("tag"), F.col("n_name").alias("name")), n.select((F.col("n_nationkey") + 100).cast("long").alias("tag"), F.col("n_name").alias("name"))
    return records.remapped(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 30).alias("tag")), saved, stored, "tag", "name")


@query("SELECT facet, value, n FROM (SELECT 'flag' AS facet, f AS value, count(*) AS n FROM (SELECT min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) GROUP BY f)")
def k26_snapshot(spark, sf_dir):
    """Facets written as a snapshot and read back."""
    from brindle.operators import facets

    return Scratch(spark, "facets").save(facets.two_level(table(spark, sf_dir, "lineitem"), "l_orderkey", {"flag": F.col("l_returnflag")}))


@query("SELECT p_partkey, upper(p_name) || '.mkv' AS name FROM part WHERE p_partkey % 3 <> 0")
def k28_backfill(spark, sf_dir):
    """Rows of which a computed column would now be another."""
    p = table(spark, sf_dir, "part")
    made = F.concat(F.upper("p_name"), F.lit(".mkv"))
    return records.changed(p.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, made).otherwise(F.col("p_name")).alias("name")), "p_partkey", {"name": made})


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS skipped, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS paid, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS n FROM events")
def a04_discarded(spark, sf_dir):
    """Given-up rows by state and kind in one scan."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").agg(F.count_if(t == "error").alias("failed"), F.count_if(t == "purchase").alias("skipped"), F.count_if((t == "purchase") & (F.col("value") > 50)).alias("paid"), F.count_if(t.isin("error", "purchase")).alias("n"))


@query("SELECT count(DISTINCT nullif(trim(source), '')) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN ' ' || source || ' ' WHEN doc_id % 7 = 0 THEN '  ' ELSE source END AS source FROM documents)")
def a06_distinct_trimmed(spark, sf_dir):
    source = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").agg(F.countDistinct(F.nullif(F.btrim(source), F.lit(""))).alias("n"))


@query("SELECT l_orderkey, max(l_returnflag || l_linestatus) AS top FROM lineitem GROUP BY l_orderkey HAVING CASE WHEN max(l_returnflag || l_linestatus) LIKE 'R%' THEN 'returned' WHEN max(l_returnflag || l_linestatus) LIKE '%O' THEN 'open' ELSE 'other' END = 'open'")
def a08_having_kind(spark, sf_dir):
    """Groups whose greatest outcome is of a kind."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("top"))
    return per.where(classify.by_rules(F.col("top"), [Rule("returned", starts=("R",)), Rule("open", matches="O$")], F.lit("other")) == "open")


@query("SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'lost' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 80")
def a11_regrouped(spark, sf_dir):
    """Reasons counted by their normalised kind, in one grouping."""
    kind = classify.by_rules(F.col("event_type"), [Rule("lost", equals=("error", "purchase"))], F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(80)


@query("SELECT (SELECT count(*) FROM (SELECT 1 FROM events LIMIT 5001)) AS many, (SELECT count(*) FROM (SELECT 1 FROM nation LIMIT 5001)) AS few")
def a14_capped(spark, sf_dir):
    """Counts that end at a cap, for pages that only say `more than`."""
    many, few = (table(spark, sf_dir, t).limit(5001).agg(F.count("*").alias(n)) for t, n in (("events", "many"), ("nation", "few")))
    return many.crossJoin(few)


@query("SELECT 'nation' AS \"table\", (SELECT count(*) FROM nation) AS n, 25 AS exported, true AS same UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 7, false UNION ALL SELECT 'gone', NULL, 1, false")
def a26_counts(spark, sf_dir):
    """Rows of tables against those that were exported."""
    exported = spark.createDataFrame([("nation", 25), ("orders", 7), ("gone", 1)], "table string, exported long")
    return records.table_counts({t: table(spark, sf_dir, t) for t in ("nation", "orders")}, exported)


@query("""SELECT count(DISTINCT CASE WHEN m <> 0 THEN u END) AS by_tid, count(*) FILTER (WHERE m = 0) AS alone, count(DISTINCT coalesce('url:' || CASE WHEN m <> 0 THEN url END, 'hash:' || h)) AS by_url, count(DISTINCT CASE WHEN m <> 0 THEN url END) AS urls
FROM (SELECT *, CASE WHEN f = 'src1' THEN 'tid:' || n ELSE url END AS u FROM (SELECT doc_id % 5 AS m, doc_id % 40 AS n, source AS f, 'http://x/?tid=' || doc_id % 40 || '&s=' || source AS url, upper(md5(doc_id::VARCHAR)) AS h FROM documents))""")
def g02_key_variants(spark, sf_dir):
    """Threads by the other kinds of keys, and rows that have none."""
    url = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("http://x/?tid="), (F.col("doc_id") % 40).cast("string"), F.lit("&s="), "source"))
    d = table(spark, sf_dir, "documents").select(url.alias("u"), F.md5(F.col("doc_id").cast("string")).alias("h"), "source")
    key = lambda v: threads.thread_key(F.col("u"), F.col("h"), F.col("source"), v, ("src1",))
    return d.agg(F.countDistinct(key("tid_only")).alias("by_tid"), F.count_if(key("tid_only").isNull()).alias("alone"), F.countDistinct(key("url_or_hash")).alias("by_url"), F.countDistinct(key("url")).alias("urls"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS shown, count(*) AS assets, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'open' ELSE 'closed' END AS kind FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus <> 'P') >= 2")
def g15_selection(spark, sf_dir):
    """Ids of all groups with two rows or more that aren't stubs, each with what stands for it."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("shown"), F.count("*").alias("assets"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") != "P").alias("real"))
    return per.where("real >= 2").select("o_custkey", "shown", "assets", F.when(F.col("p"), "open").otherwise("closed").alias("kind"))


@query("SELECT l_orderkey, CASE WHEN n = 1 THEN first ELSE l_shipmode END AS grp, count(*) AS n FROM (SELECT t AS l_orderkey, l_returnflag AS l_shipmode, CASE WHEN t IS NOT NULL THEN max(l_suppkey % 2) OVER w END AS n, min(l_returnflag) OVER w AS first FROM (SELECT *, CASE WHEN l_quantity < 45 THEN l_orderkey END AS t FROM lineitem) WINDOW w AS (PARTITION BY t)) GROUP BY ALL")
def g19_collapsed(spark, sf_dir):
    """Groups of orders that have one label put together; rows without an order stay."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") < 45, F.col("l_orderkey")).alias("l_orderkey"), F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 2).alias("labels"))
    return records.collapse_single(rows, "l_orderkey", "grp", "labels").groupBy("l_orderkey", "grp").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, CASE WHEN max(r) > 0 THEN arg_max(l_partkey, (r, l_quantity, l_partkey)) ELSE -l_orderkey END AS hash, max(r) > 0 AS own FROM (SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN p_partkey IS NULL THEN 2 WHEN p_size = l_orderkey % 50 THEN 1 ELSE 0 END AS r
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') ON p_partkey = l_partkey) GROUP BY l_orderkey""")
def g21_writable(spark, sf_dir):
    """The hash under which each order is written: one that nobody owns, its own, or a made one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("hash"), F.col("l_quantity").alias("size"), (F.col("l_orderkey") % 50).cast("int").alias("url"))
    owners = table(spark, sf_dir, "part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("hash"), F.col("p_size").alias("url"))
    return records.writable(rows, owners, "l_orderkey", "hash", "url", "size", -F.col("l_orderkey"))


@query("""SELECT c_custkey, l.o_orderkey AS by_list, p.o_orderkey AS by_prefix FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderstatus <> 'F', -epoch(o_orderdate), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) l ON l.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (-length(o_orderpriority), -epoch(o_orderdate), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey""")
def j02_top1_orders(spark, sf_dir):
    """Customers with their best order by two other orders of choice; both are minima, combined before the shuffle."""
    o = table(spark, sf_dir, "orders")
    at = -F.unix_timestamp("o_orderdate")
    best = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "F", at, "o_orderkey")).alias("by_list"), F.min_by("o_orderkey", F.struct(-F.length("o_orderpriority"), at, "o_orderkey")).alias("by_prefix"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("SELECT s_suppkey, n_name, count(l_orderkey) AS n FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1 LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 48 GROUP BY ALL")
def j07_left(spark, sf_dir):
    """Suppliers with their nation, if it is in a region, and how many large items they have."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(n), "s_nationkey", "left").join(large, "s_suppkey", "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def j13_delete_ranked(spark, sf_dir):
    """What is left when all but the first of each ranking are deleted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ranking.top_per_key(e, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("event_id")


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS covers FROM (SELECT p_partkey, CASE WHEN c IS NULL OR c = 'i' || p_size THEN ['i' || p_size] ELSE [c, 'i' || p_size] END AS list_distinct_ordered FROM part LEFT JOIN (SELECT s_suppkey, 'i' || (s_nationkey + 1) AS c FROM supplier) ON s_suppkey = p_partkey)")
def j15_covers(spark, sf_dir):
    """Codes with the cover that metadata has for them put before their own images."""
    meta = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.concat(F.lit("i"), (F.col("s_nationkey") + 1).cast("string")).alias("c"))
    own = F.array(F.concat(F.lit("i"), F.col("p_size").cast("string")))
    covers = F.array_distinct(F.array_compact(F.concat(F.array("c"), own)))
    return table(spark, sf_dir, "part").join(meta, "p_partkey", "left").select("p_partkey", F.array_join(covers, ",").alias("covers"))


@query("SELECT l_partkey AS tid FROM lineitem WHERE l_quantity > 10 EXCEPT (SELECT p_partkey FROM part WHERE p_size > 30 UNION SELECT s_suppkey FROM supplier)")
def j16_unknown(spark, sf_dir):
    """Numbers that neither of two folders of tables knows."""
    catalog = Catalog(spark, sf_dir, sf_dir, ("supplier",))
    known = catalog("part").where("p_size > 30").select(F.col("p_partkey").alias("tid")).union(catalog("supplier").select("s_suppkey")).distinct()
    return catalog("lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("tid")).distinct().join(known, "tid", "left_anti")


@query("SELECT o_orderkey, c.o_custkey, o_totalprice FROM orders o JOIN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 20) c ON c.o_custkey = o.o_custkey")
def j17_two_phase(spark, sf_dir):
    """All rows of the keys on a page: the keys are few and broadcast."""
    o = table(spark, sf_dir, "orders")
    page = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).orderBy(F.desc("m"), "o_custkey").limit(20).select("o_custkey")
    return o.select("o_orderkey", "o_custkey", "o_totalprice").join(F.broadcast(page), "o_custkey", "left_semi")


@query("SELECT s_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS roles FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45) ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def j19_many_to_many(spark, sf_dir):
    """Suppliers with the sorted kinds of the parts of their large items: many to many through items."""
    pairs = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    kinds = pairs.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("roles"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(kinds, "s_suppkey", "left")


@query("SELECT 'latest' AS kind, event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25) UNION ALL SELECT 'queue', event_id FROM (SELECT event_id FROM events ORDER BY event_type = 'error', ts, event_id LIMIT 25) UNION ALL SELECT 'discarded', event_id FROM (SELECT event_id FROM events ORDER BY CASE WHEN event_type = 'click' THEN NULL ELSE ts END DESC NULLS LAST, event_id LIMIT 25)")
def t04_orders(spark, sf_dir):
    """The first rows by date, by failures and age, and by a time that may be missing."""
    e, out = table(spark, sf_dir, "events"), None
    kinds = {"latest": [F.desc("ts")], "queue": [F.col("event_type") == "error", F.asc("ts")], "discarded": [F.desc_nulls_last(F.when(F.col("event_type") != "click", F.col("ts")))]}
    for kind, order in kinds.items():
        rows = e.orderBy(*order, "event_id").limit(25).select(F.lit(kind).alias("kind"), "event_id")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT p_partkey, p_type = 'PROMO' AS pictured FROM part ORDER BY p_type = 'PROMO' DESC, p_retailprice DESC, p_partkey LIMIT 200")
def t11_pictured_first(spark, sf_dir):
    """The first two hundred rows, those with pictures first."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_type") == "PROMO").alias("pictured"), "p_retailprice")
    return p.orderBy(F.desc("pictured"), F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "pictured")


@query("SELECT tid, arg_max(event_id, (event_id % 3 = 0, event_id)) AS event_id FROM (SELECT user_id AS tid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 8 GROUP BY tid")
def t12_pick_of_newest(spark, sf_dir):
    """Of the newest eight rows of each key the newest that fits, else the newest."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("tid"), "event_id")
    newest = ranking.top_per_key(e, ["tid"], [F.desc("event_id")], 8)
    return newest.groupBy("tid").agg(F.max(F.struct(F.col("event_id") % 3 == 0, "event_id"))["event_id"].alias("event_id"))


@query("SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, n_name) AS place FROM nation")
def t13_siblings(spark, sf_dir):
    """Children of each node by their order and name."""
    w = Window.partitionBy("n_regionkey").orderBy(F.col("n_nationkey") % 3, "n_name")
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.row_number().over(w).alias("place"))


@query("SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'error' THEN 0 ELSE 1 END, event_id)) AS event_id FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id")
def t14_next_in_bucket(spark, sf_dir):
    """The next row of each bucket: failed ones first, then waiting ones."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view')")
    return e.groupBy("user_id").agg(F.min(F.struct(F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id"))["event_id"].alias("event_id"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' OR p_type || ' · ' || p_size IN ('ECONOMY · 3', 'PROMO · 5') OR p_type = 'SMALL' OR starts_with(p_type || ' · ' || p_size, 'SMALL · ')")
def p12_boards(spark, sf_dir):
    """Rows of a board by id, by name in one of two spellings, or by the name of its parent."""
    name = F.concat_ws(" · ", "p_type", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").where(text.in_board(F.col("p_brand"), name, fids=["Brand#1"], names=["ECONOMY-3", "PROMO-5"], parents=["SMALL"])).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE coalesce(nullif(source, ''), 'main') IN ('src1', 'src2') AND lang <> 'de' AND (text ILIKE '%ation%' OR lang ILIKE '%fr%')")
def p13_list_filter(spark, sf_dir):
    """A list filtered by what is asked for; what isn't asked for doesn't filter."""
    asked = {"sources": ["src1", "src2"], "words": "ation", "kind": None}
    d = table(spark, sf_dir, "documents")
    parts = [F.coalesce(F.nullif("source", F.lit("")), F.lit("main")).isin(*asked["sources"]) if asked["sources"] else None, F.col("lang") != "de", F.col("text").ilike(f"%{text.like_escape(asked['words'])}%") | F.col("lang").ilike("%fr%") if asked["words"] else None, F.col("lang") == asked["kind"] if asked["kind"] else None]
    return d.where(text.all_of(parts)).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'view') AND value > 10 AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def p14_priority(spark, sf_dir):
    """Rows of some outcomes that have a value, without excluded ones."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view") & (F.col("value") > 10)).select("event_id").join(gone, "event_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '7') OR c_mktsegment ILIKE '%7%' OR c_custkey::VARCHAR ILIKE '%7%' OR c_nationkey::VARCHAR ILIKE '%7%' OR c_acctbal::DECIMAL(12, 2)::VARCHAR ILIKE '%.7_'")
def p15_many_columns(spark, sf_dir):
    """Customers of whom any of five columns holds a text."""
    c = table(spark, sf_dir, "customer")
    return c.where(text.contains_any(["c_name", "c_mktsegment", "c_custkey", "c_nationkey"], "7") | F.col("c_acctbal").cast("decimal(12,2)").cast("string").like("%.7_")).select("c_custkey")


@query("SELECT event_id, CASE WHEN reviewed THEN 'reviewed' WHEN event_type = 'error' THEN 'pending' END AS status FROM (SELECT event_id, event_type, event_id % 5 = 0 OR event_id % 7 = 0 AS reviewed FROM events) WHERE reviewed OR event_type = 'error'")
def p16_quality_status(spark, sf_dir):
    """Rows that wait for a review or had one, by a mark before their outcome or a tag."""
    outcome = F.concat(F.when(F.col("event_id") % 5 == 0, "done: ").otherwise(""), "event_type")
    tags = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("done")))
    reviewed = outcome.startswith("done: ") | F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), "done")
    status = F.when(reviewed, "reviewed").when(outcome.like("error%"), "pending")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).where("status is not null")


@query("SELECT event_id, kind FROM (SELECT event_id, 'paid' AS kind FROM events WHERE event_type IN ('purchase') UNION ALL SELECT event_id, 'all' FROM events WHERE event_type IN ('error', 'purchase') UNION ALL SELECT event_id, 'reason' FROM events WHERE event_type ILIKE 'err%' OR event_type = 'signup')")
def p19_discarded(spark, sf_dir):
    """Rows that were given up, by state, by kind of outcome and by reason."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    states = {"failed": ["error"], "skipped": ["purchase"], "all": ["error", "purchase"]}
    reasons = {"failed": t.ilike("err%") | (t == "signup")}
    out = e.where(t.isin(*states["skipped"]) & discarded_kind(t, {"paid": []}, "paid")).select("event_id", F.lit("paid").alias("kind"))
    out = out.union(e.where(t.isin(*states["all"])).select("event_id", F.lit("all")))
    return out.union(e.where(reasons["failed"]).select("event_id", F.lit("reason")))


@query("SELECT p_partkey, 'Z' || p_size AS board, p_size * 2 AS total, p_name IN ('red rod') AS primary_first FROM part")
def p26_projection(spark, sf_dir):
    """Rows as they are shown: a name for the board, files from their list, their total and the main one."""
    files = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size")), F.struct(F.lit("red rod").alias("name"), F.col("p_size").cast("long").alias("size")))
    total = F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + f["size"])
    main = F.get(F.array_sort(F.transform(files, lambda f, i: F.struct((-f["size"]).alias("s"), i.alias("i"), f["name"].alias("n")))), F.lit(0))["n"]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Z"), F.col("p_size").cast("string")).alias("board"), total.alias("total"), (main == "red rod").alias("primary_first"))


@query("SELECT user_id, place, round(delay, 6) AS delay FROM (WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events), r AS (SELECT *, avg(bad::INT) OVER (PARTITION BY user_id ORDER BY place ROWS 9 PRECEDING) AS rate FROM e), d AS (SELECT user_id, place, CASE WHEN rate = 0 THEN greatest(1.0, 2.0 * 0.9) ELSE least(20.0, 2.0 * (1 + 6 * rate)) END AS delay FROM r WHERE place = 1 UNION ALL SELECT r.user_id, r.place, CASE WHEN r.rate = 0 THEN greatest(1.0, d.delay * 0.9) ELSE least(20.0, 2.0 * (1 + 6 * r.rate)) END FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place + 1) SELECT * FROM d)")
def z03_delay(spark, sf_dir):
    """The delay of each user after each event: it shrinks while all goes well and follows the rate of failures."""
    rated = queue.failure_rate(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", 10)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return queue.delays(rated, "user_id", "event_id", "failure_rate", 2.0, 1.0, 20.0).withColumn("place", place).select("user_id", "place", F.round("delay", 6).alias("delay"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS ready, count(*) FILTER (WHERE event_type = 'view') < 8 AS more FROM events GROUP BY user_id")
def z07_back_pressure(spark, sf_dir):
    """Whether a list may be read on: only while few rows wait."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("ready"))
    return per.select("user_id", "ready", queue.may_scan(F.col("ready"), 8).alias("more"))


@query("""WITH p AS (SELECT user_id, event_id // 100 AS page, bool_and(event_type IN ('view', 'click')) AS known, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL), q AS (SELECT *, lag(kinds) OVER w = kinds AS again, known AND coalesce(lag(known) OVER w, false) AS twice FROM p WINDOW w AS (PARTITION BY user_id ORDER BY page))
SELECT user_id, min(page) FILTER (WHERE again OR twice) AS stop_at FROM q GROUP BY user_id""")
def z08_stop_rules(spark, sf_dir):
    """The page at which each list stops: two pages of known rows in a row, or the same page twice."""
    pages = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("page")).agg(F.bool_and(F.col("event_type").isin("view", "click")).alias("known"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return queue.stop_at(pages, "user_id", "page", F.col("known"), F.col("kinds"), 2)


@query("SELECT event_type, n, round_even(n * 60 / least(greatest(span, 3.0), 3600.0), 0)::BIGINT AS per_minute FROM (SELECT event_type, count(*) AS n, (SELECT epoch(max(ts)) FROM events) - min(epoch(ts)) AS span FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND AND event_type NOT LIKE 'err%' GROUP BY event_type)")
def z02_durable_rate(spark, sf_dir):
    """Rates of the last hour from the log, extrapolated over the time since the oldest row; some kinds are left out."""
    from brindle.streaming import flows

    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = F.lit(e.agg(F.max("ts")).first()[0])
    last = e.where((F.col("ts") >= end - F.expr("interval 3600 seconds")) & ~F.col("event_type").like("err%"))
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest")).select("event_type", "n", flows.per_minute(F.col("n"), F.col("oldest"), end, 3600).alias("per_minute"))
