"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import merge, ranking, trees

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spread(rows: DataFrame) -> DataFrame:
    """Rows with much work each over all cores, where their table lies in fewer pieces, as small files do."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


def tasks_of(rows: DataFrame, each: int = 500_000) -> int:
    """How many tasks hold so many rows of a table each, by the counts in its files, so that a task's memory doesn't grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM (
  SELECT c_custkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY c_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rn
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE rn = 1
""")
def j01_top1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the best of its orders, if any."""
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    order = Window.partitionBy("o_custkey").orderBy(urgency, F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey")
    best = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_nationkey, n_name, count(*) AS n_items, round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, n_name""")
def j06_three_way(spark, sf_dir):
    """Items joined with their orders, customers and nations, summed by nation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_key = items.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sums = by_key.groupBy("c_nationkey").agg(F.count("*").alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return sums.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_name", "n_items", "total")


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders,
count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders FROM customer GROUP BY c_mktsegment""")
def j09_semi_anti(spark, sf_dir):
    """Customers with and without orders by segment: one join with a flag."""
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("held", F.lit(True))
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count_if("held").alias("with_orders"), F.count_if(F.col("held").isNull()).alias("without_orders"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def j11_keep_latest(spark, sf_dir):
    """The latest event of each user and type; the maximum is combined before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


@query("SELECT o.n AS n_orders, o.latest AS latest, e.n AS n_events, e.total AS total FROM (SELECT count(*) n, max(o_orderdate) latest FROM orders) o, (SELECT count(*) n, round(sum(value), 4) total FROM events) e WHERE o.n > 0")
def j14_stats(spark, sf_dir):
    """One row of totals of two tables, none if the first is empty."""
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("latest")).where("n_orders > 0")
    return o.crossJoin(table(spark, sf_dir, "events").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")))


@query("SELECT doc_id, source FROM documents WHERE coalesce(source, '') || chr(10) || coalesce(text, '') ILIKE '%the%' AND coalesce(source, '') || chr(10) || coalesce(text, '') ILIKE '%src1%'")
def p02_exact(spark, sf_dir):
    """Documents that contain every keyword in source or text."""
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").where(text.contains_all(name, ["the", "src1"])).select("doc_id", "source")


@query("SELECT count(*) FILTER (WHERE o_totalprice < 50000) AS small, count(*) FILTER (WHERE o_totalprice BETWEEN 50000 AND 150000) AS middle, count(*) FILTER (WHERE o_totalprice BETWEEN 150000 AND 300000) AS large, count(*) FILTER (WHERE o_totalprice > 300000) AS huge FROM orders")
def p06_buckets(spark, sf_dir):
    """Orders by price bucket; inner buckets hold both of their ends."""
    edges = [("small", None, 50000), ("middle", 50000, 150000), ("large", 150000, 300000), ("huge", 300000, None)]
    found = table(spark, sf_dir, "orders").select(*text.size_buckets(F.col("o_totalprice"), edges))
    return found.agg(*[F.count_if(n).alias(n) for n, _, _ in edges])


@query("SELECT count(*) AS n, min(o_orderdate) AS first FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 1 MONTH")
def p05_time(spark, sf_dir):
    """Orders of the month before a given time."""
    since = F.to_timestamp(F.lit("1998-01-01")) - F.expr("interval 1 month")
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") > since).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))


@query("SELECT p_partkey FROM part WHERE (p_name ILIKE '%st%' OR p_brand ILIKE '%#1%') AND NOT (p_name ILIKE '%re%')")
def p11_any_pattern(spark, sf_dir):
    """Parts that match any of some patterns and none of others."""
    wanted, unwanted = F.array(F.lit("%st%")), F.array(F.lit("%re%"))
    hit = F.exists(wanted, lambda p: F.ilike("p_name", p)) | F.col("p_brand").ilike("%#1%")
    return table(spark, sf_dir, "part").where(hit & ~F.exists(unwanted, lambda p: F.ilike("p_name", p))).select("p_partkey")


@query("""SELECT count(*) FILTER (WHERE event_type <> 'error') AS ready, count(*) FILTER (WHERE event_type = 'error') AS abnormal,
count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS deferred, count(*) AS total FROM events""")
def a03_cond_counts(spark, sf_dir):
    """Queue states counted in one scan."""
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(F.count_if(~bad).alias("ready"), F.count_if(bad).alias("abnormal"), F.count_if(bad & (F.col("value") > 50)).alias("deferred"), F.count("*").alias("total"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS failing, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buying FROM events")
def a05_cond_distinct(spark, sf_dir):
    """Conditional distinct counts: one row a user first, then sums, so nothing is expanded."""
    flags = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.max(F.col("event_type") == "error").alias("e"), F.max(F.col("event_type") == "purchase").alias("p"))
    return flags.agg(F.count("*").alias("users"), F.count_if("e").alias("failing"), F.count_if("p").alias("buying"))


@query("SELECT l_orderkey, max(l_returnflag) AS flag, max(l_linestatus) AS status, bool_or(l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_orderkey HAVING max(l_returnflag) = 'R'")
def a07_thread_agg(spark, sf_dir):
    """Groups with the greatest of each column, filtered by one of these."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.bool_or(F.col("l_discount") > 0.05).alias("discounted")).where("flag = 'R'")


@query("SELECT kind, count(*) AS n FROM (SELECT l_orderkey, min(l_returnflag) AS kind FROM lineitem GROUP BY l_orderkey) GROUP BY kind")
def a09_two_level(spark, sf_dir):
    """A facet: each group's smallest kind, then groups by kind."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS assets FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag <> 'R') > 1")
def a15_multi_asset(spark, sf_dir):
    """Groups with more than one row that counts."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("assets")).where("assets > 1")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def a20_arg_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("best"))


@query("""WITH s AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
q AS (SELECT unnest([0.1, 0.5, 0.9]) AS share) SELECT share::DOUBLE AS share, v AS value FROM q JOIN s ON i = round_even((n - 1) * share, 0)::BIGINT""")
def a22_nearest_rank(spark, sf_dir):
    """Nearest-rank quantiles of order prices."""
    return ranking.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", [0.1, 0.5, 0.9])


@query("""SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.s = 'F' THEN a.p WHEN b.k IS NOT NULL THEN b.p ELSE a.p END AS price,
CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.s = 'F' THEN a.s ELSE coalesce(b.s, a.s) END AS status
FROM (SELECT o_orderkey k, o_totalprice p, o_orderstatus s FROM orders WHERE o_totalprice > 100000) a
FULL JOIN (SELECT o_orderkey k, o_totalprice + 1 p, nullif(o_orderstatus, 'O') s FROM orders WHERE o_totalprice <= 250000) b ON a.k = b.k""")
def k01_merge(spark, sf_dir):
    """An upsert with a guard: rows of status F stay, others take the new price and a status if there is one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    old = o.where("price > 100000")
    new = o.where("price <= 250000").select("o_orderkey", (F.col("price") + 1).alias("price"), F.nullif("status", F.lit("O")).alias("status"))
    return merge.merge(old, new, "o_orderkey", {"price": lambda n, _: n, "status": merge.keep_new}, guard=lambda n, o: o("status") == "F")


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def u01_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k"))
    return a.union(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def u02_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("k"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct().join(o, "k", "left_anti")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(m\.)?', 'https://') AS canonical,
regexp_matches(url, '^https?://m\.') AS mobile, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[./?#]|$)', 1), '') AS BIGINT) AS tid, upper(substr(sha256(url), 1, 32)) AS stub FROM pages""")
def x08_url(spark, sf_dir):
    """Host, canonical form, number and stable hash of each address."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.host(u).alias("host"), text.canonical_url(u).alias("canonical"), text.is_mobile(u).alias("mobile"), text.thread_id(u).alias("tid"), text.short_hash(u).alias("stub"))


_SPELLED = """CASE p_partkey % 9 WHEN 0 THEN p_size || 'V/' || p_retailprice || 'GB 4K' WHEN 1 THEN '【影片大小】：' || p_size WHEN 2 THEN '1V' || p_size || 'm2配额' WHEN 3 THEN '蓝光4K&1080p' WHEN 4 THEN '【资源大小】：【1V' || p_size || 'm】' || chr(10) || '9TB'
WHEN 5 THEN '[MP4/' || p_size || '.5] x' WHEN 6 THEN p_name || ' ' || p_size || ' KB, ' || p_retailprice || 'kib' WHEN 7 THEN '8K ' || p_size || '.25T 77GBx' ELSE p_name END"""


@query(rf"""WITH t AS (SELECT p_partkey, s, regexp_extract(s, '【(?:影片大小|资源大小)】：(【[^】]+】|[^\n【]+)', 1) AS field FROM (SELECT p_partkey, {_SPELLED} AS s FROM part)),
f AS (SELECT p_partkey, unnest([1, 3]) AS way, unnest([field, s]) AS v FROM t), n AS (SELECT p_partkey, way, unnest(regexp_extract_all(regexp_replace(v, '(\d+)[Vv](\d)', '\1V \2', 'g'), '(?i)\b[0-9]+(?:\.[0-9]+)?\s*[KMGT](?:I?B)?(?:[^A-Za-z]|$)')) AS m FROM f),
z AS (SELECT p_partkey, way, CASE WHEN regexp_matches(m, '^[48]K') THEN 0 ELSE floor(regexp_extract(m, '^([0-9.]+)', 1)::DOUBLE * CASE upper(regexp_extract(m, '([A-Za-z])', 1)) WHEN 'K' THEN 1024.0 WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0 ELSE 1099511627776.0 END)::BIGINT END AS b FROM n),
w AS (SELECT p_partkey, max(b) FILTER (WHERE way = 1) AS a, max(b) FILTER (WHERE way = 3) AS c FROM z GROUP BY p_partkey),
g AS (SELECT p_partkey, TRY_CAST(nullif(field, '') AS DOUBLE) AS d, TRY_CAST(nullif(regexp_extract(s, '\[MP4/([0-9.]+)\]', 1), '') AS DOUBLE) AS e FROM t)
SELECT p_partkey, coalesce(nullif(a, 0), CASE WHEN d BETWEEN 0.05 AND 50 THEN floor(d * 1073741824)::BIGINT END, nullif(c, 0), CASE WHEN e BETWEEN 0.05 AND 50 THEN floor(e * 1073741824)::BIGINT END, 0) AS bytes FROM g LEFT JOIN w USING (p_partkey)""")
def x64_capacity(spark, sf_dir):
    """Sizes read from texts of nine shapes; the SQL reads the same texts."""
    return table(spark, sf_dir, "part").withColumn("s", F.expr(_SPELLED)).select("p_partkey", text.capacity_bytes(F.col("s")).alias("bytes"))


@query("""SELECT event_type, count(*) AS n, max(c) AS busiest FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS c
FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events)) GROUP BY event_type""")
def a21_rate(spark, sf_dir):
    """Events, and the most in any minute, by type."""
    w = Window.partitionBy("event_type").orderBy("s").rangeBetween(-59, 0)
    per = table(spark, sf_dir, "events").groupBy("event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("s")).agg(F.count("*").alias("n"))
    return per.withColumn("c", F.sum("n").over(w)).groupBy("event_type").agg(F.sum("n").alias("n"), F.max("c").alias("busiest"))


_NODES = """SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'n0' END AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey ELSE 'c' || (c_custkey // 3) END FROM customer"""


@query(f"""WITH RECURSIVE nodes AS ({_NODES}), t AS (SELECT id, id AS top, 0 AS up FROM nodes UNION SELECT t.id, n.parent, up + 1 FROM t JOIN nodes n ON n.id = t.top WHERE n.parent IS NOT NULL AND up < 40),
m AS (SELECT id, top, min(up) AS up FROM t GROUP BY id, top) SELECT id, count(*) - 1 AS ancestors, (SELECT count(*) - 1 FROM m d WHERE d.top = m.id) AS descendants FROM m GROUP BY id""")
def x80_tree(spark, sf_dir):
    """How many ancestors and descendants each node has, in a forest with a cycle (region 0 is below nation 0, which is in it if it is)."""
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.when(F.col("r_regionkey") == 0, "n0").alias("parent"))
    nodes = nodes.union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    up = F.when(F.col("c_custkey") % 3 == 0, name("n", "c_nationkey")).otherwise(F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3).cast("string")))
    nodes = nodes.union(table(spark, sf_dir, "customer").select(name("c", "c_custkey"), up))
    pairs = trees.ancestors(nodes, "id", "parent")
    below = pairs.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("descendants"))
    return pairs.groupBy("id").agg(F.count("*").alias("ancestors")).join(below, "id", "full").join(nodes.select("id"), "id", "right").select("id", F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


@query("SELECT o_orderkey, array_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS place FROM orders ORDER BY coalesce(array_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 99), o_orderdate, o_orderkey LIMIT 100")
def t05_enum_order(spark, sf_dir):
    """The first hundred orders by an enumeration of priorities, then date."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]), F.col("o_orderpriority")), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"), "o_orderdate").orderBy(F.coalesce("place", F.lit(99)), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "place")


@query("""SELECT event_id, (sum(turn) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS island FROM (
SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS turn FROM events)""")
def z08_islands(spark, sf_dir):
    """Numbers each user's runs of equal events."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    turn = F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", turn.alias("turn")).select("event_id", F.sum("turn").over(w).alias("island"))
