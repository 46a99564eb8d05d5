"""Registered queries of trees, spans, prefixes, samples, binary files and facts of tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import links, text
from brindle.operators import boards, facets, intervals, prefixes, sampling, threads, trees
from brindle.plans.catalogue import query, spread, table, tasks_of
from brindle.sources import bencode, tables


def _benc(text: str) -> str:
    return f"strlen({text}) || ':' || {text}"


_NAME = "p_name || ' é' || p_partkey"
_INFO = f"""CASE WHEN p_partkey % 3 = 0 THEN 'd5:filesld6:lengthi' || p_size || 'e4:pathl1:a2:bceed6:lengthi' || p_partkey || 'e4:pathl1:deee4:name' || {_benc(_NAME)} || 'e'
ELSE 'd6:lengthi' || (p_size * 1000000000) || 'e4:name' || {_benc(_NAME)} || '6:piecesl0:lleee' || 'e' END"""


@query(f"""SELECT p_partkey, CASE WHEN ok THEN upper(sha1(info)) END AS infohash, CASE WHEN ok THEN name END AS name, CASE WHEN NOT ok THEN NULL WHEN p_partkey % 3 = 0 THEN p_size + p_partkey ELSE p_size * 1000000000 END AS size, CASE WHEN NOT ok THEN NULL WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS files
FROM (SELECT p_partkey, p_size::BIGINT AS p_size, p_partkey % 7 NOT IN (0, 1) AS ok, {_NAME} AS name, {_INFO.replace("p_size * ", "p_size::BIGINT * ")} AS info FROM part)""")
def s11_torrents(spark, sf_dir):
    """Torrents made of parts, with one file or two; those that are cut or have a wrong length give nothing."""
    name = F.concat("p_name", F.lit(" é"), F.col("p_partkey").cast("string"))
    coded = F.concat(F.octet_length(name).cast("string"), F.lit(":"), name)
    n = lambda c: F.col(c).cast("long").cast("string")
    two = F.concat(F.lit("d5:filesld6:lengthi"), n("p_size"), F.lit("e4:pathl1:a2:bceed6:lengthi"), n("p_partkey"), F.lit("e4:pathl1:deee4:name"), coded, F.lit("e"))
    one = F.concat(F.lit("d6:lengthi"), (F.col("p_size").cast("long") * 1000000000).cast("string"), F.lit("e4:name"), coded, F.lit("6:piecesl0:lleee"), F.lit("e"))
    whole = F.concat(F.lit("d8:announce3:url4:info"), F.when(F.col("p_partkey") % 3 == 0, two).otherwise(one), F.lit("5:otherli-5eee"))
    spoilt = F.when(F.col("p_partkey") % 7 == 0, F.left(whole, F.length(whole) - 2)).when(F.col("p_partkey") % 7 == 1, F.regexp_replace(whole, "^d8:", "d9:")).otherwise(whole)
    read = table(spark, sf_dir, "part").select("p_partkey", bencode.torrent(F.encode(spoilt, "UTF-8")).alias("t"))
    return read.select("p_partkey", "t.*")


_HEADS = "SELECT DISTINCT left(p_name, n) AS prefix FROM part, range(1, 12) r(n) UNION SELECT 'B%' UNION SELECT 'b____' UNION SELECT 'BLUE'"


@query(f"SELECT prefix, arg_min(p_partkey, (TRY_CAST(split_part(p_brand, '#', 2) AS INT), p_partkey)) AS p_partkey FROM ({_HEADS}) JOIN part ON starts_with(lower(p_name), lower(prefix)) GROUP BY prefix")
def j04_any_prefix(spark, sf_dir):
    """The first part of each of many prefixes, which may end within words, begin each other or hold signs of LIKE."""
    parts = table(spark, sf_dir, "part")
    heads = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda n: F.left("p_name", n))).alias("prefix"))
    heads = heads.union(spark.createDataFrame([("B%",), ("b____",), ("BLUE",)], "prefix string")).distinct()
    return prefixes.first_per_prefix(parts, "p_name", heads, "prefix", [F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int"), F.col("p_partkey")], ["p_partkey"])


_SPANS = """SELECT o_custkey AS k, 'o' || o_orderkey AS block, place * 100 AS "begin", place * 100 + 90 AS "end" FROM o
UNION ALL SELECT o_custkey, 'i' || o_orderkey, place * 100 + 20, place * 100 + 60 FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 'n' || o_orderkey, place * 100 + 30, place * 100 + 40 FROM o WHERE o_orderkey % 4 = 0"""
_CARDS = "SELECT o_custkey AS k, place * 100 + l_linenumber * 13 AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'name' WHEN 2 THEN 'title' ELSE 'x' END AS label, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'v' || l_partkey END AS value FROM o JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), s AS ({_SPANS}), c AS (SELECT *, CASE label WHEN 'size' THEN 'size' ELSE 'name' END AS role FROM ({_CARDS}) WHERE label <> 'x' AND value <> ''),
h AS (SELECT c.k, c.pos, c.role, c.value, arg_max(s.block, s."begin") AS block FROM c JOIN s ON s.k = c.k AND s."begin" <= c.pos AND c.pos < s."end" GROUP BY ALL)
SELECT s.k, s.block, min(h.value) FILTER (WHERE role = 'name' AND pos = first_name) AS name, min(h.value) FILTER (WHERE role = 'size' AND pos = first_size) AS size FROM s LEFT JOIN (SELECT *, min(pos) FILTER (WHERE role = 'name') OVER (PARTITION BY k, block) AS first_name, min(pos) FILTER (WHERE role = 'size') OVER (PARTITION BY k, block) AS first_size FROM h) h ON h.k = s.k AND h.block = s.block GROUP BY s.k, s.block""")
def x83_block_cards(spark, sf_dir):
    """Blocks of a text, some within others, with the name and size of the cards that stand in each and in none within it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"))
    span = lambda mark, low, high, step: o.where(F.col("o_orderkey") % step == 0).select("k", F.concat(F.lit(mark), F.col("o_orderkey").cast("string")).alias("block"), (F.col("place") * 100 + low).alias("begin"), (F.col("place") * 100 + high).alias("end"))
    blocks = span("o", 0, 90, 1).union(span("i", 20, 60, 2)).union(span("n", 30, 40, 4))
    label = F.expr("case l_linenumber % 4 when 0 then 'size' when 1 then 'name' when 2 then 'title' else 'x' end")
    value = F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string")))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    tasks = tasks_of(items)
    cards = o.repartition(tasks, "o_orderkey").join(items.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("k", (F.col("place") * 100 + F.col("l_linenumber") * 13).alias("at"), label.alias("label"), value.alias("value"))
    return intervals.cards_of(blocks, cards, "k", {"name": "name", "title": "name", "size": "size"}, tasks).select("k", "block", "name", "size")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY -ln((('0x' || substr(md5('42:' || c_custkey), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / c_acctbal, c_custkey LIMIT 300")
def x75_weighted(spark, sf_dir):
    """A sample of customers in which balances are weights, the same for a seed."""
    return sampling.sample_weighted(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal").cast("double"), 300).select("c_custkey")


@query("SELECT 0 AS window, 40 AS n, 0 AS excluded UNION ALL SELECT 1, 20, 0 UNION ALL SELECT 2, 41, 0")
def x75_windows(spark, sf_dir):
    """How many ids each of three weighted windows gives to a sample without the ids of good customers."""
    held = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    drawn = sampling.sample_windows(held, "id", [(1, 100000, 2.0), (200000, 300000, 1.0), (400000, 500000, 2.0)], 101)
    hit = held.select("id", F.lit(1).alias("hit"))
    return drawn.join(hit, "id", "left").groupBy(F.floor(F.col("id") / 200000).cast("int").alias("window")).agg(F.countDistinct("id").alias("n"), F.count("hit").alias("excluded"))


_HEAP = "SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN c_custkey WHEN c_custkey = 1 THEN 40 ELSE c_custkey // 2 END AS parent FROM customer"


def _heap(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 97 == 0, k).when(k == 1, 40).otherwise(F.floor(k / 2)).cast("long").alias("parent"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("place"))


_BELOW = f"WITH RECURSIVE n AS ({_HEAP}), d AS (SELECT id AS root, id, 0 AS down FROM n WHERE id IN ROOTS UNION SELECT d.root, n.id, down + 1 FROM d JOIN n ON n.parent = d.id WHERE down < 60), m AS (SELECT root, id, min(down) AS down FROM d GROUP BY ALL)"


@query(_BELOW.replace("ROOTS", "(2, 3, 20, 97)") + " SELECT root, id, down FROM m")
def x80_descendants(spark, sf_dir):
    """All nodes below some roots of a tree with a cycle (1 is below 40, which is below 1) and nodes that are their own parents."""
    nodes = _heap(spark, sf_dir)
    return trees.descendants(nodes, "id", "parent", nodes.where("id in (2, 3, 20, 97)").select("id"))


@query(_BELOW.replace("ROOTS", "(3, 9)") + " SELECT id FROM n WHERE id NOT IN (SELECT id FROM m)")
def k27_deleted(spark, sf_dir):
    """A tree without two subtrees."""
    nodes = _heap(spark, sf_dir)
    return trees.without_subtree(nodes, "id", "parent", nodes.where("id in (3, 9)").select("id")).select("id")


@query("""WITH all_rows AS (SELECT c_custkey % 1000 AS id, (c_custkey // 2) % 1300 AS parent, c_custkey AS o, c_name AS name FROM customer), once AS (SELECT id, arg_min(parent, o) AS parent, arg_min(name, o) AS name FROM all_rows GROUP BY id)
SELECT id, CASE WHEN parent IN (SELECT id FROM once) AND parent <> id THEN parent END AS parent, name FROM once""")
def k27_imported(spark, sf_dir):
    """Nodes imported: of equal ids the first, parents that aren't there or are the node itself are none."""
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select((k % 1000).alias("id"), (F.floor(k / 2) % 1300).alias("parent"), k.alias("o"), F.col("c_name").alias("name"))
    return trees.import_nodes(nodes, "id", "parent", ["o"]).select("id", "parent", "name")


@query(f"WITH n AS (SELECT c_custkey AS id, c_nationkey AS parent, c_custkey % 7 AS place FROM customer), w AS (SELECT *, CASE WHEN id % 5 = 0 THEN -id END AS told FROM n) SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY told NULLS LAST, place, id) - 1 AS place FROM w")
def k27_reordered(spark, sf_dir):
    """Siblings in a wanted order: those that are told first, the others behind as they were."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), (F.col("c_custkey") % 7).alias("place"))
    wanted = nodes.where("id % 5 = 0").select("id", (-F.col("id")).alias("place"))
    return trees.reorder(nodes, "id", "parent", "place", wanted)


@query("SELECT c_custkey // 50 AS page, c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey // 2 END AS parent, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS place FROM customer WHERE c_custkey // 50 % 6 <> 1")
def s14_folders(spark, sf_dir):
    """Folders read from JSON lists, in which fields are missing or of another type; texts that aren't JSON have none."""
    k = F.col("c_custkey")
    node = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "parentId": '), F.when(k % 4 == 0, "null").otherwise(F.floor(k / 2).cast("string")), F.lit(', "name": "'), "c_name", F.lit('"'), F.when(k % 3 == 0, F.concat(F.lit(', "view": {"sortOrder": '), F.col("c_nationkey").cast("string"), F.lit("}"))).when(k % 3 == 1, ', "view": {"sortOrder": "x"}').otherwise(""), F.lit("}"))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(k / 50).alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(node), ", "), F.lit("]")).alias("json"))
    pages = pages.withColumn("json", F.when(F.col("page") % 6 == 1, F.concat(F.lit("x"), "json")).otherwise(F.col("json")))
    return trees.from_json(pages, "json", {"id": ("$.id", "long"), "parent": ("$.parentId", "long"), "name": ("$.name", "string"), "place": ("$.view.sortOrder", "int")})


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, {f'min({c})::DOUBLE' if number else 'NULL'} AS least, {f'max({c})::DOUBLE' if number else 'NULL'} AS most FROM {t}" for t, c, number in (("orders", "o_orderkey", True), ("orders", "o_totalprice", True), ("orders", "o_orderstatus", False), ("lineitem", "l_quantity", True), ("lineitem", "l_linenumber", True), ("part", "p_size", True), ("part", "p_name", False), ("documents", "n_chars", True), ("documents", "text", False))))
def s13_facts(spark, sf_dir):
    """Rows, filled values, and the least and greatest number of columns, from the footers of files."""
    found = tables.facts(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "part", "documents")})
    shown = F.col("column").isin("o_orderkey", "o_totalprice", "o_orderstatus", "l_quantity", "l_linenumber", "p_size", "p_name", "n_chars", "text")
    return found.where(shown).select("table", "column", "rows", "filled", "least", "most")


@query("""SELECT k AS key, coalesce(v, d) AS value FROM (SELECT unnest(['view', 'error', 'limit']) AS k, unnest(['a', 'b', '10']) AS d) LEFT JOIN (SELECT event_type, arg_max('v' || (value * 100)::BIGINT, event_id) FILTER (WHERE user_id % 3 <> 0) AS v FROM events GROUP BY event_type) ON event_type = k""")
def s15_settings(spark, sf_dir):
    """Settings: the last stored value that isn't blank, else a default."""
    value = F.when(F.col("user_id") % 3 == 0, " ").otherwise(F.concat(F.lit("v"), F.bround(F.col("value").cast("decimal(20,6)") * 100, 0).cast("long").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_type", value.alias("v"), "event_id")
    return tables.settings(rows, "event_type", "v", {"view": "a", "error": "b", "limit": "10"}, ["event_id"])


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS n FROM part")
def k03_without_nul(spark, sf_dir):
    """Texts and lists without NUL characters; elements that were nothing else go."""
    dirty = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("\0"), "p_name", F.lit("\0")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("\0"), F.col("p_name"))).otherwise(F.array(F.lit("a\0"), F.lit("b"))).alias("list"))
    return tables.without_nul(dirty).select("p_partkey", "name", F.size("list").alias("n"))


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 30 DAY)::DATE AS retry_at FROM orders WHERE o_orderdate::DATE + INTERVAL 30 DAY > DATE '1995-06-17'")
def x71_age_retry(spark, sf_dir):
    """When rows that are too young come up again: their day and thirty more, where that is yet to come."""
    at = F.date_add(F.col("o_orderdate").cast("date"), 30)
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("retry_at")).where(F.col("retry_at") > F.lit("1995-06-17").cast("date"))


@query("""SELECT p_partkey, 'ed2k://|file|' || name || '|' || size || '|' || hash || '|/' AS uri, name, size, hash FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 7 = 4 THEN '.mp4' ELSE ' x.mkv' END AS name, p_size::BIGINT * 1001 AS size, upper(md5(p_partkey::VARCHAR)) AS hash FROM part) WHERE p_partkey % 7 <> 6
UNION ALL SELECT p_partkey, 'ed2k://|file|whole.zip|77|' || upper(md5(p_name)) || '|/', 'whole.zip', 77, upper(md5(p_name)) FROM part""")
def x42_broken_links(spark, sf_dir):
    """File links damaged in six ways, and one that isn't, made whole; what lacks a hash is none."""
    k, h = F.col("p_partkey") % 7, F.md5(F.col("p_partkey").cast("string"))
    size = (F.col("p_size").cast("long") * 1001).cast("string")
    n = F.concat("p_name", F.when(k == 4, ".mp4").otherwise(" x.mkv"))
    ways = [("d2k:/|file|", "|", "|", "|/"), ("e d 2 k : / / | file | ", " | ", " | ", " | /"), ("ed2k://｜file｜", "｜", "｜", "｜"), ("ed2k://&vert;file&#124;", "&#x7C;", "|", "|"), ("ed2k://|file|", "", "", "|/"), ("ed2k:|file|\n", "\n|", "|\n", "|/"), ("ed2k://|file|", "|", "|zz", "|/")]
    broken = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), n, F.lit(b), size, F.lit(c), h, F.lit(d))) for i, (a, b, c, d) in enumerate(ways)])
    text = F.concat(F.lit("see "), broken, F.lit("\n\nED2K:////|file|whole.zip|77|"), F.md5("p_name"), F.lit("|/ and "), broken, F.lit("\n \nend"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.explode(links.broken_file_links(text)).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, upper(sha1(p_partkey::VARCHAR)) AS hash, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_name END AS name FROM part UNION ALL SELECT p_partkey, upper(md5(p_name)), NULL FROM part")
def x47_broken_magnets(spark, sf_dir):
    """Magnet links with blanks, line breaks and full-width signs in them."""
    k, h = F.col("p_partkey") % 4, F.sha1(F.col("p_partkey").cast("string"))
    name = F.replace("p_name", F.lit(" "), F.lit("+"))
    cut = F.concat(F.left(h, F.lit(11)), F.lit(" \u200b"), F.substring(h, 12, 9), F.lit("\n"), F.substring(h, 21, 20))
    broken = F.when(k == 0, F.concat(F.lit("magnet:?xt=urn:btih:"), h, F.lit("&amp;dn="), name)).when(k == 1, F.concat(F.lit("xt=urn：btih ： "), F.upper(h), F.lit(" ＆dn＝"), name)).when(k == 2, F.concat(F.lit("magnet:?xt=urn:b t i h:"), cut, F.lit("&dn="), name)).otherwise(F.concat(F.lit("btih:"), h))
    text = F.concat(broken, F.lit(" next\nmagnet:?xt=urn:btih:"), F.md5("p_name"), F.lit(" x\n"), broken, F.lit("\n"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.explode(links.broken_magnets(text)).alias("x")).select("p_partkey", "x.*")


@query("""SELECT c_custkey AS scope, unnest(CASE c_custkey % 4 WHEN 0 THEN [a || '⚠', a || '⚠️'] WHEN 1 THEN [a, a || ' more'] WHEN 2 THEN [a, a || ' x', a || ' y'] ELSE [a, '<b>' || a || '</b>'] END) AS name,
unnest(CASE c_custkey % 4 WHEN 0 THEN [a || '⚠️', a || '⚠️'] WHEN 1 THEN [a || ' more', a || ' more'] WHEN 2 THEN [a, a || ' x', a || ' y'] ELSE [a, a] END) AS kept_name FROM (SELECT c_custkey, c_name AS a FROM customer)""")
def g18_alike(spark, sf_dir):
    """Names of one thing that differ by signs, markup or where they were cut."""
    a, k = F.col("c_name"), F.col("c_custkey") % 4
    lists = F.when(k == 0, F.array(F.concat(a, F.lit("⚠")), F.concat(a, F.lit("⚠️")))).when(k == 1, F.array(a, F.concat(a, F.lit(" more")))).when(k == 2, F.array(a, F.concat(a, F.lit(" x")), F.concat(a, F.lit(" y")))).otherwise(F.array(a, F.concat(F.lit("<b>"), a, F.lit("</b>"))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.posexplode(lists).alias("place", "name"))
    return threads.merge_names(rows, "scope", "name", "place").where("scope is not null")


@query("""SELECT page_id, CASE WHEN tid IS NULL THEN url ELSE 'https://' || CASE WHEN host LIKE '%.example.org' THEN 'main.example' ELSE host END || CASE WHEN url LIKE '%/en/%' THEN '/read.php?tid=' || tid ELSE '/thread-' || tid || '-1-1.html' END END AS url
FROM (SELECT page_id, url, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[./?#]|$)', 1), '') AS BIGINT) AS tid, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z]+://)?([^/?#:@]+)', 1)), '^(www|m)\\.', '') AS host FROM pages)""")
def x08_thread(spark, sf_dir):
    """Addresses of threads under one host and by one of two templates."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z]+://)?([^/?#:@]+)", 1)), r"^(www|m)\.", "")
    mirrors = {r[0]: "main.example" for r in pages.select(host.alias("h")).where("h like '%.example.org'").distinct().limit(1000).collect()}
    return pages.select("page_id", links.canonical_thread(F.col("url"), text.thread_id(F.col("url")), mirrors, [("/en/", "/read.php?tid={tid}")], "/thread-{tid}-1-1.html").alias("url"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'file' WHEN p_partkey % 3 = 1 THEN 'share' ELSE 'magnet' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.zip' WHEN p_partkey % 3 = 1 THEN 'coded' ELSE CASE WHEN p_size > 20 THEN p_type ELSE p_name END END AS name FROM part""")
def x49_any_kind(spark, sf_dir):
    """The main link of parts that have file links, shared folders or magnets, in this order."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("long")
    one = lambda name, size: F.struct(name.alias("name"), size.alias("size"))
    none = F.array().cast("array<struct<name:string,size:bigint>>")
    files = F.when(k == 0, F.array(one(F.concat("p_name", F.lit(".mkv")), size * 9), one(F.concat("p_name", F.lit(".zip")), F.lit(1).cast("long")))).otherwise(none)
    magnets = F.array(one(F.col("p_name"), F.lit(20).cast("long")), one(F.col("p_type"), size))
    shares = F.when(k == 1, F.array(F.struct(F.lit("bare").alias("id"), F.lit("").alias("password")), F.struct(F.lit("coded").alias("id"), F.lit("x").alias("password")))).otherwise(F.array().cast("array<struct<id:string,password:string>>"))
    best = links.primary_of({"magnet": magnets, "file": files, "share": shares}, ["file", "share", "magnet"], "share")
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.*")


@query("""WITH b AS (SELECT DISTINCT c_nationkey || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE ':' || (c_custkey % 3) END AS k FROM customer), w AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE s_nationkey || ':9' END AS k FROM supplier)
SELECT DISTINCT coalesce(b.k, w.k) AS board FROM w LEFT JOIN b ON b.k LIKE '%:%' AND split_part(b.k, ':', 1) = w.k""")
def x11_expanded(spark, sf_dir):
    """Old keys of boards: those of a whole board with parts become these."""
    n = F.col("c_nationkey").cast("string")
    known = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 5 == 0, n).otherwise(F.concat(n, F.lit(":"), (F.col("c_custkey") % 3).cast("string"))).alias("board"))
    s = F.col("s_nationkey").cast("string")
    return boards.expand_parents(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, s).otherwise(F.concat(s, F.lit(":9"))).alias("board")), known)


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS k, left(c_name, (15 + c_custkey % 4)::INT) AS name FROM customer) SELECT k, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM n o WHERE o.k = n.k AND o.name <> n.name AND starts_with(o.name, n.name))) AS n_copies FROM n GROUP BY k""")
def a24_copies(spark, sf_dir):
    """How many names of each group only begin another one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.left("c_name", (15 + F.col("c_custkey") % 4).cast("int")).alias("name"))
    return facets.prefix_copies(rows, "k", "name")


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 3 END NULLS LAST, n_name) AS place FROM nation")
def t13_by_sound(spark, sf_dir):
    """Children by their place, those without one last, then by name as Chinese readers sort it."""
    rows = table(spark, sf_dir, "nation").withColumn("o", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3))
    return rows.select("n_nationkey", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(*trees.sibling_order("o", "n_name", "zh"))).alias("place"))
