"""Registered queries of keyword search and its filters, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import clean, search
from brindle.operators import grams, segment
from brindle.plans.catalogue import query, spread, table
from brindle.session import Scratch


def _grams(value: str) -> str:
    """The trigrams of a value in order, as SQL."""
    return f"flatten(list_transform(regexp_extract_all(lower({value}), '[\\pL\\pN]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


def _similarity(a: str, b: str) -> str:
    x, y = f"list_distinct({_grams(a)})", f"list_distinct({_grams(b)})"
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct({x} || {y})), 0), 0)"


def _word_similarity(source: str, key: str, name: str, wanted: str) -> str:
    """(key, ws): the best share over all extents of the trigrams of a name, as SQL."""
    return f"""SELECT k AS {key}, coalesce(max(CASE WHEN j >= i AND len(b) > 0 THEN len(list_intersect(a, list_distinct(b[i:j]))) / len(list_distinct(a || b[i:j])) END), 0) AS ws
FROM (SELECT {key} AS k, {_grams(name)} AS b, list_distinct({_grams(wanted)}) AS a FROM {source}) CROSS JOIN range(1, 41) r(i) CROSS JOIN range(1, 41) s(j) WHERE j <= greatest(len(b), 1) AND i <= j GROUP BY k"""


def _part_name():
    return search.search_name(F.col("p_name"), F.col("p_type"))


_NAME = "coalesce(p_name, '') || chr(10) || coalesce(p_type, '')"


@query(f"SELECT p_partkey, round(ws, 6) AS sim FROM ({_word_similarity('part', 'p_partkey', 'p_name', chr(39) + 'widgets' + chr(39))})")
def x02_word_similarity(spark, sf_dir):
    """How well a word fits into names."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(clean.word_similarity(F.lit("widgets"), F.col("p_name")), 6).alias("sim"))


_ASKED = """'"' || p_type || '" ' || p_name || ', the ' || p_brand || ' ' || p_name"""
_SPLIT = """regexp_split_to_array(trim(regexp_replace(q, '"[^"]+"', '', 'g')), '[.,!?;()\\[\\]{}<>@#%^&*~`"''|\\s-]')"""
_ITEMS = f"""SELECT p_partkey, q, trim(regexp_replace(q, '"[^"]+"', '', 'g')) AS plain, list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda k: {{'k': k, 'r': true}})
|| list_transform(list_filter({_SPLIT}, lambda k: k <> ''), lambda k: {{'k': k, 'r': false}}) AS items FROM (SELECT p_partkey, {_ASKED} AS q FROM part)"""
_ONCE = f"""SELECT p_partkey, q, plain, kept, list_transform(list_filter(list_transform(kept, lambda x, i: {{'k': x.k, 'i': i}}), lambda y: list_position(list_transform(kept, lambda x: x.k), y.k) = y.i),
lambda y: {{'k': y.k, 'r': list_filter(kept, lambda x: x.k = y.k)[-1].r}}) AS once FROM (SELECT *, list_filter(items EXTRA, lambda x: length(x.k) >= LEAST AND lower(x.k) NOT IN ('the', 'a', 'an', 'of', 'and', 'or')) AS kept FROM ({_ITEMS}))"""


def _once(extra: str, least: int) -> str:
    return _ONCE.replace("EXTRA", extra).replace("LEAST", str(least))


_JOINED = "list_aggregate(list_transform({0}, lambda x: x.k || CASE WHEN x.r THEN '!' ELSE '' END), 'string_agg', '|')"


@query(f"""SELECT p_partkey, {_JOINED.format("once")} AS fuzzy, (SELECT {_JOINED.format("list_transform(o.once, lambda x: {'k': x.k, 'r': true})")} FROM ({_once("", 2)}) o WHERE o.p_partkey = f.p_partkey) AS exact,
(SELECT replace(o.q, '"', '') || '|' || {_JOINED.format("o.once")} FROM ({_once("", 2)}) o WHERE o.p_partkey = f.p_partkey) AS smart
FROM ({_once("|| [{'k': plain, 'r': false}]", 1)}) f""")
def x04_keywords(spark, sf_dir):
    """Keywords of queries with a quoted phrase, a stop word and a repeated word, in three modes; required ones are marked."""
    asked = F.concat(F.lit('"'), "p_type", F.lit('" '), "p_name", F.lit(", the "), "p_brand", F.lit(" "), "p_name")
    shown = lambda mode: F.array_join(F.transform(search.keywords(asked, mode), lambda x: F.concat(x["keyword"], F.when(x["required"], "!").otherwise(""))), "|").alias(mode)
    return spread(table(spark, sf_dir, "part")).select("p_partkey", *[shown(m) for m in ("fuzzy", "exact", "smart")])


_LONG = "lower(p_name || ' ' || p_type || ' ' || p_name)"


@query(f"""SELECT p_partkey, array_to_string(w, '|') AS words, array_to_string(w, '') || '|' || array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {{'w': x, 'i': i}}), lambda y: list_position(w, y.w) = y.i), lambda y: y.w || CASE WHEN list_contains(types, y.w) THEN '!' ELSE '' END), '|') AS smart
FROM (SELECT p_partkey, string_split({_LONG}, ' ') AS w FROM part), (SELECT list(DISTINCT lower(p_type)) AS types FROM part)""")
def x04_segmented(spark, sf_dir):
    """Names, types and names again without blanks come apart into their words; as queries, types are what is required."""
    parts = table(spark, sf_dir, "part")
    named = parts.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"), F.lit("a").alias("tag"))
    typed = parts.select(F.lower("p_type").alias("word"), F.lit("n").alias("tag"))
    lexicon = named.unionByName(typed).groupBy("word").agg(F.count("*").alias("freq"), F.max("tag").alias("tag"))
    asked = parts.select("p_partkey", F.replace(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")), F.lit(" "), F.lit("")).alias("q"))
    cut = segment.segment(asked, "q", lexicon, "parts", whole=None)
    shown = F.transform(search.keywords(F.col("q"), "smart", search.cut_items(F.col("parts"))), lambda x: F.concat(x["keyword"], F.when(x["required"], "!").otherwise("")))
    return cut.select("p_partkey", F.array_join(F.transform("parts", lambda w: w["word"]), "|").alias("words"), F.array_join(shown, "|").alias("smart"))


_FUZZY = f"""SELECT p_partkey, ({_NAME} ILIKE '%cold%')::INT + ({_NAME} ILIKE '%widget%')::INT + ({_NAME} ILIKE '%promo%')::INT + ({_NAME} ILIKE '%cold widget promo%')::INT >= 2 AS enough, round(ws, 6) AS by_word, round({_similarity(_NAME, "'cold widget promo'")}, 6) AS by_all
FROM part JOIN ({_word_similarity("part", "p_partkey", _NAME, "'cold widget promo'")}) USING (p_partkey)
WHERE ({_NAME} ILIKE '%cold%')::INT + ({_NAME} ILIKE '%widget%')::INT + ({_NAME} ILIKE '%promo%')::INT + ({_NAME} ILIKE '%cold widget promo%')::INT >= 2 OR ws > 0.25 OR {_similarity(_NAME, "'cold widget promo'")} > 0.15"""


@query(_FUZZY)
def p03_fuzzy(spark, sf_dir):
    """Parts that hold half of the keywords of a query or are similar to it, with what decides."""
    asked, name = "cold widget promo", _part_name()
    rows = grams.fuzzy(table(spark, sf_dir, "part"), "p_partkey", name, asked, search.plan(spark, asked, "fuzzy"))
    return rows.select("p_partkey", "enough", F.round("by_word", 6).alias("by_word"), F.round("by_all", 6).alias("by_all"))


@query(_FUZZY)
def p03_by_index(spark, sf_dir):
    """The same from the posting lists of a written index: a part whose lists tell that it can't match isn't read."""
    asked, name, path = "cold widget promo", _part_name(), Scratch(spark, "gram-index").base
    parts = spread(table(spark, sf_dir, "part"))
    grams.write_index(parts, "p_partkey", name, path)
    rows = grams.fuzzy(parts, "p_partkey", name, asked, search.plan(spark, asked, "fuzzy"), grams.read_index(spark, path))
    return rows.select("p_partkey", "enough", F.round("by_word", 6).alias("by_word"), F.round("by_all", 6).alias("by_all"))


@query("SELECT doc_id, 'quoted' AS mode FROM documents WHERE text ILIKE '%ation%' UNION ALL SELECT doc_id, 'longest' FROM documents WHERE text ILIKE '%tion%' UNION ALL SELECT doc_id, 'exact' FROM documents WHERE text ILIKE '%tion%' AND text ILIKE '%with%' AND text ILIKE '%er%'")
def p04_smart(spark, sf_dir):
    """In a smart search the required words decide: a quoted phrase, or else the longest third; in an exact one all do."""
    docs, out = table(spark, sf_dir, "documents"), None
    for name, asked, mode in (("quoted", '"ation" anything else', "smart"), ("longest", "tion er", "smart"), ("exact", "tion with er", "exact")):
        rows = docs.where(search.matches(F.col("text"), search.plan(spark, asked, mode), mode)).select("doc_id", F.lit(name).alias("mode"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""SELECT p_partkey, score FROM (SELECT p_partkey, p_retailprice, round((CASE WHEN {_NAME} ILIKE '%blue rod%' THEN 10 ELSE 0 END) + (CASE WHEN {_NAME} ILIKE '%blue%' THEN 3 ELSE 0 END) + (CASE WHEN {_NAME} ILIKE '%rod%' THEN 1 ELSE 0 END)
+ (CASE WHEN lower({_NAME}) = 'blue rod' THEN 100 ELSE 0 END) + (CASE WHEN starts_with(lower({_NAME}), 'blue rod') THEN 40 ELSE 0 END) + 60 * ws + 40 * {_similarity(_NAME, "'blue rod'")}, 6) AS score
FROM part JOIN ({_word_similarity("part", "p_partkey", _NAME, "'blue rod'")}) USING (p_partkey)) ORDER BY score DESC, p_retailprice DESC, p_partkey LIMIT 50""")
def t01_relevance(spark, sf_dir):
    """The fifty parts that fit a query best: keywords, the whole query, its beginning, and similarity."""
    asked = "blue rod"
    rows = grams.best(table(spark, sf_dir, "part"), _part_name(), asked, search.plan(spark, asked), [F.desc("p_retailprice"), F.col("p_partkey")], 50)
    return rows.select("p_partkey", F.round("score", 6).alias("score"))


_DOC = _grams("coalesce(text, '')")


@query(f"""SELECT gram, count(*) AS n, sum(size)::BIGINT AS sizes FROM (SELECT doc_id, len(g) AS size, unnest(g) AS gram FROM (SELECT doc_id, list_distinct({_DOC}) AS g FROM documents)) GROUP BY gram""")
def x01_postings(spark, sf_dir):
    """For each trigram of the documents, how many have it and how many trigrams these have."""
    index = grams.postings(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")))
    return index.groupBy("gram").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))


_LICENCE = "the gnu general public license"


@query(f"""SELECT doc_id, shared, round(shared / (size + asked - shared), 6) AS similarity FROM (SELECT doc_id, len(list_intersect(g, a)) AS shared, len(g) AS size, len(a) AS asked FROM (SELECT doc_id, list_distinct({_DOC}) AS g, list_distinct({_grams(chr(39) + _LICENCE + chr(39))}) AS a FROM documents))
WHERE shared > 0.25 * asked""")
def x01_by_index(spark, sf_dir):
    """Documents with more than a quarter of a phrase's trigrams, from a written index, without reading a text again."""
    path = Scratch(spark, "gram-index").base
    grams.write_index(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), path)
    asked = grams.query_grams(_LICENCE)
    found = grams.hits(grams.read_index(spark, path), asked).withColumn("shared", F.size("grams"))
    return found.where(F.col("shared") > 0.25 * len(asked)).select(F.col("key").alias("doc_id"), "shared", F.round(F.col("shared") / (F.col("size") + len(asked) - F.col("shared")), 6).alias("similarity"))


@query(f"""WITH named AS (SELECT DISTINCT p_name FROM part), p AS (SELECT p_name, list_distinct({_grams("p_name")}) AS g FROM named)
SELECT a.p_name AS one, b.p_name AS other, len(list_intersect(a.g, b.g)) AS shared, round(len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)), 6) AS similarity FROM p a JOIN p b ON a.p_name < b.p_name WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) >= 0.5""")
def x01_similar_names(spark, sf_dir):
    """Pairs of part names whose trigrams are alike by half or more, by a prefix join of posting lists."""
    index = grams.postings(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", F.col("p_name"))
    pairs = grams.similar_pairs(index, index, 0.5).where(F.col("left") < F.col("right"))
    return pairs.select(F.col("left").alias("one"), F.col("right").alias("other"), "shared", F.round("similarity", 6).alias("similarity"))


@query("""SELECT 'size' AS kind, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 30)
UNION ALL SELECT 'date', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30) UNION ALL SELECT 'default', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30)""")
def t02_sort_map(spark, sf_dir):
    """The first thirty orders by each kind of order; unknown kinds are by date."""
    o, out = table(spark, sf_dir, "orders"), None
    for kind in ("size", "date", "default"):
        rows = o.orderBy(*search.order(kind, F.lit(0), "o_totalprice", "o_orderdate", "o_orderkey")).limit(30).select(F.lit(kind).alias("kind"), "o_orderkey")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT doc_id, 'hash' AS by FROM documents WHERE md5(coalesce(text, '')) IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)) UNION ALL SELECT doc_id, 'search' FROM documents WHERE text ILIKE '%ation%'")
def p10_short_circuit(spark, sf_dir):
    """A query that is a hash is looked up, one that is too short finds nothing, others are searched."""
    docs = table(spark, sf_dir, "documents").withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    wanted = docs.agg(F.min_by("h", "doc_id")).first()[0]
    out = docs.select("doc_id", F.lit("").alias("by")).limit(0)
    for asked in (wanted.upper(), "x", "ation"):
        way = search.route(asked)
        if way != "none":
            hit = F.col("h") == asked.lower() if way == "hash" else search.matches(F.col("text"), search.plan(spark, asked, "exact"), "exact")
            out = out.union(docs.where(hit).select("doc_id", F.lit(way).alias("by")))
    return out


_PREFERRED = "(p_type ILIKE '%promo%' OR p_brand ILIKE '%#1_' OR regexp_matches(p_type, '(?i)econ') OR regexp_matches(p_brand, '(?i)econ')) AND NOT (p_type ILIKE '%std%' OR p_brand ILIKE '%#13')"


@query(f"SELECT p_partkey, {_PREFERRED} AS a, p_name ILIKE '%red%' AND NOT p_name ILIKE '%bolt%' AS b FROM part WHERE {_PREFERRED} OR (p_name ILIKE '%red%' AND NOT p_name ILIKE '%bolt%')")
def p07_preferred(spark, sf_dir):
    """Parts that either of two preferences takes."""
    a = search.preferred([F.col("p_type"), F.col("p_brand")], ["%promo%", "%#1_"], ["%std%", "%#13"], "(?i)econ")
    b = search.preferred([F.col("p_name")], ["%red%"], ["%bolt%"])
    return table(spark, sf_dir, "part").where(a | b).select("p_partkey", a.alias("a"), b.alias("b"))


@query("SELECT 'both' AS asked, count(*) AS n FROM part WHERE p_type ILIKE '%promo%' AND p_name ILIKE '%red%' UNION ALL SELECT 'one', count(*) FROM part WHERE p_name ILIKE '%red%'")
def p09_preferences(spark, sf_dir):
    """Parts that meet all preferences, one of which some queries switch off."""
    chosen = {"type": search.preferred([F.col("p_type")], ["%promo%"]), "name": search.preferred([F.col("p_name")], ["%red%"])}
    p = table(spark, sf_dir, "part")
    rows = [p.where(search.preferences(chosen, q, {"type": r"(?i)^(any|all)\b"})).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, q in (("both", "rod"), ("one", "ALL rods"))]
    return rows[0].union(rows[1])
