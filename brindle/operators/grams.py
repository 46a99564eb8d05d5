"""Trigram index: posting lists, rows that share enough trigrams with a query, and joins of similar names.

A search reads the posting lists of its own grams and verifies only rows that share enough of them. The index is a table
sorted by gram, so that files of other grams are skipped.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import clean, search, text

_WORD = re.compile(r"[^\W_]+")


def postings(df: DataFrame, key: str, name: Column) -> DataFrame:
    """(gram, key, size): each distinct trigram of a name with the row's key and how many it has. Null names have none."""
    sized = df.select(F.col(key).alias("key"), text.let(text.trigrams(name), lambda g: F.struct(g.alias("grams"), F.size(g).alias("size"))).alias("own"))
    return sized.select(F.explode("own.grams").alias("gram"), "key", F.col("own.size").alias("size"))


def write_index(df: DataFrame, key: str, name: Column, path: str) -> None:
    """Writes the postings in ranges of gram and key: a search skips other grams, and a frequent gram goes over many files."""
    postings(df, key, name).repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_grams(query: str) -> list[str]:
    """The distinct trigrams of a query, as text.trigrams() has them."""
    return list(dict.fromkeys(p[i : i + 3] for w in _WORD.findall(query.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)))


def keyword_grams(keyword: str) -> list[str]:
    """Trigrams that any text which holds the keyword must have: those within its words. Empty if it is too short for one."""
    return list(dict.fromkeys(w[i : i + 3] for w in _WORD.findall(keyword.lower()) for i in range(len(w) - 2)))


def hits(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(key, grams, size) of rows with any of the wanted grams: which of them, and how many grams the row has."""
    return index.where(F.col("gram").isin(wanted)).groupBy("key").agg(F.collect_set("gram").alias("grams"), F.max("size").alias("size"))


def _shared(wanted: list[str]) -> Column:
    return F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in wanted]))) if wanted else F.lit(0)


def _measured(name: Column, asked: list[str]) -> Column:
    """(common, size) of a name's trigrams and a query's, with the name's made once."""
    wanted = F.array(*[F.lit(g) for g in asked]) if asked else F.array().cast("array<string>")
    return F.get(F.transform(F.array(text.trigrams(name)), lambda own: F.struct(F.size(F.array_intersect(own, wanted)).alias("common"), F.size(own).alias("size"))), F.lit(0))


def _similarity(m: Column, asked: int) -> Column:
    return F.coalesce(F.try_divide(m["common"], m["size"] + asked - m["common"]), F.lit(0.0))


def _near(common: Column, size: Column, asked: int, by_word: float, by_all: float) -> Column:
    """Whether a row of `size` grams, with `common` of a query's `asked` ones, may be similar enough.

    A word similarity w takes more than w of the query's grams, as any extent has what it shares. A similarity s of sets
    of a and b grams takes more than s (a + b) / (1 + s) common ones.
    """
    return (common > by_word * asked) | (common > (asked + size) * (by_all / (1 + by_all)))


def candidates(index: DataFrame, query: str, found: list[tuple[str, bool]], by_word: float = search.WORD_SIMILARITY, by_all: float = search.SIMILARITY) -> DataFrame | None:
    """Keys of rows that may match a fuzzy search, from the index alone; None if a keyword is too short for it.

    Half of the keywords take the inner grams of each.
    """
    asked, inner = query_grams(query), [keyword_grams(k) for k, _ in found]
    if not all(inner):
        return None
    wanted = list(dict.fromkeys([*asked, *(g for k in inner for g in k)]))
    held = reduce(lambda a, b: a + b, [(_shared(k) == len(k)).cast("int") for k in inner], F.lit(0))
    return hits(index, wanted).where(_near(_shared(asked), F.col("size"), len(asked), by_word, by_all) | (held >= max(1, -(-len(found) // 2)))).select("key")


def fuzzy(rows: DataFrame, key: str, name: Column, query: str, found: list[tuple[str, bool]], index: DataFrame | None = None) -> DataFrame:
    """Rows that match a fuzzy search, with enough (half of the keywords), by_word and by_all; others never leave the JVM.

    index: postings of the rows' names; without it each row's own grams are looked at. Where a keyword is too short for
    the index, all rows are looked at for the keywords, and those without enough of them are still chosen by grams.
    """
    enough = search.matches(name, found, "fuzzy")
    if index is None:
        asked = query_grams(query)
        near = F.get(F.transform(F.array(_measured(name, asked)), lambda m: _near(m["common"], m["size"], len(asked), search.WORD_SIMILARITY, search.SIMILARITY)), F.lit(0))
        some = rows.where(enough | near)
    else:
        near = candidates(index, query, found)
        if near is None:
            near = rows.where(enough).select(F.col(key).alias("key")).unionByName(candidates(index, query, [])).distinct()
        some = rows.join(near, F.col(key) == F.col("key"), "left_semi")
    scored = some.select("*", enough.alias("enough"), clean.word_similarity(F.lit(query), name).alias("by_word"), text.similarity(name, F.lit(query)).alias("by_all"))
    return scored.where(F.col("enough") | (F.col("by_word") > search.WORD_SIMILARITY) | (F.col("by_all") > search.SIMILARITY))


def best(rows: DataFrame, name: Column, query: str, found: list[tuple[str, bool]], order: list[Column], n: int) -> DataFrame:
    """The n rows of the best search.score() and then `order`, with score; only those that may be among them are scored in full.

    A word similarity is at least the similarity of the whole name, which is one of its extents, and at most the share of the
    query's grams that the name has. So the n-th best lower bound rules out rows whose upper bound is less.
    """
    asked = query_grams(query)
    base, weight = search.keyword_score(name, found, query), search.BY_WORD + search.BY_ALL
    measured = F.get(F.transform(F.array(_measured(name, asked)), lambda m: F.struct(_similarity(m, len(asked)).alias("whole"), F.coalesce(m["common"] / max(1, len(asked)), F.lit(0.0)).alias("share"))), F.lit(0))
    bounds = rows.select("*", base.alias("brindle_base"), measured.alias("brindle_m")).select("*", F.col("brindle_m.whole").alias("brindle_all"), F.col("brindle_m.share").alias("brindle_share"))
    low = F.col("brindle_base") + weight * F.col("brindle_all")
    bar = bounds.select(low.alias("low")).orderBy(F.desc("low")).limit(n).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
    upper = F.col("brindle_base") + search.BY_ALL * F.col("brindle_all") + search.BY_WORD * F.col("brindle_share")
    some = bounds.where(upper >= bar["low"] - 1e-6) if bar["n"] == n else bounds
    by_word = F.coalesce(clean.word_similarity(F.lit(query), name), F.lit(0.0))
    scored = some.select(*rows.columns, (F.col("brindle_base") + search.BY_ALL * F.col("brindle_all") + search.BY_WORD * by_word).alias("score"))
    return scored.orderBy(F.desc("score"), *order).limit(n)


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, shared, similarity) of all pairs of rows of two postings whose trigram sets are similar by `least` or more.

    Grams are ranked by frequency, the rarest first. Sets of a and b grams that are so similar share one of the first
    a - ceil(least a) + 1 and b - ceil(least b) + 1 of them, so only these meet, and only sets of near enough sizes. The
    common grams of the pairs that met are then counted whole.
    """
    counts = left.select("gram").unionByName(right.select("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("key").orderBy("often", "gram"))
        first = side.join(counts, "gram").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
        return first.select("gram", F.col("key").alias(name), F.col("size").alias(f"{name}_size"))

    a, b = F.col("left_size"), F.col("right_size")
    met = prefix(left, "left").join(prefix(right, "right"), "gram").where((a >= b * least - 1e-9) & (b >= a * least - 1e-9)).select("left", "right", "left_size", "right_size").distinct()
    grams = lambda side, name: side.groupBy("key").agg(F.collect_list("gram").alias(f"{name}_grams")).withColumnRenamed("key", name)
    whole = met.join(grams(left, "left"), "left").join(grams(right, "right"), "right")
    counted = whole.withColumn("shared", F.size(F.array_intersect("left_grams", "right_grams")))
    found = counted.withColumn("similarity", F.col("shared") / (a + b - F.col("shared")))
    return found.where(F.col("similarity") >= least).select("left", "right", "shared", "similarity")
