"""The trigram index against scans of all rows and all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import clean, search, text
from brindle.operators import grams

RNG = random.Random(6)
STEMS = ["cold", "rolled", "widget", "promo", "Blue", "rød", "x1", "steel", "日本語", "100%", "a_b"]
NAMES = [None, "", "…"] + [RNG.choice([" ", "-", "\n"]).join(RNG.choice(STEMS) + RNG.choice(["", "s", "er"]) for _ in range(RNG.randrange(1, 7))) for _ in range(150)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, n, i * 7 % 11) for i, n in enumerate(NAMES)], "id int, name string, size int")


def scan(rows, query, found):
    """All rows with both similarities, then the rule."""
    name = F.col("name")
    every = rows.select("id", search.matches(name, found, "fuzzy").alias("enough"), clean.word_similarity(F.lit(query), name).alias("w"), text.similarity(name, F.lit(query)).alias("s")).collect()
    return {r["id"] for r in every if r["enough"] or (r["w"] or 0) > search.WORD_SIMILARITY or (r["s"] or 0) > search.SIMILARITY}


@pytest.mark.parametrize("query", ["cold widget", "rolld steal", "x1", "ab", "日本語 promos", "100%", "zzz"])
def test_fuzzy_is_the_same_by_index(spark, rows, query, tmp_path):
    found = search.plan(spark, query, "fuzzy")
    path = f"file://{tmp_path}/index"
    grams.write_index(rows, "id", F.col("name"), path)
    wanted = scan(rows, query, found)
    for index in (None, grams.read_index(spark, path)):
        assert {r["id"] for r in grams.fuzzy(rows, "id", F.col("name"), query, found, index).collect()} == wanted


def test_index_skips_other_grams(spark, rows, tmp_path):
    path = f"file://{tmp_path}/index"
    grams.write_index(rows, "id", F.col("name"), path)
    shown = grams.hits(grams.read_index(spark, path), ["col", "old"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in shown and "Python" not in shown


@pytest.mark.parametrize("query", ["blue rod", "cold", "100%", ""])
@pytest.mark.parametrize("n", [1, 9, 500])
def test_best_is_that_of_all_scores(spark, rows, query, n):
    found = search.plan(spark, query) if query else []
    all_rows = rows.select("id", "size", search.score(F.coalesce("name", F.lit("")), found, query).alias("score") if found else F.lit(0.0).alias("score")).collect()
    wanted = [(r["id"], round(r["score"], 9)) for r in sorted(all_rows, key=lambda r: (-round(r["score"], 9), -r["size"], r["id"]))[:n]]
    if found:
        got = grams.best(rows, F.coalesce("name", F.lit("")), query, found, [F.desc("size"), F.col("id")], n).collect()
        assert [(r["id"], round(r["score"], 9)) for r in got] == wanted


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_against_all_pairs(spark, rows, least):
    index = grams.postings(rows, "id", F.col("name"))
    sets = {}
    for r in index.collect():
        sets.setdefault(r["key"], set()).add(r["gram"])
    wanted = {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if len(x & y) / len(x | y) >= least - 1e-12}
    got = {(r["left"], r["right"]): r["shared"] for r in grams.similar_pairs(index, index, least).collect()}
    assert got == wanted


def test_grams_are_those_of_the_texts(spark):
    for q in ("Cold rolled-steel", "a", "é日本 x_y", ""):
        assert sorted(grams.query_grams(q)) == sorted(spark.range(1).select(text.trigrams(F.lit(q))).first()[0])
    assert grams.keyword_grams("old wid") == ["old", "wid"] and grams.keyword_grams("ab-c") == []


def test_long_runs_of_one_word(spark):
    """The best run may span many repeats of a word: few distinct trigrams, whatever its length."""
    name = "foo " + "zz " * 300 + "bar"
    distinct = len({g for w in ("zz",) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))})
    got = spark.range(1).select(clean.word_similarity(F.lit("foo bar"), F.lit(name))).first()[0]
    assert got == pytest.approx(8 / (8 + distinct))


def test_repeated_words_are_cut_once(spark):
    df = spark.createDataFrame([("Ab ab cd AB cd",), (None,), ("",)], "t string").select(text.trigrams(F.col("t")).alias("g"))
    assert df.collect()[0]["g"] == ["  a", " ab", "ab ", "  c", " cd", "cd "]
    # words come apart only after they are distinct
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2
