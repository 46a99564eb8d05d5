import pytest
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import merge, ranking


def test_similarity(spark):
    row = spark.createDataFrame([("foo bar", "bar baz")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s"), F.size(text.trigrams(F.col("a"))).alias("n")).first()
    assert row["s"] == pytest.approx(0.4) and row["n"] == 8


def test_nearest_rank(spark):
    df = spark.createDataFrame([(100000 + 2000 * i,) for i in range(51)], "v long")
    assert {round(r["share"], 1): r["value"] for r in ranking.nearest_rank(df, "v", [0.1, 0.5, 0.9]).collect()} == {0.1: 110000, 0.5: 150000, 0.9: 190000}


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", "long text"), (2, "b", "x"), (3, "c", None)], "k int, url string, s string")
    new = spark.createDataFrame([(2, "", "longer"), (3, "d", "y"), (4, "e", "z")], "k int, url string, s string")
    rows = merge.merge(old, new, "k", {"url": merge.keep_filled, "s": merge.keep_longer}, guard=lambda n, o: o("url") == "c").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "long text"), (2, "b", "longer"), (3, "c", None), (4, "e", "z")]


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
