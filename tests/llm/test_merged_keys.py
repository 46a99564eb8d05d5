"""Keys that are cut from rows are many more than Spark's sizes tell: their joins are never broadcast."""

from pyspark.sql import functions as F

from brindle.llm import line_dedup, simhash
from brindle.session import Scratch


def test_shared_keys_of_fingerprints(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    base = Scratch(spark, "test").save(rows.unionByName(rows.limit(50).select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"))))
    found = simhash.links(base)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = {frozenset(r) for r in found.collect()}
    assert len(pairs) == 50 and all((a ^ b) & ((1 << 64) - 1) == 5 for a, b in pairs)


def test_keys_of_lines(spark, monkeypatch):
    plans, save, scratch = [], Scratch.save, Scratch(spark, "test")
    lines = [f"line {i * 7919} {'abcdefghij'[i % 10] * 12} {i * 104729}" for i in range(300)]
    lines += [lines[0] + "x", lines[1][:-1]]
    classes = spark.createDataFrame(enumerate(lines), "id long, line string").select("id", F.length("line").alias("len"), line_dedup.letter_counts(F.col("line")).alias("c"), "line")
    classes = scratch.save(classes)
    monkeypatch.setattr(Scratch, "save", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df))
    found = line_dedup.near_pairs(classes, scratch)
    assert "Broadcast" not in plans[0]
    assert {(0, 300), (1, 301)} <= set(map(tuple, found.collect()))
