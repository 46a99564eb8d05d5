"""Toxicity learns from all labelled documents, whatever their number."""

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import toxicity


def test_rare_terms_and_base_rate(spark):
    # 3000 of 30000 documents are toxic; a term is in 12 of them, and the rest have another
    i = F.col("doc_id")
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, m), F.lit(4000)).cast("string"))), " ")
    term = F.when(i % 10 > 0, F.lit("")).when(i % 2500 == 0, F.lit(" rarevile")).otherwise(" vilword")
    table = spark.range(30000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat(plain, term).alias("text"), (i % 10 == 0).cast("int").alias("toxic"))
    terms, _ = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), "doc_id", "text")
    assert any("rarevile".startswith(t.rstrip("*")) for t in terms)


def test_bias_is_the_base_rate(spark):
    # no term tells the classes apart, so that the score of all is the share of toxic documents
    i = F.col("doc_id")
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.lit(m)), F.lit(300)).cast("string")) for m in range(9)])
    table = spark.range(20000).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), (F.pmod(F.xxhash64(i, F.lit(77)), F.lit(10)) == 0).cast("int").alias("toxic"))
    terms, w = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), "doc_id", "text")
    assert not terms and abs(1 / (1 + np.exp(-w[0])) - 0.1) < 0.01
