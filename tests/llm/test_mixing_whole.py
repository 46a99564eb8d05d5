"""Mixing learns from all labelled documents, whatever their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing


def fitted(spark, n):
    """A fit on n labelled documents, of which 80 % are clean, 14 % of low quality and 6 % toxic."""
    i = F.col("doc_id")
    kind = F.when(i % 50 < 40, "fine").when(i % 50 < 47, "bad").otherwise("vile")
    word = lambda m: F.concat(kind, F.pmod(F.xxhash64(i, F.lit(m)), F.lit(9)).cast("string"), F.lit(" w"), F.pmod(F.xxhash64(i, F.lit(m + 9)), F.lit(40)).cast("string"))
    table = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", word(1), word(2), word(3)).alias("text"), (i % 50 < 40).cast("int").alias("quality"), (i % 50 >= 47).cast("int").alias("toxic"))
    return mixing.train(table.select("doc_id", "text"), table.select("doc_id", "quality", "toxic"), "doc_id", "text")


def test_prior_is_the_mix_of_labels(spark):
    small, large = fitted(spark, 2000), fitted(spark, 20000)
    for model in (small, large):
        assert np.exp(model.prior) == pytest.approx([0.8, 0.14, 0.06], abs=2e-3)
    assert small.temperature == large.temperature
    e = np.zeros(3)
    assert small.probabilities(e) == pytest.approx(large.probabilities(e), abs=2e-3)
