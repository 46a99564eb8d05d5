"""A training-data pipeline: each stage takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, line_dedup, mixing, simhash, toxicity
from brindle.llm.names import unused
from brindle.session import Scratch


#: Shares of tokens after mixing. Toxic documents went before, so that no share of them is wanted.
TARGETS = {"clean": 0.95, "low_quality": 0.05, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't scored as toxic, with all their columns.

    Null and empty texts have the low score of a text without hits and stay, as do repeated rows and rows
    without an id. Without labels of both classes nothing goes. An empty table gives no rows.
    """
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines and with n_chars to match; those all of whose lines went go.

    Null, empty and blank texts stay as they are. Repeated rows lose the same lines and stay. Of texts with equal
    lines the one of the smallest id keeps them (a null id comes first). An empty table gives no rows.
    """
    gone = unused("gone", docs.columns)
    out = line_dedup.dedup_lines(docs, counts=gone)
    out = out.where((F.col(f"`{gone}`.lines") == 0) | (F.col(f"`{gone}`.exact") + F.col(f"`{gone}`.near") < F.col(f"`{gone}`.lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of rows that share it, one.

    Null and empty texts are one group. Rows without an id stay. An empty table gives no rows.
    """
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that TARGETS are met.

    Documents that are likeliest clean are taken once at least; others may go, and any may be repeated. Null and
    empty texts have the prior probabilities. An empty table, or one without words, comes back as it is.
    """
    return mixing.apply(docs, _labels(spark, sf_dir), targets=TARGETS, keep="clean")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, with digests of ids and of the decoded text; a null or empty text has none."""
    return bpe.encode(docs, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", drop_near_duplicates), ("mixing", mix), ("byte_bpe", encode)]
#: A classifier, edit distances and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
