"""Top-n per key, keep-latest and nearest-rank operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import Scratch


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. The order must be total, so that the result is the same each time."""
    return df.withColumn("brindle_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("brindle_rn") <= n).drop("brindle_rn")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order, with has_more: whether rows follow it."""
    total = df.agg(F.count("*").alias("brindle_total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("brindle_total") > offset + limit).drop("brindle_total")


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each key from 1 in a total order, also where one key holds most rows.

    Rows are dealt by ranges of key and order and written with the number of their part, so that a key goes over
    many tasks; what earlier parts hold of it is added from counts, of which there is one a key and part.
    """
    scratch = Scratch(df.sparkSession, "places")
    part = scratch.save(df.repartitionByRange(*keys, *order).withColumn("brindle_pid", F.spark_partition_id()))
    counts = part.groupBy(*keys, "brindle_pid").agg(F.count("*").alias("brindle_n"))
    before = F.sum("brindle_n").over(Window.partitionBy(*keys).orderBy("brindle_pid")) - F.col("brindle_n")
    base = counts.select(*[F.col(k).alias(f"brindle_{k}") for k in keys], F.col("brindle_pid").alias("brindle_at"), before.alias("brindle_base"))
    here = part.withColumn("brindle_rn", F.row_number().over(Window.partitionBy(*keys, "brindle_pid").orderBy(*order)))
    same = F.col("brindle_pid") == F.col("brindle_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"brindle_{k}"))
    return here.join(base, same).select(*df.columns, (F.col("brindle_rn") + F.col("brindle_base")).alias(name))


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at place round-half-even((n - 1) * share) of the sorted column.

    Equal values are counted first, so the running sum goes over distinct values, and only its totals by
    range of values are summed in one task.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # written with their part, so that both uses see the same ranges
    part = scratch.save(counts.repartitionByRange(F.col("v")).withColumn("pid", F.spark_partition_id()))
    before = part.groupBy("pid").agg(F.sum("n").alias("m")).withColumn("base", F.sum("m").over(Window.orderBy("pid")) - F.col("m")).select("pid", "base")
    ends = part.withColumn("upto", F.sum("n").over(Window.partitionBy("pid").orderBy("v"))).join(F.broadcast(before), "pid")
    total = part.agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    places = total.select("total", wanted).select("share", F.bround((F.col("total") - 1) * F.col("share"), 0).cast("long").alias("place"))
    at = ends.select("v", (F.col("base") + F.col("upto") - F.col("n")).alias("first"), (F.col("base") + F.col("upto")).alias("last"))
    return at.join(F.broadcast(places), (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))).select("share", F.col("v").alias("value"))


def spread_plan(df: DataFrame, value: str, shares: list[float], least: int, fallback: tuple[float, float], margin: float) -> tuple[float, float]:
    """The window (low, high) around the outer of some nearest ranks, widened by a share of its width; fallback if rows are few."""
    if df.where(F.col(value).isNotNull()).limit(least).count() < least:
        return fallback
    found = [float(r["value"]) for r in nearest_rank(df, value, shares).collect()]
    wide = (max(found) - min(found)) * margin
    return min(found) - wide, max(found) + wide
