"""Facets: counts of threads by the smallest value of each column, scaled and rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_level(rows: DataFrame, key: str, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n): threads by their smallest value of each facet. One shuffle by thread serves all facets."""
    per = rows.groupBy(key).agg(*[F.min(c.cast("string")).alias(f) for f, c in facets.items()])
    spread = per.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])).alias("x"))
    return spread.select("x.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def scale(buckets: DataFrame, total: int, name: str = "value", count: str = "n") -> DataFrame:
    """Counts scaled to a total by half-even rounding; the largest bucket takes what rounding left over."""
    whole = buckets.agg(F.sum(count).alias("s"))
    scaled = buckets.crossJoin(F.broadcast(whole)).select(name, F.bround(F.col(count) * F.lit(total) / F.nullif("s", F.lit(0)), 0).cast("long").alias(count))
    drift = scaled.agg((F.lit(total) - F.sum(count)).alias("drift"), F.max_by(name, F.struct(count, name)).alias("largest"))
    return scaled.crossJoin(F.broadcast(drift)).select(name, (F.col(count) + F.when(F.col(name) == F.col("largest"), F.col("drift")).otherwise(0)).alias(count))


def roll_up(buckets: DataFrame, name: str = "value", count: str = "n", mark: str = " · ") -> DataFrame:
    """Counts of parents: a name before the mark counts with all that start with it and the mark."""
    return buckets.groupBy(F.split_part(name, F.lit(mark), F.lit(1)).alias(name)).agg(F.sum(count).alias(count))


def judge_names(rows: DataFrame, key: str, name: str, place: str) -> DataFrame:
    """One row a thread: its rows, distinct names, neighbours of equal name, and share of rows without one."""
    from pyspark.sql import Window

    before = F.lag(name).over(Window.partitionBy(key).orderBy(place))
    marked = rows.select(key, name, (F.col(name) == before).alias("same"))
    blank = F.coalesce(F.btrim(name), F.lit("")) == ""
    return marked.groupBy(key).agg(F.count("*").alias("n_rows"), F.countDistinct(name).alias("n_names"), F.count_if("same").alias("n_same"), (F.count_if(blank) / F.count("*")).alias("empty_share"))


def prefix_copies(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n_copies): how many different names of a thread begin another one of it. In order of bytes such a one comes next."""
    from pyspark.sql import Window

    names = rows.where(F.btrim(name) != "").select(key, F.col(name).alias("name")).distinct()
    following = F.lead("name").over(Window.partitionBy(key).orderBy("name"))
    return names.select(key, F.coalesce(following.startswith(F.col("name")), F.lit(False)).alias("copy")).groupBy(key).agg(F.count_if("copy").alias("n_copies"))


def name_issues(judged: DataFrame, least_names: float, most_same: float, most_empty: float) -> DataFrame:
    """judge_names() with `issues`: few different names, many runs of equal ones, many without one, each as a share of the rows."""
    n = F.col("n_rows")
    found = [F.when(F.col("n_names") < n * least_names, "few_names"), F.when(F.col("n_same") > n * most_same, "runs"), F.when(F.col("empty_share") > most_empty, "empty")]
    return judged.withColumn("issues", F.array_compact(F.array(*found)))
