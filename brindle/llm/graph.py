"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge that isn't its component's smallest node.

    edges: columns a, b (long). Null ends and loops are ignored; repeated edges count once.
    Alternates the large-star and small-star steps until every node hangs on the smallest node of
    its component. Both steps are a minimum by key (combined before the shuffle) and an equi-join,
    so a hub with many neighbours is split by adaptive skew handling. Each round is written to the
    shared scratch folder, which keeps the lineage short.
    """
    a, b = F.col("a"), F.col("b")
    current = scratch.save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        if _is_star(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        down = large.join(low, F.col("u") == F.col("k"))
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        following = scratch.save(small.where(F.col("u") != F.col("v")).distinct())
        scratch.drop(current)
        current = following
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one parent, and no parent has a parent."""
    counts = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
    if counts["n"] != counts["d"]:
        return False
    parents = edges.select(F.col("v").alias("p"))
    return counts["n"] == 0 or edges.join(parents, F.col("u") == F.col("p"), "left_semi").isEmpty()
