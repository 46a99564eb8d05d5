"""Samples of ids without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(excluded: DataFrame, id_col: str, low: int, high: int, n: int, seed: int = 42) -> DataFrame:
    """n ids of low..high that aren't excluded, all of them if there are fewer; the same for the same seed.

    Ids are ordered by a hash with the seed, and each task keeps n of its own before the last n are taken.
    """
    free = excluded.sparkSession.range(low, high + 1).withColumnRenamed("id", id_col).join(excluded.select(id_col), id_col, "left_anti")
    return free.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def window_quotas(windows: list[tuple[int, int, float]], n: int) -> list[int]:
    """How many of n ids each (low, high, weight) gives: its share rounded down, and what is left over to the last."""
    total = sum(w for _, _, w in windows)
    shares = [int(n * w / total) for _, _, w in windows] if total > 0 else [0] * len(windows)
    return [*shares[:-1], n - sum(shares[:-1])] if windows else []


def uniform(id_: Column, seed: int) -> Column:
    """A number above 0 and at most 1 that an id has under a seed: the first 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def sample_weighted(rows: DataFrame, id_col: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, each taken next with a chance that is its part of the weights left; the same for the same seed.

    A row's key is -ln(u) / weight with u uniform, which is exponentially distributed, and the n least keys are a
    sample of that kind: one pass, and each task keeps n of its own. Weights that are null or not above 0 are never taken.
    """
    key = -F.log(uniform(F.col(id_col), seed)) / weight
    return rows.where(F.coalesce(weight > 0, F.lit(False))).withColumn("brindle_key", key).orderBy("brindle_key", id_col).limit(n).drop("brindle_key")


def sample_windows(excluded: DataFrame, id_col: str, windows: list[tuple[int, int, float]], n: int, seed: int = 42) -> DataFrame:
    """About n ids from windows (low, high, weight), by window_quotas(), none of them excluded or taken twice.

    Windows may overlap: an id counts for the first that has it. A window with fewer free ids gives what it has.
    """
    out = None
    for i, ((low, high, _), quota) in enumerate(zip(windows, window_quotas(windows, n))):
        free = excluded.sparkSession.range(low, high + 1).withColumnRenamed("id", id_col)
        for lo, hi, _ in windows[:i]:
            free = free.where(~F.col(id_col).between(lo, hi))
        some = free.join(excluded.select(id_col), id_col, "left_anti").orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(quota)
        out = some if out is None else out.unionByName(some)
    return excluded.sparkSession.range(0).withColumnRenamed("id", id_col) if out is None else out
