"""Joins of large tables with one row a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast whole, at most.
BROADCAST_ROWS = 100_000
#: A key with more than this part of all rows is joined by a broadcast in any case; there are at most as many such keys.
HOT = 4096


def join_per_key(rows: DataFrame, keys: list[str], table: DataFrame, total: int, count: str = "n") -> DataFrame:
    """rows with the columns of table for their keys; rows without a match go.

    table is a saved one with one row a key, and in `count` how many of the `total` rows have it. A table of at most
    BROADCAST_ROWS rows is broadcast. Of a larger one only the hot keys are, so that no task gets all rows of one,
    and the others are joined by a shuffle; the result is the same. Key columns must not be null.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    hot = F.broadcast(table.where(F.col(count) > F.lit(total / HOT)))
    held = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table, keys)
    return held.unionByName(rest)
