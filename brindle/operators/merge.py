"""Upserts as full joins of the stored rows with new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ranking import row_numbers


def keep_new(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def keep_filled(new: Column, old: Column) -> Column:
    """The new text unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def keep_longer(new: Column, old: Column) -> Column:
    return F.when(F.length(F.coalesce(new, F.lit(""))) > F.length(F.coalesce(old, F.lit(""))), new).otherwise(old)


def other_owner(column: str):
    """A guard: both rows name an address, and not the same one."""

    def guard(new, old) -> Column:
        n, o = F.nullif(F.btrim(new(column)), F.lit("")), F.nullif(F.btrim(old(column)), F.lit(""))
        return F.coalesce(n != o, F.lit(False))

    return guard


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict, guard=None) -> DataFrame:
    """Rows of both by key; a row in both has each column by its rule(new, old).

    guard(new columns, old columns) is a condition under which the stored row stays as it is.
    One shuffle of each side by the key; rows in one side only pass through.
    """
    a, b = old.alias("o"), new.alias("n")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    stays = both & guard(lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}")) if guard else F.lit(False)
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    for c, rule in rules.items():
        n, o = F.col(f"n.{c}"), F.col(f"o.{c}")
        columns.append(F.when(stays, o).when(both, rule(n, o)).when(F.col(f"n.{key}").isNull(), o).otherwise(n).alias(c))
    return a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str, id_col: str) -> DataFrame:
    """old, and rows of new whose key it doesn't hold, numbered on from its greatest id."""
    fresh = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*").join(old.select(key), key, "left_anti")
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    numbered = row_numbers(fresh.withColumn("one", F.lit(1)), ["one"], [key], "brindle_id").crossJoin(F.broadcast(top))
    return old.unionByName(numbered.withColumn(id_col, (F.col("top") + F.col("brindle_id")).cast(dict(old.dtypes)[id_col])).select(*old.columns))


def keep_only(rows: DataFrame, kept: DataFrame, scope: str, key: str) -> DataFrame:
    """Rows without those of a kept scope whose key isn't kept there; scopes that keep nothing stay as they are."""
    named = kept.select(scope, key).distinct()
    scopes = named.select(scope).distinct().withColumn("brindle_scope", F.lit(True))
    marked = rows.join(scopes, scope, "left").join(named.withColumn("brindle_kept", F.lit(True)), [scope, key], "left")
    return marked.where("brindle_scope is null or brindle_kept is not null").select(*rows.columns)


def review(outcome: Column, tags: Column, mark: str, tag: str, undo: bool = False) -> tuple[Column, Column]:
    """Outcome and tags with a mark before the one and a tag among the others, or without; twice is as once."""
    marked, tags = F.coalesce(outcome, F.lit("")).startswith(mark), F.coalesce(tags, F.array().cast("array<string>"))
    if undo:
        return F.when(marked, F.substr(outcome, F.lit(len(mark) + 1))).otherwise(outcome), F.array_remove(tags, tag)
    return F.when(marked, outcome).otherwise(F.concat(F.lit(mark), F.coalesce(outcome, F.lit("")))), F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))
