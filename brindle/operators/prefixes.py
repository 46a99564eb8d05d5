"""Joins of texts with their prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many prefixes at most are sent whole to all tasks; rows never are, however small their files look.
BROADCAST_PREFIXES = 100_000


def _known(prefixes: DataFrame, prefix: str, fold: bool) -> tuple[DataFrame, list[int], bool]:
    """Prefixes with their heads, the lengths of these, and whether they are few enough to be sent."""
    known = prefixes.where(F.length(prefix) > 0).select(prefix, _shown(F.col(prefix), fold).alias("brindle_head"))
    found = known.groupBy(F.length("brindle_head").alias("n")).agg(F.count("*").alias("often")).orderBy("n").collect()
    return known, [r["n"] for r in found], sum(r["often"] for r in found) <= BROADCAST_PREFIXES


def _shown(c: Column, fold: bool) -> Column:
    return F.lower(c) if fold else c


def _cut(rows: DataFrame, text: str, lengths: list[int], fold: bool) -> DataFrame:
    """Rows with each of their first characters, by the lengths of prefixes, as brindle_head."""
    shown = _shown(F.col(text), fold)
    heads = F.array(*[F.when(F.length(shown) >= n, F.left(shown, F.lit(n))) for n in lengths])
    return rows.withColumn("brindle_head", F.explode(F.filter(heads, lambda h: h.isNotNull())))


def _met(cut: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """The join by heads; its larger side is never broadcast, as the size of a file tells nothing of what is cut from it."""
    return (cut.join(F.broadcast(known), "brindle_head") if few else cut.hint("merge").join(known, "brindle_head")).drop("brindle_head")


def prefix_join(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, fold: bool = True) -> DataFrame:
    """Rows with each prefix that they begin with. Signs stand for themselves; fold ignores case. Null and empty prefixes match nothing.

    A row meets the prefixes of each length by its own first characters, so that the join is one of equal keys, whatever
    the number of prefixes; lengths are at most as many as the longest prefix has characters.
    """
    known, lengths, few = _known(prefixes, prefix, fold)
    return _met(_cut(rows, text, lengths, fold), known, few) if lengths else rows.join(known.drop("brindle_head"), F.lit(False))


def first_per_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, order: list[Column], keep: list[str], fold: bool = True) -> DataFrame:
    """(prefix, keep): for each prefix the least of its rows by an order, which must be total; prefixes without rows have none.

    The least row of each head is found before heads meet prefixes, so that a head that most rows share travels once a task.
    """
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    known, lengths, few = _known(prefixes, prefix, fold)
    heads = rows.select(F.col(text).alias("brindle_text"), key.alias("brindle_key"))
    if not lengths:
        return heads.join(known, F.lit(False)).select(prefix, *[F.col(f"brindle_key.k{i}").alias(c) for i, c in enumerate(keep)])
    least = _cut(heads, "brindle_text", lengths, fold).groupBy("brindle_head").agg(F.min("brindle_key").alias("brindle_best"))
    best = _met(least, known, few).groupBy(prefix).agg(F.min("brindle_best").alias("brindle_best"))
    return best.select(prefix, *[F.col(f"brindle_best.k{i}").alias(c) for i, c in enumerate(keep)])
