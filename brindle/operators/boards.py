"""Boards with parts: which of them are scanned, and where rows of a common list go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_heads(keys: DataFrame, key: str = "board") -> DataFrame:
    """(parent, head, parts): for each parent of `parent[:part]` keys what is scanned: its only key, or the parent if there are more."""
    whole = F.btrim(F.col(key))
    named = keys.select(whole.alias("k"), F.split_part(whole, F.lit(":"), F.lit(1)).alias("parent")).where("parent <> ''").distinct()
    return named.groupBy("parent").agg(F.count("*").alias("parts"), F.min("k").alias("only")).select("parent", F.when(F.col("parts") == 1, F.col("only")).otherwise(F.col("parent")).alias("head"), "parts")


def queue_keys(keys: DataFrame, key: str = "board") -> DataFrame:
    """(board): each key and its parent, once."""
    return keys.select(F.explode(F.array(F.btrim(key), F.split_part(F.btrim(key), F.lit(":"), F.lit(1)))).alias("board")).where("board <> ''").distinct()


def expand_parents(keys: DataFrame, known: DataFrame, key: str = "board") -> DataFrame:
    """(board): keys with each bare parent that has parts among the known keys replaced by these; others stay. Each once."""
    named = keys.select(F.btrim(key).alias("k")).where("k <> ''").distinct()
    parts = known.select(F.btrim(key).alias("part")).where(F.col("part").contains(":")).select(F.split_part("part", F.lit(":"), F.lit(1)).alias("k"), "part").distinct()
    return named.join(parts, "k", "left").select(F.coalesce("part", "k").alias("board")).distinct()


def route_rows(rows: DataFrame, enabled: DataFrame, fid: str, part: str, banned: tuple[str, ...] = ()) -> DataFrame:
    """rows with `target`: their own key if that is enabled, the list's if they have no part or none is enabled; others go.

    enabled: board, keys `fid:part`. Rows of banned parts go in any case.
    """
    split = enabled.select(F.col("board").alias("brindle_board"), F.split_part("board", F.lit(":"), F.lit(1)).alias("brindle_fid")).where("brindle_board like '%:%'")
    parents = split.select("brindle_fid").distinct().withColumn("brindle_listed", F.lit(True))
    own = F.concat(F.col(fid), F.lit(":"), F.col(part))
    kept = rows.where(F.col(part).isNull() | ~F.col(part).isin(*banned)) if banned else rows
    joined = kept.join(F.broadcast(split.select("brindle_board")), own == F.col("brindle_board"), "left").join(F.broadcast(parents), F.col(fid) == F.col("brindle_fid"), "left")
    target = F.when(F.col("brindle_board").isNotNull(), F.col("brindle_board")).when(F.col(part).isNull() | F.col("brindle_listed").isNull(), F.col(fid))
    return joined.select(*rows.columns, target.alias("target")).where("target is not null")


def merge_metadata(parts: DataFrame, key: str, untrusted: tuple[str, ...], order: str) -> DataFrame:
    """(key, title, people, sources): what several sources say of each key.

    parts: key, source, title, people (an array) and an order of sources. The title is the first filled one of a
    trusted source, else null; people are all that any source names, once each; untrusted sources come last.
    """
    low = F.col("source").isin(*untrusted).cast("int")
    filled = F.nullif(F.btrim("title"), F.lit(""))
    ranked = F.struct(low.alias("low"), F.col(order).alias("o"))
    per = parts.groupBy(key).agg(F.min(F.when((low == 0) & filled.isNotNull(), F.struct(F.col(order).alias("o"), filled.alias("t"))))["t"].alias("title"), F.array_sort(F.collect_list(F.struct(ranked.alias("r"), "source", "people"))).alias("all"))
    people = F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["people"], F.array().cast("array<string>")))))
    return per.select(key, "title", people.alias("people"), F.array_distinct(F.transform("all", lambda x: x["source"])).alias("sources"))
