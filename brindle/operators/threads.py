"""Grouping rows into threads: keys, pages, ordered lists, representatives and names that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ranking import row_numbers, top_per_key


def thread_key(url: Column, hash_: Column, forum: Column | None = None, variant: str = "tid", merged: tuple[str, ...] = ()) -> Column:
    """The key that rows of one thread share.

    tid: rows of a merged forum by the number after `tid=`, others by address, those without one by hash.
    tid_only: the same, null without an address. url_or_hash: by address or hash. plain: these two without
    a mark before them. url: the trimmed address, null if blank.
    """
    address = F.nullif(F.btrim(url), F.lit(""))
    if variant == "url":
        return address
    if variant == "plain":
        return F.coalesce(address, F.upper(hash_))
    by_url = F.concat(F.lit("url:"), address)
    if variant in ("tid", "tid_only") and forum is not None and merged:
        number = F.nullif(F.regexp_extract(url, r"tid=([0-9]+)", 1), F.lit(""))
        by_url = F.coalesce(F.when(forum.isin(*merged), F.concat(F.lit("tid:"), forum, F.lit(":"), number)), by_url)
    return by_url if variant == "tid_only" else F.coalesce(by_url, F.concat(F.lit("hash:"), F.upper(hash_)))


def thread_page(rows: DataFrame, key: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """The page of threads by their newest row, nulls last: one maximum a key, combined before the shuffle."""
    newest = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("newest"))
    return newest.orderBy(*[F.desc_nulls_last(f"newest.{c}") for c in order], key).offset(offset).limit(limit).select(key, "newest.*")


def ordered_values(rows: DataFrame, key: str, value: str, order: list[str], cap: int | None = None) -> DataFrame:
    """(key, value, place): each thread's distinct values, numbered from 1 by where they are seen first.

    Nulls and blank texts go. Each value's first place is found before the shuffle, a cap is kept by a limit in
    each task first, and without a cap the numbering deals a very large thread out to many tasks.
    """
    clean = rows.withColumn(value, F.btrim(value)).where(F.col(value) != "") if dict(rows.dtypes)[value] == "string" else rows.where(F.col(value).isNotNull())
    first = clean.groupBy(key, value).agg(F.min(F.struct(*order)).alias("seen"))
    if cap is None:
        return row_numbers(first, [key], ["seen", value], "place").drop("seen")
    kept = top_per_key(first, [key], [F.col("seen"), F.col(value)], cap)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("seen", value)).cast("long")).drop("seen")


def board_score(fid: Column, name: Column) -> Column:
    """How telling a board's id and name are: blank names score 0, names made of the id 1."""
    spelled, number = F.btrim(F.coalesce(name, F.lit(""))), F.btrim(F.coalesce(fid, F.lit("")))
    points = F.lit(10) + F.when(spelled.contains(" · ") | spelled.contains("-"), 20).otherwise(0) + F.when(number.contains(":"), 10).otherwise(0) + F.lit(5) + F.when(number != "", 2).otherwise(0)
    return F.when(spelled == "", 0).when(spelled.startswith("fid-"), 1).otherwise(points)


def primary(rows: DataFrame, key: str, size: str, place: str, flag: Column | None = None) -> DataFrame:
    """Each thread's main row: a flagged one, else the largest, the first of equals."""
    best = F.struct(*([flag.cast("int").alias("f")] if flag is not None else []), F.col(size).alias("s"), (-F.col(place)).alias("p"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), best).alias("r")).select(key, "r.*")


def merge_truncated(names: DataFrame, scope: str, name: str, least: int = 4) -> DataFrame:
    """(scope, name, kept_name): a name that starts exactly one longer name of its scope is that name.

    Every longer name gives its prefixes of at least `least` characters, which meet the names by an equi-join; a
    name's prefixes are as many as its characters, so rows don't multiply by pairs.
    """
    distinct = names.where(F.length(name) >= least).select(scope, name).distinct()
    longer = distinct.where(F.length(name) > least).select(scope, F.col(name).alias("brindle_long"), F.explode(F.transform(F.sequence(F.lit(least), F.length(name) - 1), lambda i: F.substr(name, F.lit(1), i))).alias(name))
    only = longer.join(distinct, [scope, name], "left_semi").groupBy(scope, name).agg(F.count("*").alias("brindle_n"), F.min("brindle_long").alias("brindle_long")).where("brindle_n = 1")
    return names.select(scope, name).distinct().join(only, [scope, name], "left").select(scope, name, F.coalesce("brindle_long", name).alias("kept_name"))


#: Signs that don't tell names apart.
_QUIET = r"<[^>]*>|[\x{26A0}\x{FE0E}\x{FE0F}]|\s"


def merge_names(names: DataFrame, scope: str, name: str, place: str) -> DataFrame:
    """(scope, name, kept_name): names of a scope that are one but for being cut short or for signs.

    A shorter name that begins a longer one, blanks aside, is that name, if it begins no other one. Of exactly two names that
    are equal without markup, warning signs, variation selectors and blanks, the cleaner one is kept: without markup,
    then without selectors, then the longer, then the earlier. Prefixes meet names by an equi-join, as in merge_truncated().
    """
    once = names.select(scope, F.btrim(name).alias(name), place).groupBy(scope, name).agg(F.min(place).alias("brindle_place"))
    keyed = once.withColumn("brindle_tight", F.replace(name, F.lit(" "), F.lit(""))).where(F.length("brindle_tight") > 0)
    heads = keyed.select(scope, F.col(name).alias("brindle_long"), F.explode(F.transform(F.sequence(F.lit(1), F.length("brindle_tight")), lambda i: F.substr("brindle_tight", F.lit(1), i))).alias("brindle_tight"))
    shorter = F.length(name) < F.length("brindle_long")
    only = heads.join(keyed, [scope, "brindle_tight"]).where(shorter).groupBy(scope, name).agg(F.count("*").alias("brindle_n"), F.min("brindle_long").alias("brindle_long")).where("brindle_n = 1").drop("brindle_n")
    clean = F.struct((~F.col(name).rlike("[<>]")).alias("a"), (~F.contains(name, F.lit("\ufe0f"))).alias("b"), F.length(F.regexp_replace(name, "<[^>]*>", "")).alias("c"), (-F.col("brindle_place")).alias("d"))
    key = F.regexp_replace(name, _QUIET, "")
    pair = once.groupBy(scope).agg(F.count("*").alias("brindle_n"), F.min(key).alias("brindle_low"), F.max(key).alias("brindle_high"), F.max_by(name, clean).alias("brindle_clean"))
    alike = pair.where((F.col("brindle_n") == 2) & (F.col("brindle_low") == F.col("brindle_high")) & (F.col("brindle_low") != "")).select(scope, "brindle_clean")
    joined = once.join(only, [scope, name], "left")
    # two names of which one is cut are the longer one, whatever their signs
    cut = only.select(scope).distinct().withColumn("brindle_cut", F.lit(True))
    out = joined.join(alike, scope, "left").join(cut, scope, "left")
    return out.select(scope, name, F.coalesce("brindle_long", F.when(F.col("brindle_cut").isNull(), F.col("brindle_clean")), name).alias("kept_name"))


def last_before(marks: DataFrame, items: DataFrame, scope: str, position: str, value: str) -> DataFrame:
    """Items with the value of the last mark at or before their position in the same scope: an as-of join as one window.

    Marks and items are unioned and carried forward in order of position, so no pairs are formed.
    """
    columns = [c for c in items.columns if c not in (scope, position)]
    both = marks.select(scope, position, F.col(value).alias("mark"), F.lit(0).alias("kind"), *[F.lit(None).cast(dict(items.dtypes)[c]).alias(c) for c in columns])
    both = both.unionByName(items.select(scope, position, F.lit(None).cast(dict(marks.dtypes)[value]).alias("mark"), F.lit(1).alias("kind"), *columns))
    w = Window.partitionBy(scope).orderBy(position, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("mark", True).over(w)).where("kind = 1").select(scope, position, *columns, value)
