"""Rewrites of stored tables: deletions across tables, stubs, bulk updates, requeueing, and upserts with rules by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_keys(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each of some tables (with the name of its key column) without the rows of some keys, whatever their case."""
    keys = gone.select(F.upper(key).alias("brindle_gone")).where("brindle_gone is not null").distinct()
    return {name: df.join(keys, F.upper(df[c]) == F.col("brindle_gone"), "left_anti") for name, (df, c) in tables.items()}


def add_stubs(stored: DataFrame, new: DataFrame, url: str, is_stub: Column, force: bool = False) -> DataFrame:
    """stored, and rows of new for addresses that have no real row; with force for all. A stub of the same address is replaced."""
    real = stored.where(~is_stub).select(url).distinct()
    fresh = new if force else new.join(real, url, "left_anti")
    kept = stored.join(fresh.select(url, F.lit(True).alias("brindle_new")).distinct(), url, "left")
    kept = kept.where(F.col("brindle_new").isNull() | ~is_stub).select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))


def drop_stubs(stored: DataFrame, gone: DataFrame, url: str, hash_col: str, stub_hash: Column, is_stub: Column) -> DataFrame:
    """stored without the stubs of some addresses: rows of the hash that such an address has, and stubs that name it."""
    urls = gone.select(F.col(url).alias("brindle_url")).where("brindle_url is not null").distinct()
    hashes = gone.select(stub_hash.alias("brindle_hash")).distinct()
    by_hash = stored.join(hashes, stored[hash_col] == F.col("brindle_hash"), "left_anti")
    return by_hash.join(urls, (by_hash[url] == F.col("brindle_url")) & is_stub, "left_anti")


def purge(df: DataFrame, needed: list[str]) -> DataFrame:
    """A table without rows. It must have some columns, so that no other table is emptied."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.limit(0)


def last_values(new: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One row a key, as if its rows were written one by one in an order: the last value of each column that isn't null.

    Of rows that are equal in the order the greater value counts, so that the result is the same each time.
    """
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("brindle_tie")))).alias(c)
    return new.groupBy(*keys).agg(*[last(c) for c in columns])


def fill_from(stored: DataFrame, given: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """stored with some columns set to the last given ones of the same key that are neither null nor empty."""
    filled = given.select(key, *[o for o in order if o != key and o not in columns], *[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in columns])
    named = last_values(filled, [key], columns, order).withColumnsRenamed({c: f"brindle_{c}" for c in columns})
    joined = stored.join(named, key, "left")
    return joined.select(*[F.coalesce(F.col(f"brindle_{c}").cast(stored.schema[c].dataType), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


#: What a row that waits again is set to.
RESET = {"status": "pending", "last_error": None, "retry_after": None, "fail_count": 0, "outcome": None}


def requeue(queue: DataFrame, which: Column) -> DataFrame:
    """The queue with some rows waiting again, without their error, outcome, count and time."""
    hit = F.coalesce(which, F.lit(False))
    return queue.select(*[F.when(hit, F.lit(RESET[c]).cast(queue.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in RESET else F.col(c) for c in queue.columns])


def requeue_new(queue: DataFrame, new: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The queue after rows came again, in an order: they wait as new ones, and keep of what was stored what they don't give."""
    once = last_values(new, [url], [c for c in new.columns if c != url and c in queue.columns], order)
    o, n = queue.alias("o"), once.alias("n")
    hit = F.col(f"n.{url}").isNotNull()
    out = []
    for c in queue.columns:
        old = F.col(f"o.{c}")
        if c == url:
            out.append(F.coalesce(f"n.{url}", f"o.{url}").alias(c))
        elif c in RESET:
            out.append(F.when(hit, F.lit(RESET[c]).cast(queue.schema[c].dataType)).otherwise(old).alias(c))
        else:
            out.append((F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns else old).alias(c))
    return o.join(n, F.col(f"o.{url}") == F.col(f"n.{url}"), "full").select(*out)


def upsert_filled(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """Rows of both by keys: the last new value of each column that isn't null, else the stored one; texts cut to their limits."""
    cut = lambda c: F.left(F.col(c), F.lit(limits[c])).alias(c) if c in (limits or {}) else F.col(c)
    rest = [c for c in stored.columns if c not in keys]
    once = new.select(*[cut(c) for c in new.columns])
    once = last_values(once, keys, rest, order)
    o, n = stored.alias("o"), once.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, same, "full").select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in stored.columns])


def upsert_by_status(stored: DataFrame, new: DataFrame, key: str, overwrite: bool, texts: list[str], lists: list[str], status: str = "status", ok: str = "ok") -> DataFrame:
    """Rows of both by key, where only a new row of status `ok` changes what is stored.

    Without overwrite its texts take the place of stored ones where they aren't empty, and its lists too. With it
    its texts do in any case, and its lists if they have elements. The new status and other columns always count.
    """
    o, n = stored.alias("o"), new.alias("n")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    good = F.col(f"n.{status}") == ok
    out = []
    for c in stored.columns:
        old, fresh = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            out.append(F.coalesce(old, fresh).alias(c))
            continue
        if c in texts:
            merged = F.when(good, fresh if overwrite else F.coalesce(F.nullif(fresh, F.lit("")), old)).otherwise(old)
        elif c in lists:
            merged = F.when(good & (F.coalesce(F.size(fresh), F.lit(0)) > 0), fresh).otherwise(old)
        else:
            merged = fresh
        out.append(F.when(both, merged).when(F.col(f"n.{key}").isNull(), old).otherwise(fresh).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)


def changed(before: DataFrame, key: str, fresh: dict[str, Column]) -> DataFrame:
    """The rows, by key, of which a column would change if it were computed again, with what it would be."""
    marked = before.select(key, *[F.col(c).alias(f"brindle_{c}") for c in fresh], *[v.alias(c) for c, v in fresh.items()])
    differs = F.lit(False)
    for c in fresh:
        differs = differs | ~F.col(f"brindle_{c}").eqNullSafe(F.col(c))
    return marked.where(differs).select(key, *fresh)


def restore(stored: DataFrame, saved: DataFrame, key: str, link: str, is_stub) -> DataFrame:
    """stored after a backup (one row a key): rows without a link are left out, and a stub takes no real link's place."""
    usable = saved.where(F.coalesce(F.btrim(link), F.lit("")) != "")
    o, n = stored.alias("o"), usable.alias("n")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    stays = both & is_stub(F.col(f"n.{link}")) & ~is_stub(F.col(f"o.{link}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[F.when(stays | F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in stored.columns])


def remapped(links: DataFrame, saved: DataFrame, stored: DataFrame, id_col: str, name: str) -> DataFrame:
    """Rows that name the ids of a saved table with the ids that the stored table has for the same names; others go."""
    pairs = saved.select(F.col(id_col).alias("brindle_id"), name).join(stored.select(F.col(id_col).alias("brindle_now"), name), name).select("brindle_id", "brindle_now")
    joined = links.join(pairs, F.col(id_col) == F.col("brindle_id"))
    return joined.select(*[F.col("brindle_now").alias(id_col) if c == id_col else F.col(c) for c in links.columns])


def writable(rows: DataFrame, owners: DataFrame, group: str, hash_col: str, url: str, size: str, made: Column) -> DataFrame:
    """(group, hash, own): the hash under which each group is written.

    Of a group's rows the largest whose hash nobody owns, else the largest that the group's own address has, else a
    made one. owners: hash and address, one row a hash.
    """
    held = rows.join(owners.select(F.col(hash_col), F.col(url).alias("brindle_owner")), hash_col, "left")
    rank = F.when(F.col("brindle_owner").isNull(), 2).when(F.col("brindle_owner") == F.col(url), 1).otherwise(0)
    best = held.groupBy(group).agg(F.max(F.struct(rank.alias("rank"), F.col(size).alias("size"), F.col(hash_col).alias("hash"))).alias("b"), F.min(url).alias(url))
    return best.select(group, F.when(F.col("b.rank") > 0, F.col("b.hash")).otherwise(made).alias("hash"), (F.col("b.rank") > 0).alias("own"))


def collapse_single(rows: DataFrame, thread: str, group: str, labels: str) -> DataFrame:
    """rows with the groups of a thread that has exactly one label put together under the first of their names; rows without a thread stay as they are."""
    one = rows.where(F.col(thread).isNotNull()).groupBy(thread).agg(F.max(labels).alias("brindle_n"), F.min(group).alias("brindle_first"))
    return rows.join(one, thread, "left").withColumn(group, F.when(F.col("brindle_n") == 1, F.col("brindle_first")).otherwise(F.col(group))).select(*rows.columns)


def table_counts(tables: dict[str, DataFrame], exported: DataFrame) -> DataFrame:
    """(table, n, exported, same): rows of each table against those that were exported (table, exported)."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = one if counts is None else counts.union(one)
    joined = counts.join(exported, "table", "full")
    return joined.select("table", "n", "exported", F.coalesce(F.col("n") == F.col("exported"), F.lit(False)).alias("same"))
