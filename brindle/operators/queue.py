"""A work queue as a table: predicates, and enqueue, claim, retry and reclaim as rewrites of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_ready(now: Column, retry_after: str = "retry_after") -> Column:
    return F.col(retry_after).isNull() | (F.col(retry_after) <= now)


def is_abnormal(fails: str = "fail_count", error: str = "last_error") -> Column:
    return (F.coalesce(F.col(fails), F.lit(0)) > 0) | (F.coalesce(F.col(error), F.lit("")) != "")


def old_enough(posted: Column, now: Column, days: int) -> Column:
    """Whether an item is at least so many days old; unknown dates pass, and so does all if days <= 0."""
    return F.lit(True) if days <= 0 else F.coalesce(F.to_date(posted) <= F.date_sub(F.to_date(now), days), F.lit(True))


def enqueue(queue: DataFrame, new: DataFrame, url: str, pair: list[str] | None = None) -> DataFrame:
    """Rows of new whose address and, if given, pair of keys the queue doesn't hold; the first of equal addresses by all columns."""
    fresh = new.groupBy(url).agg(F.min(F.struct(*[c for c in new.columns if c != url])).alias("r")).select(url, "r.*")
    fresh = fresh.join(queue.select(url), url, "left_anti")
    return fresh.join(queue.select(*pair), pair, "left_anti") if pair else fresh


def enqueue_codes(queue: DataFrame, new: DataFrame, order: list[str], key: str = "code") -> DataFrame:
    """Waiting codes after new ones came in an order: the greatest priority, the last mode that is one, force if any forces.

    queue and new: key, priority, mode, force; new also has the columns of the order.
    """
    mode = F.max_by("mode", F.when(F.col("mode").isNotNull(), F.struct(*order, F.col("mode").alias("tie"))))
    once = new.groupBy(key).agg(F.max("priority").alias("priority"), mode.alias("mode"), F.bool_or("force").alias("force"))
    o, n = queue.alias("o"), once.alias("n")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return o.join(n, key, "full").select(key, F.greatest("n.priority", "o.priority").alias("priority"), pick("mode"), (F.coalesce("n.force", F.lit(False)) | F.coalesce("o.force", F.lit(False))).alias("force"))


def claim(queue: DataFrame, n: int, id_col: str, order: list[Column], status: str = "status") -> DataFrame:
    """The queue with its first n waiting rows set to running and their attempts raised; n bounds what is broadcast."""
    taken = queue.where(F.col(status) == "pending").orderBy(*order, id_col).limit(n).select(id_col, F.lit(True).alias("taken"))
    hit = F.col("taken").isNotNull()
    out = queue.join(F.broadcast(taken), id_col, "left")
    return out.withColumn(status, F.when(hit, "running").otherwise(F.col(status))).withColumn("attempts", F.col("attempts") + hit.cast("int")).drop("taken")


def reclaim(queue: DataFrame, now: Column, seconds: int, updated: str = "updated_at", status: str = "status") -> DataFrame:
    """Running rows that nobody touched for so long wait again."""
    stale = (F.col(status) == "running") & (F.col(updated) < now - F.expr(f"interval {int(seconds)} seconds"))
    return queue.withColumn(status, F.when(stale, "pending").otherwise(F.col(status)))


def retryable(queue: DataFrame, key: str, id_col: str, status: str = "status") -> DataFrame:
    """The latest failed row of each key that has no waiting or running row. One shuffle."""
    busy, failed = F.col(status).isin("pending", "running"), F.col(status) == "error"
    per = queue.groupBy(key).agg(F.bool_or(busy).alias("busy"), F.max(F.when(failed, F.col(id_col))).alias(id_col))
    return per.where(~F.col("busy") & F.col(id_col).isNotNull()).select(key, id_col)


def fold_log(log: DataFrame, key: str, place: str, kind: str, at: str, seconds: str, most: int = 3) -> DataFrame:
    """The state of each key after its log of done, skip and retry rows.

    A retry counts towards `most`, after which the state is failed, and defers by at least 30 s; done and skip
    clear the count. Only maxima and conditional sums are kept, which combine before the shuffle of each step.
    """
    ends = F.col(kind).isin("done", "skip")
    last_end = log.where(ends).groupBy(key).agg(F.max(place).alias("end_at"))
    since = log.join(last_end, key, "left").where(F.col("end_at").isNull() | (F.col(place) >= F.col("end_at")))
    deferred = F.col(at) + F.make_dt_interval(secs=F.greatest(F.lit(30.0), F.col(seconds).cast("double")).cast("decimal(18,6)"))
    per = since.groupBy(key).agg(F.count_if(F.col(kind) == "retry").alias("fails"), F.max_by(kind, place).alias("last"), F.max_by(deferred, place).alias("until"))
    failed = F.col("fails") >= most
    state = F.when(F.col("last") == "done", "done").when(F.col("last") == "skip", "skipped").when(failed, "failed").otherwise("pending")
    return per.select(key, "fails", state.alias("state"), F.when(state == "pending", F.col("until")).alias("retry_after"))


def daily_left(log: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """(key, day, used, left): how much of a daily limit is left; a limit of 0 is none."""
    used = log.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("left", F.greatest(F.lit(0), F.lit(limit) - F.col("used")) if limit else F.lit(None).cast("long"))


def failure_rate(log: DataFrame, key: str, place: str, failed: Column, n: int) -> DataFrame:
    """Each row with the share of failures among its key's last n rows, itself included."""
    return log.withColumn("failure_rate", F.avg(failed.cast("double")).over(Window.partitionBy(key).orderBy(place).rowsBetween(1 - n, 0)))


def tail(log: DataFrame, id_col: str, since: int, n: int) -> DataFrame:
    """The newest n rows after a cursor."""
    return log.where(F.col(id_col) > since).orderBy(F.desc(id_col)).limit(n)


def may_scan(ready: Column, most: int) -> Column:
    """Whether more may be looked for: only while fewer rows than that wait."""
    return ready < most


def delays(rated: DataFrame, key: str, place: str, rate: str, base: float, least: float, most: float, shrink: float = 0.9, slope: float = 6.0) -> DataFrame:
    """rated with the delay after each row, which goes down by a factor while nothing fails and follows the failure rate otherwise.

    After a row with failures the delay doesn't depend on what was before. So each row takes that of the last such row
    (or base) and shrinks it by the number of rows since, down to `least`: two windows, no recursion.
    """
    w = Window.partitionBy(key).orderBy(place)
    failing = F.least(F.lit(most), F.lit(base) * (1 + F.lit(slope) * F.col(rate)))
    n = F.row_number().over(w)
    numbered = rated.withColumn("brindle_n", n)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(rate) > 0, F.struct(F.col("brindle_n").alias("n"), failing.alias("delay"))), True).over(back)
    marked = numbered.withColumn("brindle_last", last)
    since = F.col("brindle_n") - F.coalesce(F.col("brindle_last.n"), F.lit(0))
    start = F.coalesce(F.col("brindle_last.delay"), F.lit(base))
    delay = F.when(since == 0, start).otherwise(F.greatest(F.lit(least), start * F.pow(F.lit(shrink), since)))
    return marked.withColumn("delay", delay).drop("brindle_n", "brindle_last")


def stop_at(pages: DataFrame, key: str, page: str, known: Column, content: Column, run: int) -> DataFrame:
    """(key, stop_at): the first page that ends `run` pages of known rows, or is the same as the one before; null if none."""
    w = Window.partitionBy(key).orderBy(page)
    all_known = F.min(known.cast("int")).over(w.rowsBetween(1 - run, 0)) == 1
    whole = F.row_number().over(w) >= run
    marked = pages.withColumn("brindle_stop", (all_known & whole) | F.coalesce(F.lag(content).over(w) == content, F.lit(False)))
    return marked.groupBy(key).agg(F.min(F.when(F.col("brindle_stop"), F.col(page))).alias("stop_at"))
