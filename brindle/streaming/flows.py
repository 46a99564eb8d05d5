"""Structured Streaming: rates by window, queue state by key with back-off, and enqueueing of what is new."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators import queue


def rates(log: DataFrame, at: str, keys: list[str], window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): rows by window. In a stream, windows come out once they are older than `late`.

    Only one count a key and open window is held as state. A batch gives all windows.
    """
    marked = log.withWatermark(at, late) if log.isStreaming else log
    return marked.groupBy(*keys, F.window(at, window, slide or window).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_minute(n: Column, oldest: Column, now: Column, seconds: int = 60) -> Column:
    """A count as a rate a minute over the time since the oldest, which counts as 3 s at least; half-even rounding."""
    span = F.least(F.greatest(now.cast("double") - oldest.cast("double"), F.lit(3.0)), F.lit(float(seconds)))
    return F.bround(n * 60 / span, 0).cast("long")


def queue_states(log: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, fails, state, retry_after): the state of each key after its newest rows, as they come.

    log: key, seq long, kind (done, skip or retry), at timestamp, seconds double. State is two numbers a key; rows of a
    key within one batch are taken by seq. A retry defers by at least 30 s, and the third in a row fails.
    """
    kept = log.select(F.col(key).alias("key"), "seq", "kind", F.col("at").cast("timestamp").alias("at"), "seconds")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, last, until = (*state.get, None) if state.exists else (0, -1, None)
        name = "pending"
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.seq <= last:  # a row that came again
                continue
            last = r.seq
            fails = fails + 1 if r.kind == "retry" else 0
            name = {"done": "done", "skip": "skipped"}.get(r.kind, "failed" if fails >= most else "pending")
            # whole microseconds, which is what a timestamp holds
            until = r.at + pd.Timedelta(microseconds=round(max(30.0, r.seconds or 0.0) * 1_000_000)) if name == "pending" else None
        state.update((fails, int(last)))
        yield pd.DataFrame({"key": [k[0]], "fails": [fails], "state": [name], "retry_after": pd.Series([until], dtype="datetime64[ns]")})

    kind = kept.schema["key"].dataType.simpleString()
    return kept.groupBy("key").applyInPandasWithState(step, f"key {kind}, fails int, state string, retry_after timestamp", "fails int, last long", "update", GroupStateTimeout.NoTimeout)


def enqueue_new(read_queue: Callable[[], DataFrame], append: Callable[[DataFrame], None], url: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends what the queue doesn't hold yet; a batch that comes again adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        append(queue.enqueue(read_queue(), batch, url))

    return run
