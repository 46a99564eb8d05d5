"""Streams that act when time passes: retries that come due, leases that fall back, rates that decay without new rows.

State and timers are kept by Spark per key. Rows of a key and its timers are taken in the order of their times, so that what comes
out is the same however the stream is cut into batches. In event time, timers fire as the watermark passes them; in
processing time, as the clock does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that holds timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The least delay of a retry and the life of a lease in seconds, retries until a job fails, the window of a rate.
LEAST_DELAY, LEASE, MOST_RETRIES, WINDOW = 30.0, 600.0, 3, 60
#: Rows that leave a task, or wait in it to be counted, at a time.
AT_ONCE = 10_000
TRANSITIONS = "key {0}, at timestamp, state string, fails int"
RATES = "key {0}, at timestamp, n long, per_minute long"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within may have timers."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Jobs(StatefulProcessor):
    """The life of one job: claim, done, skip and retry rows, and what time does to it.

    A claimed job is running until its lease ends, when it is ready again. A retry waits LEAST_DELAY seconds or as long as it
    says, and then is ready; the last of MOST_RETRIES in a row fails. Rows of a key are taken by their
    numbers, which must follow their times; those that came before are skipped.
    """

    def __init__(self, most: int, lease: float):
        self.most, self.lease = most, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "fails int, seq long, until long")

    def _due(self, key: tuple, until: int, fails: int) -> tuple:
        return (key[0], _at(until), "ready", fails)

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["key", "at", "state", "fails"])
            yield out.astype({"fails": "int32"})

    def _set(self, fails: int, seq: int, until: int, before: int) -> None:
        if before >= 0 and before != until:
            self.handle.deleteTimer(before)
        if until >= 0 and before != until:
            self.handle.registerTimer(until)
        self.job.update((fails, seq, until))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fails, seq, until = self.job.get() if self.job.exists() else (0, -1, -1)
        before, out = until, []
        columns = ("seq", "kind", "at", "seconds")
        # a key has few rows, so lists take less time than frames
        for number, kind, at, seconds in sorted((r for f in rows for r in zip(*(f[c].tolist() for c in columns))), key=lambda r: r[0]):
            if number <= seq:
                continue
            now, seq = _ms(at), int(number)
            if 0 <= until <= now:  # came due before this row
                out.append(self._due(key, until, fails))
            until, state = -1, {"done": "done", "skip": "skipped", "claim": "running"}.get(kind, "waiting")
            if state == "running":
                until = now + int(self.lease * 1000)
            elif state == "waiting":
                fails += 1
                if fails >= self.most:
                    state = "failed"
                else:
                    until = now + int(max(LEAST_DELAY, 0.0 if pd.isna(seconds) else seconds) * 1000)
            else:
                fails = 0
            out.append((key[0], at, state, fails))
        self._set(fails, seq, until, before)
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fails, seq, until = self.job.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if until == due:
            self.job.update((fails, seq, -1))
            yield from self._frame([self._due(key, due, fails)])

    def close(self) -> None:
        pass


def _by_second(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """(second, rows) in order: rows are counted frame by frame, so that only their seconds are held, not they."""
    held, n = [(np.array([], "int64"), np.array([], "int64"))], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        seconds, where = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
        counts = np.zeros(len(seconds), "int64")
        np.add.at(counts, where, np.concatenate([c for _, c in held]))
        return seconds, counts

    for f in frames:
        part = np.unique(f["at"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000_000, return_counts=True)
        held.append(part)
        n += len(part[0])
        if n > max(AT_ONCE, 2 * len(held[0][0])):
            held, n = [merged()], 0
    seconds, counts = merged()
    for i in range(0, len(seconds), AT_ONCE):
        yield from zip(seconds[i : i + AT_ONCE].tolist(), counts[i : i + AT_ONCE].tolist())


class Rates(StatefulProcessor):
    """Rows of a key within the last `window` seconds, as counts by second, so that state is bounded whatever the traffic.

    A row tells the rate at once; when the oldest second leaves the window a timer tells the lower one, down to none.
    """

    def __init__(self, window: int, clock: bool):
        self.window, self.clock = window, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "second long", "n long")

    def _row(self, key: tuple, counts: dict[int, int], second: int) -> tuple:
        n = sum(counts.values())
        span = min(max(second - min(counts, default=second), 3), self.window)
        return (key[0], _at(second * 1000), n, round(n * 60 / span))

    def _leave(self, key: tuple, counts: dict[int, int], upto: int) -> Iterator[tuple]:
        """What comes out as seconds leave the window, up to a second."""
        while counts and min(counts) + self.window <= upto:
            second = min(counts) + self.window
            del counts[min(counts)]
            yield self._row(key, counts, second)

    def _save(self, before: dict[int, int], counts: dict[int, int]) -> None:
        for s in before.keys() - counts.keys():
            self.counts.removeKey((s,))
        for s, n in counts.items():
            if before.get(s) != n:
                self.counts.updateValue((s,), (n,))
        old, new = (min(c) + self.window if c else None for c in (before, counts))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old * 1000)
            if new is not None:
                self.handle.registerTimer(new * 1000)

    def _held(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.counts.iterator()}

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", "at", "n", "per_minute"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        counts, out = dict(before), []
        newest = max(counts, default=0)
        for second, n in _by_second(rows):
            if second + self.window <= newest:
                continue  # already left
            out.extend(self._leave(key, counts, second))
            newest = max(newest, second)
            counts[second] = counts.get(second, 0) + int(n)
            out.append(self._row(key, counts, newest))
            if len(out) >= AT_ONCE:
                yield from self._frame(out)
                out = []
        self._save(before, counts)
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        counts = dict(before)
        # a timer that is set now waits for the next batch, so all that is due leaves at once
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs()
        out = list(self._leave(key, counts, max(now, expiredTimerInfo.getExpiryTimeInMs()) // 1000))
        for s in before.keys() - counts.keys():
            self.counts.removeKey((s,))
        if counts:
            self.handle.registerTimer((min(counts) + self.window) * 1000)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def _run(log: DataFrame, processor: StatefulProcessor, schema: str, late: str | None) -> DataFrame:
    kind = log.schema["key"].dataType.simpleString()
    marked = log.withWatermark("at", late) if late is not None else log
    return marked.groupBy("key").transformWithStateInPandas(processor, schema.format(kind), "Update", "EventTime" if late is not None else "ProcessingTime")


def job_states(log: DataFrame, most: int = MOST_RETRIES, lease: float = LEASE, late: str | None = "0 seconds") -> DataFrame:
    """(key, at, state, fails): each change of a job's state, those that time makes included. See Jobs.

    log: key, seq long, kind (claim, done, skip, retry), at timestamp, seconds double. late: the watermark's delay; None
    takes the clock instead. Start the stream within timed_state().
    """
    return _run(log.select("key", "seq", "kind", "at", "seconds"), Jobs(most, lease), TRANSITIONS, late)


def decaying_rates(log: DataFrame, window: int = WINDOW, late: str | None = "0 seconds") -> DataFrame:
    """(key, at, n, per_minute): rows within the last `window` seconds whenever that changes, also as they leave. See Rates.

    log: key, at timestamp. per_minute spreads n over the time since the oldest, 3 seconds at least.
    """
    return _run(log.select("key", "at"), Rates(window, late is None), RATES, late)
