"""Streams with timers: time moves on without rows of a key, and the cut into batches makes no difference."""

import datetime
import random

import pytest

from brindle.streaming import timers

START = datetime.datetime(2024, 1, 1)
JOBS, TIMES = "key string, seq long, kind string, at timestamp, seconds double", "key string, at timestamp"


def at(s):
    return START + datetime.timedelta(seconds=s)


def run(spark, tmp_path, schema, make, batches):
    """All rows out of a stream whose input comes in several runs."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with timers.timed_state(spark):
            stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            keep = lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def jobs_by_hand(rows, end):
    out, state = [], {}
    for key, seq, kind, when, seconds in sorted(rows, key=lambda r: r[1]):
        fails, until = state.get(key, (0, None))
        if until is not None and until <= when:
            out.append((key, until, "ready", fails))
        until = None
        if kind == "claim":
            name, until = "running", when + datetime.timedelta(seconds=600)
        elif kind == "retry":
            fails += 1
            name = "failed" if fails >= 3 else "waiting"
            until = when + datetime.timedelta(seconds=max(30.0, seconds or 0.0)) if name == "waiting" else None
        else:
            name, fails = {"done": "done", "skip": "skipped"}[kind], 0
        out.append((key, when, name, fails))
        state[key] = (fails, until)
    return sorted(out + [(k, until, "ready", fails) for k, (fails, until) in state.items() if until is not None and until < end])


@pytest.mark.parametrize("cuts", [1, 3])
def test_jobs(spark, tmp_path, cuts):
    rng = random.Random(3)
    times = sorted(rng.sample(range(4000), 60))
    rows = [(rng.choice("abc"), i, rng.choice(["claim", "claim", "retry", "retry", "done", "skip"]), at(t), rng.choice([None, 5.0, 90.5])) for i, t in enumerate(times)]
    rows.append(("z", 99, "done", at(9000), None))  # only time passes for the others
    step = -(-len(rows) // cuts)
    got = run(spark, tmp_path, JOBS, timers.job_states, [rows[i : i + step] for i in range(0, len(rows), step)])
    assert got == jobs_by_hand(rows, at(9000))


def test_rows_that_come_again(spark, tmp_path):
    rows = [("a", 1, "retry", at(0), None), ("a", 2, "claim", at(10), None)]
    got = run(spark, tmp_path, JOBS, timers.job_states, [rows, [*rows, ("b", 3, "done", at(11), None)]])
    assert got == [("a", at(0), "waiting", 1), ("a", at(10), "running", 1), ("b", at(11), "done", 0)]


def test_rates_decay(spark, tmp_path):
    batches = [[("a", at(0)), ("a", at(0.5)), ("a", at(20)), ("b", at(30))], [("b", at(75))], [("b", at(300))]]
    got = run(spark, tmp_path, TIMES, timers.decaying_rates, batches)
    assert [r for r in got if r[0] == "a"] == [("a", at(0), 2, 40), ("a", at(20), 3, 9), ("a", at(60), 1, 2), ("a", at(80), 0, 0)]
    assert [r[1:3] for r in got if r[0] == "b"] == [(at(30), 1), (at(75), 2), (at(90), 1), (at(135), 0), (at(300), 1)]


def test_rows_are_counted_by_second_without_holding_them(monkeypatch):
    import collections

    import pandas as pd

    monkeypatch.setattr(timers, "AT_ONCE", 7)
    dice = random.Random(5)
    times = [pd.Timestamp(at(dice.randrange(40) + 0.25)) for _ in range(500)]
    frames = (pd.DataFrame({"at": times[i : i + 20]}) for i in range(0, 500, 20))
    assert list(timers._by_second(frames)) == sorted(collections.Counter(int(t.timestamp()) for t in times).items())
    assert list(timers._by_second(iter([]))) == []
