import datetime

import pytest
from pyspark.sql import functions as F

from brindle.operators import facets, merge, queue, ranking, threads


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_row_numbers_of_one_large_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("k"), (-F.col("id")).alias("v"))
    got = {(r["k"], r["v"]): r["n"] for r in ranking.row_numbers(df, ["k"], ["v"], "n").collect()}
    assert len(got) == 5000 and got["hot", -3999] == 1 and got["hot", 0] == 4000 and got["cold", -4999] == 1


def test_ordered_values_drop_blank_and_repeats(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, " ", 0), (1, None, 0), (2, None, 1)], "t int, v string, o int")
    assert rows(threads.ordered_values(df, "t", "v", ["o"])) == [(1, "a", 2), (1, "b", 1)]
    assert rows(threads.ordered_values(df, "t", "v", ["o"], 1)) == [(1, "b", 1)]


@pytest.mark.parametrize("variant, key", [("tid", "tid:f:7"), ("tid_only", "tid:f:7"), ("url_or_hash", "url:https://x/a?tid=7"), ("plain", "https://x/a?tid=7"), ("url", "https://x/a?tid=7")])
def test_thread_keys(spark, variant, key):
    df = spark.createDataFrame([(" https://x/a?tid=7", "ab", "f"), ("", "ab", "f"), (None, "ab", "f")], "u string, h string, f string")
    got = [r[0] for r in df.select(threads.thread_key(F.btrim("u"), F.col("h"), F.col("f"), variant, ("f",))).collect()]
    alone = {"tid": "hash:AB", "url_or_hash": "hash:AB", "plain": "AB"}.get(variant)
    assert got == [key, alone, alone]


def test_truncated_names(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "abcdef"), (1, "xyzw"), (1, "xyzw1"), (1, "xyzw2"), (2, "abcd"), (1, None)], "t int, n string")
    got = {(r["t"], r["n"]): r["kept_name"] for r in threads.merge_truncated(df, "t", "n").collect()}
    assert got[1, "abcd"] == "abcdef" and got[1, "xyzw"] == "xyzw" and got[2, "abcd"] == "abcd"


def test_board_choice(spark):
    df = spark.createDataFrame([("103:480", "bench"), ("95:716", "X · Y"), ("1", ""), (None, "fid-1")], "f string, n string")
    assert [r[0] for r in df.select(threads.board_score(F.col("f"), F.col("n"))).collect()] == [27, 47, 0, 1]


def test_scale_keeps_the_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "value string, n long")
    assert sum(r["n"] for r in facets.scale(df, 100).collect()) == 100
    assert facets.scale(df.limit(0), 100).count() == 0


def test_roll_up(spark):
    df = spark.createDataFrame([("P", 400), ("P · A", 50), ("Q", 1)], "value string, n long")
    assert rows(facets.roll_up(df)) == [("P", 450), ("Q", 1)]


def test_queue_states(spark):
    t = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", 1, "retry", t, 5.0), ("b", 1, "retry", t, 90.0), ("b", 2, "done", t, 0.0), ("c", 1, "retry", t, 1.0), ("c", 2, "retry", t, 1.0), ("c", 3, "retry", t, 1.0)], "k string, i int, kind string, at timestamp, s double")
    got = {r["k"]: r for r in queue.fold_log(log, "k", "i", "kind", "at", "s").collect()}
    assert got["a"]["state"] == "pending" and got["a"]["retry_after"] == t + datetime.timedelta(seconds=30)
    assert got["b"]["state"] == "done" and got["c"]["state"] == "failed" and got["c"]["retry_after"] is None


def test_claim_and_retryable(spark):
    q = spark.createDataFrame([(1, "pending", 0), (2, "pending", 0), (3, "done", 4)], "id int, status string, attempts int")
    assert rows(queue.claim(q, 1, "id", [F.desc("id")])) == [(1, "pending", 0), (2, "running", 1), (3, "done", 4)]
    e = spark.createDataFrame([("x", 1, "error"), ("x", 2, "error"), ("y", 3, "error"), ("y", 4, "pending")], "code string, id int, status string")
    assert rows(queue.retryable(e, "code", "id")) == [("x", 2)]


def test_keep_only_leaves_scopes_without_kept_rows(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c"), ("u", None)], "u string, h string")
    kept = df.where("h = 'a'")
    assert sorted(map(str, merge.keep_only(df, kept, "u", "h").collect())) == sorted(map(str, df.where("h in ('a', 'c')").collect()))
    assert merge.keep_only(df, kept.limit(0), "u", "h").count() == 4


def test_insert_absent(spark):
    old = spark.createDataFrame([(3, "a")], "id int, k string")
    new = spark.createDataFrame([("a", 1), ("c", 1), ("b", 1), ("b", 2)], "k string, x int")
    assert rows(merge.insert_absent(old, new, "k", "id")) == [(3, "a"), (4, "b"), (5, "c")]


def test_samples_avoid_what_is_excluded(spark):
    from brindle.operators import sampling

    out = spark.createDataFrame([(2,), (4,), (None,)], "tid long")
    assert rows(sampling.sample_ids(out, "tid", 1, 5, 10)) == [(1,), (3,), (5,)]
    first = rows(sampling.sample_ids(out, "tid", 100, 200, 10))
    assert len(set(first)) == 10 and all(100 <= r[0] <= 200 for r in first)
    assert first == rows(sampling.sample_ids(out, "tid", 100, 200, 10)) and first != rows(sampling.sample_ids(out, "tid", 100, 200, 10, seed=1))
    assert sampling.window_quotas([(0, 9, 1.0), (10, 19, 2.0)], 10) == [3, 7] and sampling.window_quotas([], 5) == []


def test_filled_rows_are_dealt_out_once(spark):
    from brindle.operators import frames

    rows = spark.createDataFrame([(t, f"n{t % 2}", f"l{i}", i, "i", 0) for t in range(50) for i in range(3)], "t long, name string, link string, size long, image string, stated long")
    args = (rows, "t", "name", "link", "size", "image", "stated")
    out = frames.fill(*args, tasks=11)
    assert out.rdd.getNumPartitions() == 11 and out.exceptAll(frames.fill(*args)).count() == 0 and out.count() == 50
