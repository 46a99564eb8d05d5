import datetime
import gzip

from pyspark.sql import functions as F

from brindle.sources import backup, tables
from brindle.streaming import flows

SQL = """BEGIN;
INSERT INTO public.tags (id, name) VALUES (1, 'it''s; (a)'), (2, NULL);
INSERT INTO tags (id, name)
VALUES (3,
'two');
DELETE FROM x;
COPY public.items (hash, size, links) FROM stdin;
aa\t1\t{a,"b,\\\\"c",NULL}
AA\t2\t\\N
bb\t3\tx\\ty\\\\n
\\.
SELECT 1;
COPY skipped (a) FROM stdin;
z
\\.
"""


def test_backup(spark, tmp_path):
    (tmp_path / "a.sql").write_text(SQL)
    with gzip.open(tmp_path / "b.sql.gz", "wt") as f:
        f.write("COPY items (hash, size, links) FROM stdin;\nbb\t9\t\\N\n\\.\n")
    got = backup.read(spark, str(tmp_path), ("skipped",))
    assert {r["table"] for r in got.collect()} == {"tags", "items"}
    assert sorted(backup.rows_of(got, "tags", ["id", "name"]).select("id", "name").collect()) == [("1", "it's; (a)"), ("2", None), ("3", "two")]
    items = backup.rows_of(got, "items", ["hash", "size", "links"])
    assert {(r["hash"], r["size"]) for r in backup.last_by_key(items, "hash").collect()} == {("AA", "2"), ("BB", "9")}
    found = {r["size"]: (r["links"], r["a"]) for r in items.select("size", "links", backup.text_array(F.col("links")).alias("a")).collect()}
    assert found["1"][1] == ["a", 'b,"c', None] and found["2"] == (None, None) and found["3"][0] == "x\ty\\n"


def test_backup_of_many_blocks(spark, tmp_path):
    (tmp_path / "a.sql").write_text("COPY t (a, b) FROM stdin;\n" + "".join(f"{i}\tx{i}\n" for i in range(3000)) + "\\.\nignored\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = backup.rows_of(backup.read(spark, str(tmp_path)), "t", ["a", "b"])
        assert got.count() == 3000 and got.where("b <> concat('x', a)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_data_that_looks_like_a_header(spark, tmp_path):
    rows = ["INSERT INTO t (a, b) VALUES (1);\tx", "COPY t (a) FROM stdin;\ty", "plain;\tz"]
    body = "COPY t (a, b) FROM stdin;\n" + "\n".join(rows) + "\n\\.\nINSERT INTO u (a, b) VALUES\n('COPY t (a) FROM stdin', 'INSERT INTO x;y'),\n(now(), 'two\nlines'),\n('it''s', NULL);\nCOPY t (a, b) FROM stdin;\nlast\tw\n\\.\n"
    (tmp_path / "a.sql").write_text(body)
    for size in ("100000", "60"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = backup.read(spark, str(tmp_path))
            assert sorted(r["a"] + "|" + r["b"] for r in backup.rows_of(got, "t", ["a", "b"]).collect()) == sorted([*(r.replace("\t", "|") for r in rows), "last|w"])
            assert sorted(map(str, (tuple(r) for r in backup.rows_of(got, "u", ["a", "b"]).select("a", "b").collect()))) == sorted(map(str, [("COPY t (a) FROM stdin", "INSERT INTO x;y"), ("now()", "two lines"), ("it's", None)]))
            assert backup.odd_rows(got).count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_files(spark, tmp_path):
    import io
    import zipfile

    text = "COPY t (a) FROM stdin;\nx\n\\.\n".encode()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("z.txt", "COPY t (a) FROM stdin;\nwrong\n\\.\n")
        z.writestr("d/a.sql", "COPY t (a) FROM stdin;\nwrong\n\\.\n")
        z.writestr("d/b.sql.gz", gzip.compress(text))
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("readme.txt", "none")
    for name, content in (("plain.gz", text), ("packed.sql", gzip.compress(text)), ("zip.bin", held.getvalue()), ("bare.zip", bare.getvalue()), ("empty", b"")):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = backup.rows_of(backup.rows_in(backup.packed_lines(files)), "t", ["a"]).collect()
    assert sorted((r["file"].rpartition("/")[2], r["a"]) for r in got) == [("packed.sql", "x"), ("plain.gz", "x"), ("zip.bin", "x")]
    named = backup.rows_of(backup.rows_in(backup.packed_lines(files, "a.sql")), "t", ["a"]).where("file like '%zip.bin'")
    assert [r["a"] for r in named.collect()] == ["wrong"]


def test_dump_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's"), (2, None)], "id int, name string")
    assert backup.dump(df, "t", str(tmp_path / "d")) == 2
    got = backup.rows_of(backup.read(spark, str(tmp_path / "d")), "t", ["id", "name"])
    assert sorted(got.select("id", "name").collect()) == [("1", "it's"), ("2", None)]


def test_align_and_nul(spark):
    df = spark.createDataFrame([("1", ["a\0", "\0"])], "a string, b array<string>")
    assert tables.without_nul(df).first()["b"] == ["a"]
    assert tables.align(df, spark.createDataFrame([], "c long, a int").schema).first().asDict() == {"c": None, "a": 1}


def test_rate(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(5, t, t + datetime.timedelta(seconds=4)), (1, t, t)], "n long, a timestamp, b timestamp")
    assert [r[0] for r in df.select(flows.per_minute(F.col("n"), F.col("a"), F.col("b"))).collect()] == [75, 20]


def _stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_stream_of_states_equals_batch(spark, tmp_path):
    from brindle.operators import queue

    t = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 7}", i, ["retry", "retry", "done", "retry", "skip"][(i * i) % 5], t + datetime.timedelta(seconds=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, kind string, at timestamp, seconds double")
    s = flows.queue_states(_stream(spark, df.coalesce(1), tmp_path / "in"), "k").writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    got = sorted(map(tuple, spark.table("states").select("key", "fails", "state", "retry_after").collect()), key=str)
    assert got == sorted(map(tuple, queue.fold_log(df, "k", "seq", "kind", "at", "seconds").select("k", "fails", "state", "retry_after").collect()), key=str)


def test_stream_of_rates(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + datetime.timedelta(seconds=20 * i)) for i in range(100)], "k string, at timestamp")
    s = flows.rates(_stream(spark, df, tmp_path / "in"), "at", ["k"]).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["n"] for r in got} == {3} and len(got) == (99 * 20 - 600) // 60
    assert flows.rates(df, "at", ["k"]).agg(F.sum("n")).first()[0] == 100


def test_enqueue_in_batches(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.createDataFrame([("a", 1)], "url string, n int").write.parquet(path)
    run = flows.enqueue_new(lambda: spark.read.parquet(path), lambda df: df.write.mode("append").parquet(path), "url")
    batch = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "url string, n int")
    run(batch, 0)
    run(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3)]


def test_queue_states_of_odd_delays(spark, tmp_path):
    rows = [("a", 1, "retry", datetime.datetime(2024, 1, 30, 15, 22, 51, 247574), 210.000000001), ("b", 1, "retry", datetime.datetime(2024, 1, 1), 76.1234567), ("c", 1, "retry", datetime.datetime(2024, 1, 1), None)]
    log = spark.createDataFrame(rows, "k string, seq long, kind string, at timestamp, seconds double")
    s = flows.queue_states(_stream(spark, log.coalesce(1), tmp_path / "in"), "k").writeStream.outputMode("update").format("memory").queryName("odd_delays").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    s.awaitTermination()
    got = {r["key"]: r["retry_after"] for r in spark.table("odd_delays").collect()}
    assert got == {"a": datetime.datetime(2024, 1, 30, 15, 26, 21, 247574), "b": datetime.datetime(2024, 1, 1, 0, 1, 16, 123457), "c": datetime.datetime(2024, 1, 1, 0, 0, 30)}


def test_packed_files_grow_in_number(spark, monkeypatch):
    from brindle.plans import flows

    parts = spark.range(1, 60001).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"))
    made, packed = [], flows._packed
    monkeypatch.setattr(flows, "table", lambda *_: parts)
    monkeypatch.setattr(flows, "_packed", lambda rows, *names: made.append(rows) or packed(rows, *names))
    assert flows.s03_packed(spark, "").count() == 60000
    sizes = [r["count"] for r in made[0].groupBy("file").count().collect()]
    assert max(sizes) <= 2000 and sum(sizes) == 60000
