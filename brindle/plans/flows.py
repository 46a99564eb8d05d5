"""Registered queries that go through files and streams, and the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from brindle.plans.catalogue import query, table
from brindle.session import Scratch
from brindle.sources import backup
from brindle.streaming import flows, timers


def _stream(spark, sf_dir, name: str):
    """A table as a stream; the pattern lets it be a single file as well as a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque?")


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).base


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || '''s' AS p_name, nullif(p_type, 'SMALL') AS p_type FROM part")
def s05_backup(spark, sf_dir):
    """Parts dumped as INSERT statements and read back."""
    at = _folder(spark, "dump")
    backup.dump(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("'s")).alias("p_name"), F.nullif("p_type", F.lit("SMALL")).alias("p_type")), "part", at)
    return backup.rows_of(backup.read(spark, at), "part", ["p_partkey", "p_name", "p_type"]).drop("file", "place")


@query("SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def z01_stream_rate(spark, sf_dir):
    """Events by type and minute, streamed; the windows that are closed when the stream ends."""
    out = _folder(spark, "rates")
    source = _stream(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    writer = flows.rates(source, "ts", ["event_type"]).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY user_id")
def z10_enqueue_batches(spark, sf_dir):
    """Counts by key of rows that a stream enqueued in batches, each address once."""
    out = _folder(spark, "queue")
    events = table(spark, sf_dir, "events")
    events.select(F.col("event_id").alias("url"), "user_id", "event_type").limit(0).write.parquet(f"{out}/rows")
    source = _stream(spark, sf_dir, "events").where("event_type in ('purchase', 'signup', 'error')").select(F.col("event_id").alias("url"), "user_id", "event_type")
    add = flows.enqueue_new(lambda: spark.read.parquet(f"{out}/rows"), lambda df: df.write.mode("append").parquet(f"{out}/rows"), "url")
    source.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("user_id").alias("key")).agg(F.count_if(F.col("event_type") == "purchase").alias("done"))


def _packed(rows, key: str, line: str):
    """(path, content): lines gathered to files, which are plain, gzip or zip by their number, whatever their names say."""
    @F.pandas_udf("binary")
    def pack(n: pd.Series, lines: pd.Series) -> pd.Series:
        import gzip
        import io
        import zipfile

        def one(i: int, text: str) -> bytes:
            raw = text.encode()
            if i % 3 == 0:
                return raw
            if i % 3 == 1:
                return gzip.compress(raw)
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("notes.sql", "-- nothing")
                z.writestr("x/data.sql.gz", gzip.compress(raw))
            return held.getvalue()

        return pd.Series([one(i, t) for i, t in zip(n, lines)])

    grouped = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("ls"))
    return grouped.select(F.concat(F.col(key).cast("string"), F.lit(".gz")).alias("path"), pack(key, F.concat(F.lit("COPY p (k, name) FROM stdin;\n"), "ls", F.lit("\n\\.\n"))).alias("content"))


@query("SELECT p_partkey::VARCHAR AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 'INSERT INTO p (k) VALUES (1);' ELSE p_name END AS name FROM part")
def s03_packed(spark, sf_dir):
    """Rows read from files that are plain, gzip or zip, some of which look like headers."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, "\\N").when(k % 7 == 1, "INSERT INTO p (k) VALUES (1);").otherwise(F.col("p_name"))
    file = k % 12 + 12 * F.floor(k / 24000)  # 2000 parts at most, so that files grow in number and not in size
    rows = table(spark, sf_dir, "part").select(file.alias("file"), F.concat(k.cast("string"), F.lit("\t"), name).alias("line"))
    return backup.rows_of(backup.rows_in(backup.packed_lines(_packed(rows, "file", "line"))), "p", ["k", "name"]).drop("file", "place")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name || '''s (a), b' WHEN 2 THEN p_size::VARCHAR ELSE 'true' END AS value, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || chr(9) || p_type || '\\' END AS field, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 2 END AS n FROM part")
def s06_literals(spark, sf_dir):
    """Values of INSERT, fields of COPY, and arrays in texts."""
    k, quoted = F.col("p_partkey"), F.concat(F.lit("'"), "p_name", F.lit("''s (a), b'"))
    literal = F.when(k % 4 == 0, "NULL").when(k % 4 == 1, quoted).when(k % 4 == 2, F.col("p_size").cast("string")).otherwise("true")
    field = F.when(k % 3 == 0, "\\N").otherwise(F.concat("p_name", F.lit("\\t"), "p_type", F.lit("\\\\")))
    array = F.when(k % 5 == 0, '{a,"b,\\"c",NULL}').otherwise('{"x y",z}')
    return table(spark, sf_dir, "part").select("p_partkey", backup.sql_literal(literal).alias("value"), backup.copy_field(field).alias("field"), F.size(backup.text_array(array)).alias("n"))


@query("SELECT 'part' AS \"table\", count(*) AS n, count(*) AS exported, true AS same FROM part")
def k23_dump_counts(spark, sf_dir):
    """A dump read back has as many rows as its table."""
    from brindle.operators import records

    at, part = _folder(spark, "counted"), table(spark, sf_dir, "part")
    written = backup.dump(part.select("p_partkey", "p_name"), "part", at)
    read = backup.rows_of(backup.read(spark, at), "part", ["p_partkey"])
    return records.table_counts({"part": read}, spark.createDataFrame([("part", written)], "table string, exported long"))


@query("""WITH e AS (SELECT user_id, event_id, ts, value, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'error')), m AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type <> 'error'), -1) AS ended FROM e GROUP BY user_id),
s AS (SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error') AS fails, arg_max(event_type, event_id) AS last FROM e JOIN m ON e.user_id = m.user_id AND event_id >= ended GROUP BY e.user_id)
SELECT user_id AS key, fails::INT AS fails, CASE WHEN last = 'purchase' THEN 'done' WHEN last = 'signup' THEN 'skipped' WHEN fails >= 3 THEN 'failed' ELSE 'pending' END AS state FROM s""")
def z04_stream_states(spark, sf_dir):
    """The state of each user's queue, kept by a stream."""
    out = _folder(spark, "states")
    kind = F.expr("case event_type when 'purchase' then 'done' when 'signup' then 'skip' else 'retry' end")
    source = _stream(spark, sf_dir, "events").where("event_type in ('purchase', 'signup', 'error')").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"), F.col("value").alias("seconds"))
    writer = flows.queue_states(source, "user_id").writeStream.outputMode("update").option("checkpointLocation", f"{out}/state")
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/rows").groupBy("key").agg(F.max_by(F.struct("fails", "state"), "batch").alias("s"))
    return last.select("key", "s.fails", "s.state")


_KINDS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skip' WHEN 'error' THEN 'retry' ELSE 'claim' END"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, {_KINDS} AS kind, value FROM events), g AS (SELECT *, lead(ts) OVER w AS following, count(*) FILTER (WHERE kind IN ('done', 'skip')) OVER w AS span FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, CASE WHEN kind IN ('done', 'skip') THEN 0 ELSE count(*) FILTER (WHERE kind = 'retry') OVER (PARTITION BY user_id, span ORDER BY event_id) END AS fails FROM g),
u AS (SELECT *, date_trunc('milliseconds', ts) + to_milliseconds(CASE WHEN kind = 'claim' THEN 600000 WHEN kind = 'retry' AND fails < 3 THEN floor(greatest(30, coalesce(value, 0)) * 1000)::BIGINT END) AS until FROM f)
SELECT user_id AS key, ts::TIMESTAMP AS at, CASE kind WHEN 'done' THEN 'done' WHEN 'skip' THEN 'skipped' WHEN 'claim' THEN 'running' ELSE CASE WHEN fails >= 3 THEN 'failed' ELSE 'waiting' END END AS state, fails::INT AS fails FROM u
UNION ALL SELECT user_id, until::TIMESTAMP, 'ready', fails::INT FROM u WHERE until <= date_trunc('milliseconds', following) OR (following IS NULL AND until < (SELECT date_trunc('milliseconds', max(ts)) FROM events))""")
def z04_timers(spark, sf_dir):
    """Every change of each user's job, kept by a stream: retries that come due and leases that run out fire as time passes."""
    out = _folder(spark, "timers")
    log = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.expr(_KINDS).alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("double").alias("seconds"))
    return _timed(spark, timers.job_states(log), out).select("key", F.col("at").cast("timestamp_ntz").alias("at"), "state", "fails")


def _timed(spark, df, out: str):
    """The rows of a stream with timers, once all of its input has been read."""
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")
    with timers.timed_state(spark):
        df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""WITH s AS (SELECT DISTINCT event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), n AS (SELECT *, lead(s) OVER (PARTITION BY key ORDER BY s) AS following FROM s)
SELECT key, make_timestamp((s + 60) * 1000000) AS at FROM n WHERE following >= s + 60 OR (following IS NULL AND (s + 60) * 1000 < (SELECT epoch_ms(max(ts)) FROM events))""")
def z01_idle(spark, sf_dir):
    """When the rate of each kind of event fell to none, a minute after its last one, without any row to tell."""
    out = _folder(spark, "idle")
    log = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return _timed(spark, timers.decaying_rates(log), out).where("n = 0").select("key", F.col("at").cast("timestamp_ntz").alias("at"))
