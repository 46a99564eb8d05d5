"""SQL backups as tables: INSERT statements and COPY blocks read by lines, and dumps written."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import Scratch

#: One literal of a VALUES row, and one row, in which a call may have its own brackets; possessive, so long texts don't recurse.
_QUOTED = r"'(?:[^']++|'')*+'"
_CALL = rf"\((?:[^'()]++|{_QUOTED})*+\)"
_LITERAL = rf"({_QUOTED}|[^,\s(](?:[^,'()]++|{_CALL}|{_QUOTED})*+)"
_ROW = rf"\(((?:[^'()]++|{_QUOTED}|{_CALL})*+)\)"
_COPY, _INSERT = re.compile(r"(?i)\s*COPY\s.*FROM\s+stdin"), re.compile(r"(?i)\s*INSERT\s+INTO\s")
_ENDS = pa.list_(pa.struct([("before", pa.string()), ("state", pa.string()), ("head", pa.string()), ("hblock", pa.int64()), ("hpos", pa.int64())]))
_LINES = ("file", "block", "pos", "kind", "head", "hblock", "hpos", "line")
_LINE_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, line): lines of text files, gzip by suffix; pos orders the lines of a block, block those of a file."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))


def packed_lines(files: DataFrame, wanted: str = "") -> DataFrame:
    """(file, block, pos, line): lines of whole files (path, content), which may be gzip or zip by what they begin with.

    Of a zip file one member is read: the one named `wanted`, else the first `.sql.gz`, `.gz` or `.sql`, in that order;
    a zip without any gives no rows. Bytes that aren't UTF-8 become replacement characters. files is what
    `spark.read.format("binaryFile")` gives, so a file is at most 2 GB; it is unpacked as a stream.
    """

    def rank(name: str) -> tuple[int, str]:
        base = name.lower().replace("\\", "/").rpartition("/")[2]
        kinds = (base == wanted.lower(), base.endswith(".sql.gz"), base.endswith(".gz"), base.endswith(".sql"))
        return (kinds.index(True) if True in kinds else 9), name.lower()

    def unpacked(raw: io.BufferedIOBase) -> io.BufferedIOBase | None:
        head = raw.read(2)
        raw.seek(0)
        if head == b"PK":
            z = zipfile.ZipFile(raw)
            names = sorted((n for n in z.namelist() if not n.endswith("/")), key=rank)
            return unpacked(io.BufferedReader(z.open(names[0]))) if names and rank(names[0])[0] < 9 else None
        return gzip.open(raw) if head == b"\x1f\x8b" else raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                stream = unpacked(io.BufferedReader(pa.BufferReader(content.as_buffer() or b"")))  # the bytes as they came, without a copy
                rows, n = [], 0
                for line in io.TextIOWrapper(stream, "utf-8", "replace", newline="\n") if stream else ():
                    rows.append(line.rstrip("\r\n"))
                    if len(rows) == 4096:
                        yield batch(path, n, rows)
                        rows, n = [], n + len(rows)
                if rows:
                    yield batch(path, n, rows)

    def batch(path: str, n: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([0] * len(rows), pa.int64()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(rows)], names=["file", "block", "pos", "line"])

    return files.select("path", "content").mapInArrow(run, "file string, block long, pos long, line string")


def _after(state: str, head: str | None, line: str) -> tuple[str, str | None]:
    """The state behind a line, and the header that is open there: o (none), c (COPY) or i (INSERT).

    In a COPY every line up to `\\.` is data, in an INSERT every line up to one that ends in `;` is its text, whatever
    it looks like.
    """
    if state == "c":
        return ("o", None) if line.strip() == "\\." else ("c", head)
    if state == "i":
        return ("o", None) if line.rstrip().endswith(";") else ("i", head)
    if _COPY.match(line):
        return "c", line
    if _INSERT.match(line) and not line.rstrip().endswith(";"):
        return "i", line
    return "o", None


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of lines and each state before it: the state behind it and the header that is open there, null if that was open before."""
    at, ways = None, {}

    def close() -> pa.RecordBatch:
        ends = [{"before": k, "state": state, "head": head if own else None, "hblock": at[1] if own else None, "hpos": own - 1 if own else None} for k, (state, head, own) in ways.items()]
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([ends], _ENDS)], names=["file", "block", "ends"])

    for b in batches:
        for file, block, pos, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "pos", "line"))):
            if (file, block) != at:
                if at is not None:
                    yield close()
                at, ways = (file, block), {k: (k, None, 0) for k in "oci"}
            for k, (state, head, own) in ways.items():
                after, now = _after(state, head, line)
                ways[k] = (after, now, own if after == state and after != "o" else pos + 1 if after != "o" else 0)
    if at is not None:
        yield close()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that belong to a COPY or INSERT, with its header and the header's place. Rows come with what is open before their block."""
    at, state, head, place = None, "o", None, (0, 0)
    for b in batches:
        out = []
        for file, block, pos, line, before, open_, hblock, hpos in zip(*(b.column(c).to_pylist() for c in ("file", "block", "pos", "line", "state", "head", "hblock", "hpos"))):
            if (file, block) != at:
                at, state, head, place = (file, block), before or "o", open_, (hblock, hpos)
            after, now = _after(state, head, line)
            if state == "c" and after == "c":
                out.append((file, block, pos, "copy", head, *place, line))
            elif state == "i":
                out.append((file, block, pos, "insert", head, *place, line))
            elif state == "o" and after == "o" and _INSERT.match(line):
                out.append((file, block, pos, "insert", line, block, pos, line))
            elif state == "o" and after != "o":
                place = (block, pos)
                if after == "i":
                    out.append((file, block, pos, "insert", line, block, pos, line))
            state, head = after, now
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_LINES, r)) for r in out], pa.schema([(n, t) for n, t in zip(_LINES, _LINE_TYPES)]))


def sql_literal(text: Column) -> Column:
    """A literal as text: NULL as null, quotes taken off and undoubled."""
    t = F.btrim(text)
    return F.when(F.upper(t) == "NULL", None).when(t.startswith("'"), F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))).otherwise(t)


def copy_field(text: Column) -> Column:
    """A field of a COPY line: `\\N` as null, escapes resolved in one pass from left to right."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\\.|[^\\]+|\\$)"), F.lit(1))
    fixed = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f", "\\v": "\v"}
    known = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    plain = F.transform(tokens, lambda t: F.coalesce(known[t], F.when(t.startswith("\\") & (F.length(t) == 2), F.substr(t, F.lit(2))).otherwise(t)))
    return F.when(text == "\\N", None).when(~text.contains("\\"), text).otherwise(F.array_join(plain, ""))


def text_array(text: Column) -> Column:
    """`{a,"b,c",NULL}` as an array of texts; null stays null."""
    inner = F.regexp_replace(text, r"^\s*\{|\}\s*$", "")
    found = F.regexp_extract_all(inner, F.lit(r'("(?:[^"\\]++|\\.)*+"|[^,]+)'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).when(F.upper(x) == "NULL", None).otherwise(x))


def read(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, place, table, columns, values): the rows of INSERT and COPY of SQL text files."""
    return rows_in(lines(spark, path), skip)


def rows_in(text: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, place, table, columns, values): the rows of INSERT and COPY among lines (file, block, pos, line).

    A block's lines follow each other in one task, as lines() gives them. Each task first tells, for its blocks,
    what is open behind them for each thing that can be open before; these few rows are put in a row by
    file, and a second pass then knows for each line what it belongs to. Files are read by as many tasks as
    they have blocks. A COPY goes to the line `\\.`, an INSERT to the line that ends in `;`. Rows of an INSERT are
    read line by line, but for statements with a row or a list of columns that spans lines: the lines of one of
    those meet in one task. place is ordered within a file. Tables named in skip are left out. Empty
    files give no rows.
    """
    ends = text.mapInArrow(_block_ends, "file string, block long, ends array<struct<before:string,state:string,head:string,hblock:long,hpos:long>>")
    per_file = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("blocks"))
    nothing = F.struct(F.lit("o").alias("state"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("hblock"), F.lit(None).cast("long").alias("hpos"))

    def onward(acc: Column, b: Column) -> Column:
        """What is open before the next block, and the list of what is open before each."""
        end = F.get(F.filter(b["ends"], lambda e: e["before"] == acc["now"]["state"]), F.lit(0))
        stays = (end["state"] != "o") & end["head"].isNull()
        pick = lambda c: F.when(stays, acc["now"][c]).otherwise(end[c]).alias(c)
        now = F.struct(end["state"].alias("state"), pick("head"), pick("hblock"), pick("hpos"))
        return F.struct(now.alias("now"), F.array_append(acc["all"], F.struct(b["block"].alias("block"), acc["now"].alias("open"))).alias("all"))

    empty = F.array().cast("array<struct<block:bigint,open:struct<state:string,head:string,hblock:bigint,hpos:bigint>>>")
    begun = per_file.select("file", F.explode(F.aggregate("blocks", F.struct(nothing.alias("now"), empty.alias("all")), onward, lambda acc: acc["all"])).alias("b"))
    # one row a block; lines keep their order, as no shuffle may come between
    known = text.join(F.broadcast(begun.select("file", "b.block", "b.open.*")), ["file", "block"])
    marked = known.select("file", "block", "pos", "line", "state", "head", "hblock", "hpos").mapInArrow(_labelled, "file string, block long, pos long, kind string, head string, hblock long, hpos long, line string")
    at = Scratch(text.sparkSession, "backup").save(marked)  # so that files are read twice, however often their rows are used
    name = F.regexp_replace(F.regexp_extract("head", r'(?i)^\s*(?:COPY|INSERT\s+INTO)\s+([^\s(]+)', 1), r'^.*\.|"', "")
    columns = lambda c: F.transform(F.split(F.regexp_extract(c, r"^[^(]*\(([^)]*)\)", 1), ","), lambda x: F.regexp_replace(F.btrim(x), '"', ""))
    place = F.struct(F.col("block"), F.col("pos"), F.lit(0).alias("i"))
    copied = at.where("kind = 'copy'").select("file", place.alias("place"), name.alias("table"), columns(F.col("head")).alias("columns"), F.transform(F.split("line", "\t"), copy_field).alias("values"))
    plain = F.regexp_replace("line", _QUOTED, "")
    whole = ~plain.contains("'") & (F.length(F.replace(plain, F.lit("("), F.lit(""))) == F.length(F.replace(plain, F.lit(")"), F.lit(""))))
    inserts = at.where("kind = 'insert'").withColumn("whole", whole)
    statement = ["file", "hblock", "hpos"]
    spanning = inserts.where("not whole").select(*statement).distinct()
    first = (F.col("block") == F.col("hblock")) & (F.col("pos") == F.col("hpos"))
    body = F.when(first, F.when(F.col("line").rlike(r"(?i)\bVALUES\b"), F.regexp_replace("line", r"(?is)^.*?\bVALUES\s*", "")).otherwise("")).otherwise(F.regexp_replace("line", r"(?i)^\s*VALUES\s*", ""))
    by_line = inserts.join(spanning, statement, "left_anti").select("file", F.col("block"), F.col("pos"), "head", body.alias("body"))
    gathered = inserts.join(spanning, statement, "left_semi").groupBy(*statement).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "line"))), lambda x: x["line"]), " ").alias("sql"))
    gathered = gathered.select("file", F.col("hblock").alias("block"), F.col("hpos").alias("pos"), F.col("sql").alias("head"), F.regexp_replace("sql", r"(?is)^.*?\bVALUES\s*", "").alias("body"))
    made = by_line.unionByName(gathered).select("file", "block", "pos", "head", F.posexplode(F.regexp_extract_all("body", F.lit(_ROW), F.lit(1))).alias("i", "row"))
    inserted = made.select("file", F.struct("block", "pos", "i").alias("place"), name.alias("table"), columns(F.col("head")).alias("columns"), F.transform(F.regexp_extract_all("row", F.lit(_LITERAL), F.lit(1)), sql_literal).alias("values"))
    return copied.unionByName(inserted).where(~F.col("table").isin(*skip) if skip else F.lit(True))


def odd_rows(backup: DataFrame) -> DataFrame:
    """(table, n): rows that have more or fewer values than columns, which rows_of() leaves out."""
    return backup.where(F.size("columns") != F.size("values")).groupBy("table").agg(F.count("*").alias("n"))


def rows_of(backup: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of a backup with some of its columns as texts, and (file, place)."""
    held = F.map_from_arrays("columns", "values")
    ok = backup.where((F.col("table") == table) & (F.size("columns") == F.size("values")))
    return ok.select("file", "place", *[held[c].alias(c) for c in columns])


def last_by_key(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key in upper case, by file and place; a maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in ("file", "place", key)]
    return rows.where(F.col(key).isNotNull()).groupBy(F.upper(key).alias(key)).agg(F.max_by(F.struct(*rest), F.struct("file", "place")).alias("r")).select(key, "r.*")


def dump(df: DataFrame, table: str, path: str, compression: str = "gzip") -> int:
    """Writes df as INSERT statements, one a row, and gives how many were read back."""

    def literal(c: str, kind: str) -> Column:
        quoted = F.concat(F.lit("'"), F.replace(F.regexp_replace(F.col(c).cast("string"), "[\r\n\u0000]", " "), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(F.col(c).cast("string") if kind in ("int", "bigint", "double", "smallint") else quoted, F.lit("NULL"))

    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    df.select(F.concat(F.lit(head), F.concat_ws(", ", *[literal(c, k) for c, k in df.dtypes]), F.lit(");")).alias("value")).write.text(path, compression=compression)
    return df.sparkSession.read.text(path).count()
