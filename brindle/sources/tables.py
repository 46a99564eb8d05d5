"""Tables by name in one or two folders, and rows made to fit a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Catalog:
    """Tables of a folder, some of which are in a second one."""

    def __init__(self, spark: SparkSession, base: str, other: str | None = None, moved: tuple[str, ...] = ()):
        self.spark, self.base, self.other, self.moved = spark, base, other or base, set(moved)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.other if name in self.moved else self.base}/{name}.parquet")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema, in its order and types; those it lacks are null, others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def without_nul(df: DataFrame) -> DataFrame:
    """Texts and arrays of texts without NUL characters; arrays also lose what is then empty."""
    clean = lambda c: F.translate(c, "\u0000", "")
    kinds = {"string": lambda c: clean(F.col(c)), "array<string>": lambda c: F.filter(F.transform(c, clean), lambda x: x != "")}
    return df.select(*[kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def facts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, column, type, rows, filled, least, most) of Parquet tables, from what their files say of themselves.

    Counts, and the least and the greatest of numbers, are asked of the footers, which hold them for each block of rows, so that
    no data is read. There is one row a column.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = []
    for name, path in paths.items():
        df = session.read.parquet(path)
        numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType)]
        flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        asked = {"*": F.count("*")} | {f"n {c}": F.count(c) for c in flat} | {f"{k} {c}": g(c) for c in numbers for k, g in (("min", F.min), ("max", F.max))}
        told = df.agg(*[v.alias(k) for k, v in asked.items()]).first().asDict()
        number = lambda x: None if x is None else float(x)
        rows += [(name, f.name, f.dataType.simpleString(), told["*"], told.get(f"n {f.name}"), number(told.get(f"min {f.name}")), number(told.get(f"max {f.name}"))) for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, rows long, filled long, least double, most double")


def settings(rows: DataFrame, key: str, value: str, defaults: dict[str, str], order: list[str]) -> DataFrame:
    """(key, value) of known settings: the last stored value that isn't null or blank, else the default."""
    stored = rows.where(F.btrim(value) != "").groupBy(F.col(key).alias("key")).agg(F.max_by(F.btrim(value), F.struct(*order)).alias("stored"))
    known = rows.sparkSession.createDataFrame(list(defaults.items()), "key string, fallback string")
    return known.join(stored, "key", "left").select("key", F.coalesce("stored", "fallback").alias("value"))
