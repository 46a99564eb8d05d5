"""Session helpers shared by the operators: shared scratch tables and code shipping."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL: list[str] = []
_BASES: list[str] = []
_LOCK, _WRITING = threading.Lock(), {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where only the driver's path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of this machine where that is unset and all tasks run here."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-brindle-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go after each write within. Writes of several threads may overlap: the last to end sets the session back."""
    with _LOCK:
        held = _WRITING.setdefault(id(spark), [0, spark.conf.get(_CLEANUP, None)])
        held[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _WRITING[id(spark)]
                if held[1] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, held[1])


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _BASES.append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back; the shuffle files that it took go at once."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        with _cleaned(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that save() returned and that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process, once the results that read them have been written."""
    while _BASES:
        _delete(spark, _BASES.pop())
