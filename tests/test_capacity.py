import pytest
from pyspark.sql import functions as F

from brindle.functions import text

K, M, G, T = 1024, 1024**2, 1024**3, 1024**4
PAIRS = [
    ("66.7GB", int(66.7 * G)),
    ("13V 66.7GB", int(66.7 * G)),
    ("635V/1.3TB", int(1.3 * T)),
    ("989V/1.5T", int(1.5 * T)),
    ("2.6G/1V/1配额", int(2.6 * G)),
    ("3V/542M", 542 * M),
    ("【名称】：x\n【资源大小】：13V 66.7GB\n【类型】：y", int(66.7 * G)),
    ("4K", 0),
    ("8K HDR", 0),
    ("蓝光4K&1080p", 0),
    ("512KB", 512 * K),
    ("【影片大小】：1.59", int(1.59 * G)),
    ("【影片大小】：159", 0),
    ("1V299m", 299 * M),
    ("【1V299m】", 299 * M),
    ("1V200m2配额", 200 * M),
    ("1V200m/2配额", 200 * M),
    ("【资源大小】：【1V299m】", 299 * M),
    ("【资源大小】：【1V200m2配额】", 200 * M),
    ("[MP4/1.59] x", int(1.59 * G)),
    ("[MP4/1.59G]", int(1.59 * G)),
    ("蓝光4K&1080p【4V/214G/4配额】", 214 * G),
    ("", 0),
    (None, 0),
]


def test_capacity(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAIRS)], "i int, t string").select("i", text.capacity_bytes(F.col("t")).alias("n"))
    assert {PAIRS[r["i"]][0]: r["n"] for r in got.collect()} == dict(PAIRS)
