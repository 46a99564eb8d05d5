import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import clean, links


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if not isinstance(v, int) else 'long'}" for i, v in enumerate(values))).select(column).first()[0]


def test_html_text(spark):
    page = "<p>a  b<br>c</p>\n\n<script>x('</p>')</script><!-- z --><div>d&amp;<b>e</b></div>"
    assert one(spark, clean.html_text(F.col("c0")), page) == "a b\nc\nd&amp; e"
    assert one(spark, clean.html_text(F.col("c0")), None) is None


@pytest.mark.parametrize("q, t, least", [("word", "two words", 0.8), ("abc", "", 0.0), ("same", "same", 1.0)])
def test_word_similarity(spark, q, t, least):
    got = one(spark, clean.word_similarity(F.col("c0"), F.col("c1")), q, t)
    assert got == pytest.approx(least) and one(spark, clean.word_similarity(F.col("c0"), F.col("c1")), None, t) is None


def test_word_similarity_against_all_runs(spark):
    import random
    import re

    def grams(s):
        return [p[i : i + 3] for w in re.findall("[a-z0-9]+", s) for p in [f"  {w} "] for i in range(len(p) - 2)]

    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("ab ") for _ in range(5)), "".join(rnd.choice("ab ") for _ in range(14))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "q string, t string").select("q", "t", clean.word_similarity("q", "t").alias("s")).collect()
    for q, t, s in got:
        a, b = set(grams(q)), grams(t)
        assert s == pytest.approx(max((len(a & set(b[i:j])) / len(a | set(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1)), default=0))


@pytest.mark.parametrize("spelled, at", [("5 分钟前", "2024-03-01 11:55"), ("2 小时前", "2024-03-01 10:00"), ("昨天 08:30", "2024-02-29 08:30"), ("前天 23:59", "2024-02-28 23:59"), ("刚刚", "2024-03-01 12:00"), ("2023-7-4", "2023-07-04 00:00"), ("?", None), ("昨天 99:99", None)])
def test_dates(spark, spelled, at):
    got = one(spark, clean.listed_at(F.col("c0"), F.to_timestamp(F.lit("2024-03-01 12:00:00"))), spelled)
    assert got == (at and datetime.datetime.fromisoformat(at))


def test_email_and_entities(spark):
    hidden = "5a" + "".join(f"{ord(c) ^ 0x5A:02x}" for c in "a@b.c")
    assert one(spark, clean.decode_email(F.col("c0")), hidden) == "a@b.c"
    assert one(spark, clean.decode_email(F.col("c0")), "zz") is None
    assert one(spark, clean.unescape(F.col("c0")), "&lt;&#65;&eacute;") == "<Aé"


def test_links(spark):
    h = "0123456789abcdef0123456789ABCDEF"
    text = f"ed2k://|file|a b.mkv|700|{h}|/ x ed2k://|file|big|99999999999999999|{h}| magnet:?xt=urn:btih:{h}01234567&dn=q%20r&xl=9 magnet:?xt=urn:btih:{h.upper()}01234567"
    files = one(spark, links.ed2k_links(F.col("c0")), text)
    assert [(x["name"], x["size"], x["hash"]) for x in files] == [("a b.mkv", 700, h.upper()), ("big", 0, h.upper())]
    assert [tuple(x) for x in one(spark, links.magnet_links(F.col("c0")), text)] == [(h.upper() + "01234567", "q r", 9)]
    assert one(spark, links.ed2k_links(F.col("c0")), "") == []


@pytest.mark.parametrize("size, link, kept", [(0, 5, 5), (33 * 1024**4, 5, 5), (100 * 1024**3, 1024**3, 1024**3), (1024**3, 1, 1024**3)])
def test_trusted_size(spark, size, link, kept):
    assert one(spark, clean.trusted_size(F.col("c0"), F.col("c1")), size, link) == kept


def test_han_and_counts(spark):
    assert one(spark, clean.join_spaced_han(F.col("c0")), "影 · 片 a b") == "影片 a b"
    assert one(spark, clean.greatest_count(F.col("c0"), "V", 2, 20000), "[12V] 1,300V X-9999V 99999V") == 1300
    assert one(spark, clean.script(F.col("c0")), "漢字かな") == "kana"


@pytest.mark.parametrize("text, plain", [("a &copy; b &amp;copy; &amp", "a © b &copy; &amp"), ("&quot;x&middot;&amp;amp;", "&quot;x·&amp;"), (None, None)])
def test_unescape_named(spark, text, plain):
    assert one(spark, clean.unescape_named(F.col("c0"), ("copy", "middot", "amp")), text) == plain


@pytest.mark.parametrize("size, largest, text", [(2560**3, "GB", "15.62 GB"), (4608**3, "GB", "91.12 GB"), (10322**3, "GB", "1024.22 GB"), (10322**3, "TB", "1.00 TB"), (1029, "TB", "1.00 KB"), (1024**2 - 1, "TB", "1024.00 KB"), (8 * 10**17, "GB", "745058059.69 GB"), (1, "GB", "1 B"), (0, "GB", "0 B")])
def test_format_bytes_exactly(spark, size, largest, text):
    assert one(spark, clean.format_bytes(F.col("c0"), largest), size) == text


@pytest.mark.parametrize("size, largest, text", [(5388**2 * 37 + 1024, "MB", "1024.4 MB"), (899999**2 * 37 + 1024, "MB", "28581555.7 MB"), (1024**3, "GB", "1.0 GB"), (1280, "GB", "1.3 KB"), (-1280, "KB", "-1.3 KB"), (None, "GB", None)])
def test_short_bytes_exactly(spark, size, largest, text):
    got = spark.createDataFrame([(size,)], "c0 long").select(clean.short_bytes(F.col("c0"), largest)).first()[0]
    assert got == text


def test_fields_are_read_once(spark):
    found = clean.ordered_fields(clean.fields(F.col("c0")), {"title": "name"}, ["size", "name"])
    df = spark.createDataFrame([("【title】a\n【name】b\n【size】: 3",)], "c0 string").select(found.alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(x) for x in df.first()["f"]] == [("size", "3"), ("name", "a")]
