"""Best paths through word graphs against all segmentations, and keywords of unspaced queries."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import search
from brindle.operators import segment

WORDS = [("中国", 40, "ns"), ("国人", 9, "n"), ("人民", 30, "n"), ("中", 12, "f"), ("国", 8, "n"), ("人", 25, "n"), ("民", 2, "g"), ("银行", 20, "n"), ("人民银行", 5, "nt"), ("行", 11, "v"), ("ab", 4, "eng")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(WORDS, "word string, freq long, tag string")


def all_ways(run):
    n = len(run)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def best(run):
    total = sum(f for _, f, _ in WORDS)
    cost = {w: round(-math.log(f / total) * segment.COST) for w, f, _ in WORDS}
    ways = []
    for way in all_ways(run):
        if all(w in cost or len(w) == 1 for w in way):
            ways.append((sum(cost.get(w, round(math.log(total) * segment.COST)) for w in way), len(way), [-len(w) for w in reversed(way)], way))
    return min(ways)[3]


def test_against_all_segmentations(spark, lexicon):
    rng = random.Random(5)
    runs = {"".join(rng.choice("中国人民银行门a") for _ in range(rng.randrange(1, 10))) for _ in range(120)}
    out = segment.words_of(spark.createDataFrame([(r,) for r in runs], "run string"), lexicon).collect()
    assert {r["run"]: [w["word"] for w in r["words"]] for r in out} == {r: best(r) for r in runs}


def test_texts(spark, lexicon):
    rows = [(1, "中国人民银行, AB12 ab。"), (2, None), (3, " …"), (4, "中国人民银行, AB12 ab。"), (5, "x" * 400)]
    out = {r["id"]: r["words"] for r in segment.segment(spark.createDataFrame(rows, "id int, text string"), "text", lexicon).collect()}
    assert [(w["word"], w["tag"]) for w in out[1]] == [("中国", "ns"), ("人民银行", "nt"), ("AB12", None), ("ab", "eng")]
    assert out[4] == out[1] and out[2] is None and out[3] == [] and [w["word"] for w in out[5]] == ["x" * 400]
    assert segment.segment(spark.createDataFrame([], "id int, text string"), "text", lexicon).count() == 0
    empty = lexicon.limit(0)
    assert [w["word"] for w in segment.segment(spark.createDataFrame([(1, "中国")], "id int, text string"), "text", empty).first()["words"]] == ["中", "国"]


def test_keywords_of_unspaced_queries(spark, lexicon):
    assert search.plan(spark, "中国人民银行", "smart", lexicon) == [("中国人民银行", False), ("中国", True), ("人民银行", True)]
    assert ("中国", True) in search.plan(spark, "中国行", "fuzzy", lexicon)
    assert search.plan(spark, "中国 银行", "smart", lexicon) == search.plan(spark, "中国 银行", "smart")  # two words are left as they are
    assert search.plan(spark, "中国人民银行", "smart") == [("中国人民银行", True)]
