"""keep_first by rows: ids that repeat on unlike texts, rows that repeat, any order, columns of names that clash."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import simhash

A, B = "alpha beta gamma delta", "one two three four five six"


def test_an_id_on_unlike_texts(spark):
    df = spark.createDataFrame([(5, A), (5, B), (2, B)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(df).collect())) == [(2, B), (5, A)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_components_by_hand(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts = [*base, *(t + " more" for t in base), *(t.upper() for t in base), "", None, " "]
    rows = [(rng.choice([None, *range(9)]), rng.choice(texts), rng.randrange(3)) for _ in range(60)]
    rows += rows[:10]
    rng.shuffle(rows)
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if rows[i][0] is not None and rows[j][0] is not None and (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    components = {}
    for r, i in zip(rows, root):
        if r[0] is not None:
            components.setdefault(i, []).append(r)
    df = spark.createDataFrame(rows, "doc_id int, text string, h1 int").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = [tuple(r)[:3] for r in simhash.keep_first(df.repartition(4)).collect()]
    again = [tuple(r)[:3] for r in simhash.keep_first(df.orderBy("h1").coalesce(2)).collect()]
    key = lambda rows: sorted(map(repr, rows))
    assert key(out) == key(again)
    assert key(r for r in out if r[0] is None) == key(r for r in rows if r[0] is None)
    mine = [r for r in out if r[0] is not None]
    assert len(mine) == len(components)
    for members in components.values():
        least = min(r[0] for r in members)
        assert sum(1 for r in mine if r in members and r[0] == least) == 1
