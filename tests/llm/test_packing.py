"""Packing: every id in exactly one piece, gapless sequences without padding, the tokenizer's own ids, the solver by hand."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing

ODD = ["", None, " \n", "x", "ΑΣ ΟΔΟΣ á ́b İx e f \x1cg\x85h ﬁ <|endoftext|> a<|startoftext|>b's 12½ 日本語テキスト 😀 don't", "word " * 9000, "q" * 3000, "Ａ b c​d"]
SCHEMA = "doc_id long, text string, ids string, start int, length string, part int, unit int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return [(i, o) for i, o in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(["ab", "c1", "zzz", "Été"]) for _ in range(rng.randrange(60)))) for i in range(120)] + [(7, "same"), (7, "same"), (None, "n")]


def check(rows, texts, window):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted, found, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t in texts:
        wanted[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        found[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, whole in wanted.items():
        assert sorted(found[i], key=lambda r: r.start)[0].start == 0
        if len(whole) > 1:
            assert sum(map(len, whole)) == sum(len(r.ids) for r in found[i])
            continue
        at = 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole[0]) // 4
            at += r.length
        assert b"".join(r.ids for r in sorted(found[i], key=lambda r: r.start)) == whole[0]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("window,unit", [(4096, 32), (64, 4), (16, 2), (16, 16)])
def test_all_ids_once(spark, texts, window, unit):
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in texts], SCHEMA).repartition(5, "doc_id").cache()
    check(packing.pack(df, window=window, unit=unit).collect(), texts, window)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "ab " * 5)], "doc_id long, text string")
    assert packing.pack(df.limit(0)).count() == 0
    check(packing.pack(df).collect(), [(1, None), (2, "ab " * 5)], 4096)


def test_sequences_are_given_up_for_gaps(spark):
    """All texts fit combinations of two, with gaps that no other text could fill."""
    texts = [(i, "ab " * 6) for i in range(20)]
    sizes = {r.length for r in packing.pack(spark.createDataFrame(texts[:1], "doc_id long, text string"), window=16, unit=8).collect()}
    assert sizes == {4, 2, 1}
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), window=16, unit=8).collect()
    check(rows, texts, 16)


def test_combinations():
    assert packing.combinations([1, 2, 3, 4], 4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]
    assert packing.combinations([3], 4, 3) == []
    assert packing.plan({}, 4) == []


def test_plan_stays_within_the_histogram():
    rng = random.Random(4)
    for _ in range(20):
        histogram = {u: rng.randrange(1, 90) for u in rng.sample(range(1, 33), rng.randrange(1, 33))}
        used = defaultdict(int)
        for c, n in packing.plan(histogram, 32):
            assert sum(c) == 32 and len(c) <= packing.DEPTH and n > 0
            for u in c:
                used[u] += n
        assert all(used[u] <= histogram[u] for u in used)


def test_least_squares():
    """The same residual as long projected gradients."""
    rng = np.random.default_rng(0)
    found = packing.combinations(list(range(1, 9)), 8, 3)
    parts = np.array([[u - 1 for u in c] + [-1] * (3 - len(c)) for c in found])
    a = np.zeros((8, len(found)))
    for j, c in enumerate(found):
        for u in c:
            a[u - 1, j] += 1
    for _ in range(5):
        b = rng.integers(0, 50, 8).astype(float)
        x, y = packing.nonnegative_least_squares(parts, b), np.zeros(len(found))
        for _ in range(20000):
            y = np.maximum(0, y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2)
        assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - np.linalg.norm(a @ y - b)) < 1e-6
