"""Collocations against exact counts of all phrases, with sketches that are too small to tell anything and ones that aren't."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import collocation

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, score string, rank int"
WORDS = ["A", "b", "Ç", "dd", "日本", "e\x1ff", "B"]


def by_hand(rows, least=10, covered=50, most=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= covered * c[q]}
        rows = []
        for p in found.keys() - gone:
            score, k = min((1000000 * found[p] ** 2 // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -found[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\t", ". ", "\n", "\r", " ", " "]) for _ in range(rng.randrange(300)))
    made = [(rng.choice([None, "und", "x"]), text()) for _ in range(40)] + [("x", None), ("x", ""), ("y", " a\nb"), (None, "b b " * 4000)]
    return made + made[:3]


@pytest.mark.parametrize("bits,most", [(8, 7), (18, 2000)])
def test_against_exact_counts(spark, monkeypatch, rows, bits, most):
    monkeypatch.setattr(collocation, "HELD", 40)
    df = spark.createDataFrame([(i, t, lang, "p", 1, "s", 2) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(map(tuple, collocation.collocations(df, most=most, bits=bits).collect())) == by_hand(rows, most=most)
    assert collocation.collocations(df.limit(0), bits=bits).count() == 0


@pytest.mark.parametrize("size", [1, 7, 60, 1 << 20])
def test_stretches_lose_nothing(rows, size):
    for _, text in rows[:8]:
        raw = (text or "").lower().encode()
        whole = Counter()
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", raw):
            w = re.findall(b"[^ \t]+", piece)
            for k in (1, 2, 3):
                whole.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        cut = Counter()
        for s in collocation.stretches(raw, size):
            for k in (1, 2, 3):
                cut.update(tuple(s.words[s.ids[i - j]] for j in range(k - 1, -1, -1)) for i in s.ends(k))
        assert cut == whole


def test_sketch_never_counts_less():
    h = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    h = np.concatenate([h, h[:500], h[:500], np.repeat(h[:3], 400)])
    sketch = collocation.Sketch(12, 10)
    for part in np.array_split(h, 7):
        sketch.add(part)
    counts = Counter(h.tolist())
    flat = sketch.rows
    for x, n in counts.items():
        one = np.array([x], np.uint64)
        assert min(int(flat[r, collocation.cells(one, r, 12)[0]]) for r in range(collocation.ROWS)) >= min(n, 255)
    whole = np.zeros(flat.size, np.int64)
    for k, data in sketch.slices():
        at, n = collocation.unpacked(data, 1 << 12, sketch.kind)
        whole[k << 12 : (k + 1) << 12][at] = n
    assert (whole == flat.reshape(-1)).all()
