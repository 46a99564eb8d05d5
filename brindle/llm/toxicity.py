"""Toxicity scores: a learned lexicon in a trie, misspelled terms by a Levenshtein automaton, and the context of each hit."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import Scratch, ship

#: A term's log-likelihood ratio against independence, its precision, and the toxic documents that it must be in.
LEAST_RATIO, LEAST_PRECISION, LEAST_DOCS = 20.0, 0.97, 3
SHORTEST, LONGEST_STEM = 3, 8
#: Words of the smallest hashes by which copies of a text are told.
SKETCH = 8
#: Terms of this length on are found within one edit.
FUZZY_FROM = 5
EDITS = 1
#: Words on each side of a hit that make its context.
WINDOW = 8
THRESHOLD = 0.7
KEPT = 300_000
WORD = re.compile(r"\w+")
#: Quotation marks: what each may close, from the mark that opened; one that closes nothing opens.
CLOSES = {'"': '"', "”": "“„", "“": "„", "«": "»", "»": "«", "‹": "›", "›": "‹"}
MARK = re.compile("[\"“”„«»‹›\n]")
FEATURES = 6
#: Bias and weights where there is nothing to learn from.
PRIOR = (-3.0, 2.5, 0.5, 0.5, 0.1, 0.5, 0.1)


def keys_of(text: str | None) -> set[str]:
    """What a document may give to the lexicon: words, and stems (with a star) of longer words."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) >= SHORTEST:
            out.add(w)
            out.update(w[:n] + "*" for n in range(SHORTEST, min(len(w), LONGEST_STEM + 1)))
    return out


def ratio(a: float, b: float, toxic: float, other: float) -> float:
    """Log-likelihood ratio of the counts a of toxic and b of other documents; 0 if rarer in toxic ones."""
    if not a or a * other <= b * toxic:
        return 0.0
    total, seen = toxic + other, a + b
    cells = ((a, seen * toxic), (b, seen * other), (toxic - a, (total - seen) * toxic), (other - b, (total - seen) * other))
    return 2 * sum(x * math.log(x * total / e) for x, e in cells if x > 0 and e > 0)


def _strong(a: Column, b: Column, toxic: int, other: int) -> Column:
    """Whether choose_terms() may take a key of these counts; what it leaves out is decided there."""
    total, seen = float(toxic + other), a + b
    cells = ((a, seen * float(toxic)), (b, seen * float(other)), (F.lit(toxic) - a, (total - seen) * float(toxic)), (F.lit(other) - b, (total - seen) * float(other)))
    r = 2 * sum((F.when((x > 0) & (e > 0), x * F.log(x * total / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    return (a > 0) & (a * float(other) > b * float(toxic)) & (a * float(other) >= (LEAST_PRECISION - 1e-6) * (a * float(other) + b * float(toxic))) & (r >= LEAST_RATIO - 1e-3)


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, other: int) -> list[str]:
    """The lexicon, from (key, toxic documents, other documents): the strongest keys, none covered by another."""
    scored = []
    for key, a, b in counts:
        r = ratio(a, b, toxic, other)
        if r >= LEAST_RATIO and a * other >= LEAST_PRECISION * (a * other + b * toxic):
            scored.append((-r, key.endswith("*"), -len(key), key, a))
    chosen: list[str] = []
    stems: set[str] = set()
    begun: dict[str, int] = {}  # the most documents of a chosen term that begins so
    for _, _, _, key, a in sorted(scored):
        stem = key.rstrip("*")
        if any(stem[:n] in stems for n in range(SHORTEST, len(stem) + 1)) or a <= 1.1 * begun.get(stem, 0):
            continue
        chosen.append(key)
        if key.endswith("*"):
            stems.add(stem)
        for n in range(1, len(stem) + 1):
            begun[stem[:n]] = max(a, begun.get(stem[:n], 0))
    return chosen


def quotations(text: str) -> list[tuple[int, int]]:
    """The places of the marks of each closed quotation of a text, inner ones first.

    Marks pair up as on a stack, within a line: “…”, „…“, „…”, "…", «…», »…«, ‹…› and ›…‹. A mark that closes
    the quotation opened last does so; any other opens one, but ” never does. What a line leaves open is none.
    """
    found, open_ = [], []
    for m in MARK.finditer(text):
        c = m[0]
        if c == "\n":
            open_.clear()
        elif open_ and open_[-1][1] in CLOSES.get(c, ""):
            found.append((open_.pop()[0], m.start()))
        elif c != "”":
            open_.append((m.start(), c))
    return found


class Lexicon:
    """A trie of terms. A star at a term's end lets a word go on after it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.first: dict[int, set[str]] = {}
        self.second: dict[tuple[int, int], set[str]] = {}
        self.whole = {t for t in terms if not t.endswith("*")}
        self.stems: dict[int, set[str]] = {}
        for t in terms:
            term, goes_on = t.rstrip("*"), t.endswith("*")
            if goes_on:
                self.stems.setdefault(len(term), set()).add(term)
            if len(term) < FUZZY_FROM:
                continue
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node["*" if goes_on else ""] = len(term)
            h = len(term) // 2
            self.first.setdefault(h, set()).add(term[:h])
            self.second.setdefault((h, len(term) - h), set()).add(term[h:])
        self.kept: dict[str, int] = {}

    def near(self, word: str) -> bool:
        """Whether some term is within EDITS of the word, or a stem of its beginning.

        The automaton of the word is run along the trie: state e has a bit for each number of the
        word's letters that can have been read with e edits. Branches without a state end.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        start = [1]
        for _ in range(EDITS):
            start.append(start[-1] | start[-1] << 1)
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    if states[-1] >> n & 1:
                        return True
                elif c == "*":
                    if states[-1]:
                        return True
                else:
                    m = masks.get(c, 0)
                    after = [(states[0] & m) << 1]
                    for e in range(1, EDITS + 1):
                        after.append((states[e] & m) << 1 | states[e - 1] | states[e - 1] << 1 | after[e - 1] << 1)
                    after = [a & (1 << n + 1) - 1 for a in after]
                    if after[-1]:
                        stack.append((child, after))
        return False

    def _maybe(self, w: str) -> bool:
        """Whether half of a term is where one edit elsewhere would leave it."""
        for h, parts in self.first.items():
            if w[:h] in parts:
                return True
        for (h, m), parts in self.second.items():
            if w[h : h + m] in parts or w[h - 1 : h - 1 + m] in parts or w[h + 1 : h + 1 + m] in parts:
                return True
        return False

    def kind(self, word: str) -> int:
        """2: a term; 1: within EDITS of one; 0: neither."""
        k = self.kept.get(word)
        if k is None:
            if word in self.whole or any(len(word) > n and word[:n] in s for n, s in self.stems.items()):
                k = 2
            else:
                k = int(len(word) >= FUZZY_FROM - EDITS and self._maybe(word) and self.near(word))
            if len(self.kept) >= KEPT:
                self.kept.clear()
            if len(word) <= 64:
                self.kept[word] = k
        return k

    def features(self, text: str | None) -> list[float]:
        """Of a document: hits outside and inside quotations (terms, near terms), hits near others, hits per 100 words.

        A hit is quoted if both marks of a quotation around it are in its context, within WINDOW words on each side.
        """
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        kind = self.kind
        if not any(map(kind, set(words))):
            return [0.0] * FEATURES
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        at = [i for i, w in enumerate(words) if kind(w)]
        around = sorted(quotations(low))
        starts = [a for a, _ in around]
        counts = [0, 0, 0, 0]
        for i in at:
            first, last = spans[max(0, i - WINDOW)][0] - 1, spans[min(len(words) - 1, i + WINDOW)][1]
            here = around[bisect_left(starts, first) : bisect_left(starts, spans[i][0])]
            counts[(kind(words[i]) == 1) * 2 + any(spans[i][1] <= b <= last for _, b in here)] += 1
        close = sum(b - a <= WINDOW for a, b in zip(at, at[1:]))
        return [*(math.log1p(c) for c in counts), math.log1p(close), math.log1p(100 * len(at) / len(words))]


def sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian at w, in one row, of rows x with labels y that count n times."""
    x = np.column_stack([np.ones(len(x)), x])
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.r_[(n * (np.logaddexp(0, z) - y * z)).sum(), x.T @ (n * (p - y)), ((x.T * (n * p * (1 - p))) @ x).ravel()]


def fit(measure: Callable[[np.ndarray], np.ndarray], penalty: float = 1.0) -> list[float]:
    """Bias and weights of a logistic regression, by Newton's method, drawn towards PRIOR; measure gives sums() at weights."""
    prior, k = np.array(PRIOR), len(PRIOR)
    w, scale = prior.copy(), np.r_[0.1, np.full(k - 1, penalty)]

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        found, off = measure(v), v - prior
        return found[0] + (scale * off**2).sum() / 2, np.linalg.solve(found[k + 1 :].reshape(k, k) + np.diag(scale), found[1 : k + 1] + scale * off)

    now, step = at(w)
    for _ in range(100):
        size = 1.0
        after, next_step = at(w - step)
        while after > now * (1 + 1e-12) and size > 1e-9:
            size /= 2
            after, next_step = at(w - size * step)
        w, now, last, step = w - size * step, after, size * step, next_step
        if np.abs(last).max() < 1e-6:
            break
    return w.tolist()


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the SKETCH words of a text with the smallest hashes, which copies mostly share."""
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            low = sorted(xxhash.xxh64_intdigest(w) for w in set(WORD.findall((text or "").lower())))[:SKETCH]
            out.append(xxhash.xxh64_intdigest(repr(low)) >> 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "sketch"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[str], list[float]]:
    """Terms and weights, from all labelled documents, of copies one.

    What comes to the driver are the keys that are strong enough for a lexicon and a few sums for each
    step of the fit. Weights are fitted on features that come from a lexicon of the other half of the documents.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    # labels grow with the documents: they are merged at every size
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = named.join(known.hint("merge"), "id").select("id", "text", "toxic", "half", F.xxhash64("text").alias("th"))
    labelled = scratch.save(rows.mapInArrow(_with_sketch, "id long, text string, toxic int, half int, th long, sketch long"))
    # copies of one text would make all its words look like terms; the same rows stay in each run
    firsts = labelled.groupBy("toxic", "sketch").agg(F.min(F.struct("id", "th")).alias("first")).select("toxic", "sketch", "first.id", "first.th")
    rows = labelled.join(firsts.hint("merge"), ["toxic", "sketch", "id", "th"], "left_semi").dropDuplicates(["toxic", "sketch", "id", "th"])
    rows = scratch.save(rows.select("id", "text", "toxic", "half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [Counter() for _ in range(4)]
            for text, toxic, half in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                seen[2 * toxic + half].update(keys_of(text))
            keys = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["key", "n0", "n1", "t0", "t1"])

    measured = None
    try:
        totals = Counter({(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()})
        by_key = rows.mapInArrow(count, "key string, n0 long, n1 long, t0 long, t1 long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")])
        toxic, other = totals[1, 0] + totals[1, 1], totals[0, 0] + totals[0, 1]
        found = by_key.where((F.col("t0") + F.col("t1") >= LEAST_DOCS) & (_strong(F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1"), toxic, other) | _strong(F.col("t0"), F.col("n0"), totals[1, 0], totals[0, 0]) | _strong(F.col("t1"), F.col("n1"), totals[1, 1], totals[0, 1]))).collect()
        terms = choose_terms([(r["key"], r["t0"] + r["t1"], r["n0"] + r["n1"]) for r in found], toxic, other)
        halves = [choose_terms([(r["key"], r[f"t{h}"], r[f"n{h}"]) for r in found], totals[1, h], totals[0, h]) for h in (0, 1)]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = [Lexicon(t) for t in halves]
            for b in batches:
                f = [made[1 - half].features(text) for text, half in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(f, pa.list_(pa.float64()))], names=["toxic", "f"])

        measured = scratch.save(rows.mapInArrow(measure, "toxic int, f array<double>").groupBy("toxic", "f").agg(F.count("*").alias("n")))
        if not toxic or not other:
            return terms, list(PRIOR)

        def at(w: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(1 + len(w) + len(w) ** 2)
                for b in batches:
                    out += sums(np.array(b.column(1).to_pylist()).reshape(-1, FEATURES), b.column(0).to_numpy(), b.column(2).to_numpy(), w)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["i", "s"])

            got = {r["i"]: r["s"] for r in measured.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
            return np.array([got[i] for i in range(len(got))])

        return terms, fit(at)
    finally:
        for t in (labelled, rows, measured):
            scratch.drop(t)


class Scorer:
    """Scores of texts by terms and weights; made once by each task."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.lexicon, self.weights = Lexicon(terms), np.array(weights)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        f = np.array([self.lexicon.features(t) for t in texts.to_pylist()]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30)))


def score(docs: DataFrame, terms: list[str], weights: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that a document is toxic, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(terms, weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scored(b.column(1)))], names=["id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Lexicon and weights are learned from labels (doc_id, toxic) of rows that aren't held out; labels
    that are null or other than 0 and 1 are ignored, and several of one id count as toxic if any
    is. A score reads the text only. Null and empty texts have the score of a text without hits.
    Without labels of both classes the lexicon is empty and all documents have one low score.
    Repeated rows and null ids stay (a null id isn't held out); an empty table gives no rows.
    """
    ship(docs.sparkSession)
    terms, weights = learn(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col)
    scored = score(docs, terms, weights, id_col, text_col)
    return scored.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that toxicity() doesn't predict as toxic. Rows are filtered where they are read."""
    ship(docs.sparkSession)
    terms, weights = learn(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(terms, weights)
        for b in batches:
            yield b.filter(pa.array(scored(b.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
