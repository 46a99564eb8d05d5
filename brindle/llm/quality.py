"""Quality rules: statistics of each text, two fixed rules, and boosted trees over the statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import gbt
from brindle.session import Scratch, ship

#: Labelled documents that the trees are fitted on, about and at most twice as many; chosen by a hash of the id.
TRAINING_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a text that are split at once.
STRETCH = 1 << 20
NEXT_SPACE, LINE = re.compile(rb"[ \t\n\x0b\x0c\r]"), re.compile("[^\n]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_digits", "longest")
#: Features of the trees and the sign of each: more symbols or repeats never make a text better.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "digits": 0, "longest": 0}
KEEP = 0.5


def _words(raw: bytes) -> Iterator[bytes]:
    """The words of UTF-8 bytes; those of a long text are cut out a stretch at a time."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + STRETCH)
        if end < n:
            space = NEXT_SPACE.search(raw, end)
            end = space.start() if space else n
        yield from raw[at:end].split()
        at = end


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """How many places lie in runs of three that occur at least twice; ids are numbers of words below kinds."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)
    _, which, seen = np.unique(pair[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(seen[which] > 1)
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text. Words are runs of what isn't one of SPACES.

    Of a long text the distinct words and lines are held, and a few numbers for each word.
    """
    text = text or ""
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in _words(text.encode())), np.int64)
    n, lines, distinct = len(ids), 0, set()
    for m in LINE.finditer(text):
        if m[0].strip(SPACES):
            lines += 1
            distinct.add(m[0])
    digits = sum(map(text.count, "0123456789"))
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines - len(distinct), _repeated(ids, len(place)), len(place), lines, digits, max(map(len, place), default=0)


def features(counts: np.ndarray) -> np.ndarray:
    """The columns of FEATURES from those of COUNTS."""
    n, chars, symbols, dup, repeats, distinct, lines, digits, longest = counts.astype(float).T
    words, size = np.maximum(n, 1), np.maximum(chars, 1)
    return np.column_stack([np.log1p(n), chars / words, symbols / size, dup / np.maximum(lines, 1), repeats / words, distinct / words, digits / size, np.log1p(longest)])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], names=["id", *COUNTS])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def train(stats: DataFrame, labels: DataFrame) -> gbt.Trees:
    """Trees for labels.quality, fitted on a sample of labelled documents: all of them up to TRAINING_ROWS, else about as many.

    Documents are taken by a hash of the id, whose rate follows from their number, so that no task sends more
    than its share. Several labels of an id count as 0 if any is.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    n = known.count()
    rate = min(1.0, TRAINING_ROWS / max(1, n))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    rows = sample.join(stats, "id").select("id", "quality", *COUNTS).distinct().toArrow()
    order = np.lexsort([rows.column(c).to_numpy() for c in reversed(rows.column_names)])
    counts = np.column_stack([rows.column(c).to_numpy()[order] for c in COUNTS]) if len(order) else np.zeros((0, len(COUNTS)))
    return gbt.fit(features(counts), rows.column("quality").to_numpy()[order].astype(float), tuple(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    base_failed: fewer than 50 words, or more than half of them in 3-word windows that the text has
    twice. Others are kept if the trees give them at least KEEP. Null texts have no words. Without
    labels of both classes the rules alone decide. Repeated rows and null ids stay; an empty table
    gives no rows. Other columns are ignored. Texts are read once: their statistics are written, then
    used to train and score.
    """
    spark = docs.sparkSession
    stats = Scratch(spark, "quality").save(document_statistics(docs, id_col, text_col))
    trees = train(stats, labels)
    learned = bool(len(trees.roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.column_stack([b.column(c).to_numpy() for c in COUNTS])
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = trees.probability(features(counts)) if learned else np.ones(len(counts))
            columns = [b.column("id"), *(b.column(c) for c in COUNTS[:5]), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *COUNTS[:5], "base_failed", "score", "kept"])

    return stats.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, score double, kept boolean")
