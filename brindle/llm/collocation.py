"""Phrases that occur together more often than their parts do: count-min sketches, exact counts of survivors, scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.skew import join_per_key
from brindle.operators.ranking import top_per_key
from brindle.session import Scratch, ship

#: Words of a phrase, at most.
LONGEST = 3
#: Rows of a sketch and the power of two of cells in each; and of cells in a slice, which travels and is merged by itself.
ROWS, CELL_BITS, SLICE_BITS = 2, 26, 16
#: Sketches that are made for each core, at most, as each is sent whole.
SKETCHES_PER_CORE = 4
#: Bytes of text that are counted at once, and phrases that a task holds before it sends their counts on.
STRETCH, HELD = 1 << 22, 1 << 22
NO_LANGUAGE = "und"
_BREAK, _GAP = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAP)], _KIND[list(_BREAK)] = 1, 2
_SEPARATOR = re.compile(b"[" + re.escape(_BREAK + _GAP) + b"]")
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Stretch:
    """The words of a stretch of text: ids into a dictionary of it, and pieces that no phrase crosses."""

    def __init__(self, raw: bytes, carried: int = 0):
        x = _KIND[np.frombuffer(raw, np.uint8)]
        edge = np.diff(np.r_[0, (x == 0).view(np.int8), 0])
        self.starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.carried, n = carried, len(self.starts)
        if not n:
            self.ids, self.words, self.piece = np.zeros(0, np.int64), [], np.zeros(0, np.int32)
            return
        spans = np.empty(2 * n, np.int32)
        spans[::2], spans[1::2] = self.starts, ends
        named = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        self.ids = named.indices.to_numpy()[::2].astype(np.int64)
        self.words = named.dictionary.to_pylist()
        self.piece = np.cumsum(x == 2, dtype=np.int32)[self.starts]

    def ends(self, size: int) -> np.ndarray:
        """The places of the last words of phrases of a size that are within a piece and weren't counted before."""
        last = np.arange(max(size - 1, self.carried), len(self.ids))
        return last[self.piece[last] == self.piece[last - size + 1]]


def stretches(raw: bytes, size: int | None = None) -> Iterator[Stretch]:
    """A text in stretches of about `size` bytes that end at separators; words that phrases need from before are carried."""
    at, carried, step = 0, 0, size or STRETCH
    begin = 0
    while at < len(raw):
        cut = _SEPARATOR.search(raw, at + step) if at + step < len(raw) else None
        end = cut.start() if cut else len(raw)
        s = Stretch(raw[begin:end], carried)
        yield s
        carried = min(LONGEST - 1, len(s.starts))
        begin = begin + int(s.starts[-carried]) if carried else end
        at = end


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language of a batch, joined by line ends, with A-Z in lower case."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    together: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        together.setdefault(NO_LANGUAGE if lang is None else lang, []).append((text or "").encode())
    for lang, found in together.items():
        yield lang, b"\n".join(found).lower()


def hashes(lang: str, s: Stretch) -> list[np.ndarray]:
    """For each size, the hash of the phrase of that size which ends at each word (whatever the pieces)."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in s.words), np.uint64, len(s.words))[s.ids]
    out, total = [], np.zeros(len(word), np.uint64)
    for k in range(LONGEST):
        total = total.copy()
        total[k:] = total[k:] * np.uint64(_ODD[0]) + word[: len(word) - k]
        h = (total ^ (total >> np.uint64(29))) * np.uint64(_ODD[1])
        out.append((h ^ (h >> np.uint64(32))) * np.uint64(_ODD[2]))
    return out


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((h ^ (h >> np.uint64(31))) * np.uint64(_ODD[row % 3] + 2 * row) >> np.uint64(64 - bits)).astype(np.uint32)


class Sketch:
    """A count-min sketch whose cells stop at the top of their type, which is above what is asked for."""

    def __init__(self, bits: int, least: int):
        self.bits, self.kind = bits, cell_type(least)
        self.rows = np.zeros((ROWS, 1 << bits), self.kind)

    def add(self, h: np.ndarray) -> None:
        if not len(h):
            return
        top = np.iinfo(self.kind).max
        for row in range(ROWS):
            c = np.sort(cells(h, row, self.bits))
            edges = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            at, n = c[edges], np.diff(np.r_[edges, len(c)])
            self.rows[row, at] = np.minimum(self.rows[row, at].astype(np.int64) + n, top).astype(self.kind)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """The number and packed counts of each slice that isn't empty."""
        size, flat = 1 << min(SLICE_BITS, self.bits), self.rows.reshape(-1)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(len(flat) // size):
            part = flat[k * size : (k + 1) * size]
            at = np.flatnonzero(part)
            if 32 * len(at) < size:
                if len(at):
                    yield k, b"s" + at.astype("<u4").tobytes() + part[at].tobytes()
            else:
                yield k, b"d" + pack(part.tobytes())


def cell_type(least: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32) if least < np.iinfo(t).max)


def unpacked(data: bytes, size: int, kind: type) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places and counts of a packed slice."""
    if data[:1] == b"d":
        return slice(None), np.frombuffer(zstandard.decompress(data[1:], max_output_size=size * np.dtype(kind).itemsize), kind)
    n = (len(data) - 1) // (4 + np.dtype(kind).itemsize)
    return np.frombuffer(data, "<u4", n, 1), np.frombuffer(data, kind, n, 1 + 4 * n)


def frequent_cells(texts: DataFrame, least: int, bits: int = CELL_BITS) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it counts at least `least`.

    Each task sketches its texts; slices of sketches are added by tasks. The driver gets ROWS * 2^bits bits, whatever
    the input. Phrases of up to LONGEST words share the sketch.
    """
    size, kind = 1 << min(SLICE_BITS, bits), cell_type(least)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits, least)
        for b in batches:
            for lang, raw in by_language(b):
                for s in stretches(raw):
                    for k, h in enumerate(hashes(lang, s)):
                        own.add(h[s.ends(k + 1)])
        for some in batched(own.slices(), 64):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([data for _, data in some], pa.binary())], names=["slice", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(size, np.int64)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["slice", "data"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != held:
                    if held is not None:
                        yield close()
                    held = k
                    total[:] = 0
                at, n = unpacked(data, size, kind)
                total[at] += n
        if held is not None:
            yield close()

    merged = texts.mapInArrow(sketch, "slice int, data binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, data binary")
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    for r in merged.collect():
        at = r["slice"] * size // 8
        out[at : at + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
    return out


def _frequent(h: np.ndarray, flags: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch's estimate of each hash reaches the bar: the least of its cells does."""
    ok = np.ones(len(h), bool)
    for row in range(ROWS):
        c = cells(h, row, bits) + np.int64(row << bits)
        ok &= (flags[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _batch(key: tuple[str, int], phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.string()), n), phrases, pa.repeat(pa.scalar(key[1], pa.int32()), n), counts], names=["lang", "phrase", "words", "f"])


class Held:
    """Counts of phrases by (language, words) that a task has yet to send."""

    def __init__(self):
        self.parts: dict[tuple[str, int], list[pa.Table]] = {}
        self.rows = 0

    def add(self, key: tuple[str, int], phrases: pa.Array, counts: pa.Array) -> None:
        if len(phrases):
            self.parts.setdefault(key, []).append(pa.table({"phrase": phrases, "n": counts}))
            self.rows += len(phrases)

    def _merge(self) -> None:
        for key, parts in self.parts.items():
            if len(parts) > 1:
                merged = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
                self.parts[key] = [merged.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])]
        self.rows = sum(t.num_rows for parts in self.parts.values() for t in parts)

    def full(self) -> Iterator[pa.RecordBatch]:
        """Adds equal phrases, and sends all on where that leaves more than half of what may be held."""
        self._merge()
        if self.rows > HELD // 2:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for key, (table,) in self.parts.items():
            for b in table.to_batches(max_chunksize=1 << 16):
                yield _batch(key, b.column(0), b.column(1))
        self.parts, self.rows = {}, 0


def exact_counts(texts: DataFrame, flags: np.ndarray, bits: int = CELL_BITS) -> DataFrame:
    """(lang, phrase, words, f): counts of all phrases that the sketch can't rule out, and of all words (phrase null, words 0).

    A phrase goes if any phrase within it is ruled out, as that occurs as often at least. Tasks count before they
    send; a task holds HELD phrases at most, equal ones of different stretches apart until it is full.
    """
    shared = texts.sparkSession.sparkContext.broadcast(flags)  # of a fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, held, total = shared.value, Held(), {}
        for b in batches:
            for lang, raw in by_language(b):
                for s in stretches(raw):
                    total[lang] = total.get(lang, 0) + len(s.ids) - s.carried
                    alive, v = np.ones(len(s.ids), bool), len(s.words)
                    names = pa.array(s.words, pa.string())
                    for size, h in enumerate(hashes(lang, s), 1):
                        if size > 1:
                            alive[1:] &= alive[:-1]
                            alive[:1] = False
                        at = np.flatnonzero(alive)
                        alive[at] = _frequent(h[at], flags, bits)
                        last = s.ends(size)
                        last = last[alive[last]]
                        places = np.stack([s.ids[last - j] for j in range(size - 1, -1, -1)])
                        if v**size < 1 << 62:
                            key = places[0]
                            for p in places[1:]:
                                key = key * v + p
                            _, first, n = np.unique(key, return_index=True, return_counts=True)
                        else:
                            _, first, n = np.unique(places, axis=1, return_index=True, return_counts=True)
                        words = [names.take(pa.array(p[first])) for p in places]
                        held.add((lang, size), words[0] if size == 1 else pc.binary_join_element_wise(*words, " "), pa.array(n))
                        if held.rows > HELD:
                            yield from held.full()
        yield from held.rest()
        for lang, n in total.items():
            yield _batch((lang, 0), pa.array([None], pa.string()), pa.array([n], pa.int64()))

    found = texts.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, covered: int = 50, most: int = 2000, bits: int = CELL_BITS) -> DataFrame:
    """The best phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    Texts, with A-Z in lower case, are cut at punctuation and line ends into pieces and those at spaces and tabs into
    words. A phrase that occurs a >= least times is cut where floor(1000000 a a / (l r)) is least, l and r being the
    counts of both parts (the first such cut counts). It goes if a phrase of one word more that holds it occurs in `covered`
    of a hundred of its places or more. n is the number of all words of the language. Ranks go by score, then a, both falling, then the
    phrase's bytes; each language has `most` of them at most.

    A null language counts as `und`, with rows that say so; a null or empty text has no words. Repeated rows count
    each. Other columns are ignored, whatever their names. An empty table gives no rows.

    Counts are exact: sketches only rule out phrases that can't reach `least`. Their size is fixed; where an input is so large
    that all cells fill up, more phrases are counted and the result is the same.
    """
    spark = ship(df.sparkSession)
    scratch = Scratch(spark, "collocation")
    texts = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    flags = frequent_cells(texts.coalesce(SKETCHES_PER_CORE * spark.sparkContext.defaultParallelism), least, bits)
    # every phrase of a candidate occurs as often at least, so what is rarer is of no use here
    counts = scratch.save(exact_counts(texts, flags, bits).where((F.col("f") >= least) | (F.col("words") == 0)))
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(parts, start, size), " ")

    longer = phrases.where("words > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("around"))
    around = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = phrases.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True)))
    cuts = scratch.save(
        left.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    )
    # a word may begin or end a large part of all phrases: such parts are joined apart from the others
    total, scored = cuts.count(), cuts
    for part, name in (("head", "l"), ("tail", "r")):
        uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
        table = scratch.save(uses.join(counts.where("words > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]))
        scored = join_per_key(scored, ["lang", part], table, total, "uses").drop("uses")
    score = "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    scored = scored.withColumn("score", F.expr(f"cast({score} as long)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then the first of all parts
    dealt = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    first = top_per_key(dealt, ["lang", "part"], order, most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
