"""Packing of token sequences into windows: length combinations by non-negative least squares, residuals by a stream."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import spm
from brindle.session import Scratch, ship

VOCABULARY = "word_bpe_49k.json"
WINDOW, END = 4096, 2
#: Lengths are rounded up to this many tokens where combinations are looked for; and pieces of a combination, at most.
UNIT, DEPTH = 32, 3
#: Words whose ids a worker keeps, and words that are looked up at once.
KEPT, STEP = 500_000, 1 << 18
#: Positions of the residual stream, and sequences, that one group of a running sum has.
SPAN = 1 << 16
#: How the vocabulary's file rewrites and splits texts. Files that say otherwise get whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# white space that splits texts under any such rule
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
# beyond these characters, letters, composition or case may differ between the library and Python
_BEYOND = re.compile("[^\x00-\u0148\u014a-\u017f\u2010-\u2027\u20ac]|\u0130")
_LETTER, _DIGIT, _SPACE = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \t\n\x0b\x0c\r\x85\u00a0"
# as SPLIT; what starts with a letter or a digit comes first, as it is most of a text
_TOKEN = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTER}{_DIGIT}]+")


class Known(dict):
    """Ids of words, found on first use; emptied when it holds KEPT of them."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts by a tokenizer file. What was split off a text once is looked up, as it has the same ids anywhere.

    Texts of Latin letters are split as the file says, and the file's model gets each part. Others are split at white space,
    which no token crosses and no normalisation joins, and what is between is left to the library; so are texts with
    special tokens in them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.known = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.special = [t["content"] for t in rules["added_tokens"]]
        model, letters = self.tokenizer.model, dict(enumerate(spm.byte_letters()))

        def part(token: str) -> bytes:
            mapped = token if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(mapped)]).tobytes()

        self.parts, self.words = Known(part), Known(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        if not self.known:
            return self._whole(text)
        if _BEYOND.search(text) or any(t in text for t in self.special):
            pattern, known = _WORD, self.words.__getitem__
        else:
            pattern, known, text = _TOKEN, self.parts.__getitem__, text.lower()
        if len(text) <= STEP:
            return b"".join(map(known, pattern.findall(text)))
        found = (m[0] for m in pattern.finditer(text))
        return b"".join(b"".join(map(known, some)) for some in batched(found, STEP))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, window: int, unit: int, end: int) -> DataFrame:
    """Ids of documents, with the end id, in chunks of a window: chunk, part, doc_id, doc_tokens, start, length, unit, place, ids.

    All chunks of a document but the last are full and have the unit 0; of the last it is its length in units, rounded up.
    place numbers the chunks of a unit within their part, so that one pass over the texts is enough.
    """
    tail = np.array([end], "<u4").tobytes()
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["chunk", "part", "doc_id", "doc_tokens", "start", "length", "unit", "place", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, n, places = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)), TaskContext.get().partitionId(), 0, {}
        for b in batches:
            held, size = [], 0

            def rows() -> pa.RecordBatch:
                columns = list(zip(*held))  # noqa: B023
                ids = b.column(0).take(pa.array(columns[2], pa.int32()))  # noqa: B023
                kinds = [pa.int64(), pa.int32(), None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([ids if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

            for at, text in enumerate(b.column(1).to_pylist()):
                ids = e.encode(text or "") + tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    units = 0 if length == window else -(-length // unit)
                    place = places.get(units, 0)
                    places[units] = place + 1
                    held.append(((part << 40) + n, part, at, total, start, length, units, place, ids[4 * start : 4 * (start + length)]))
                    n, size = n + 1, size + length
                    if size >= 1 << 20:
                        yield rows()
                        held, size = [], 0
            if held:
                yield rows()

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"chunk long, part int, doc_id {kind}, doc_tokens long, start long, length int, unit int, place long, ids binary")


def combinations(units: list[int], total: int, depth: int) -> list[tuple[int, ...]]:
    """All falling combinations of up to `depth` of the units, repeats allowed, that sum to the total."""
    have, out = sorted(set(units), reverse=True), []

    def grow(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < depth:
            for u in have:
                if u <= left and (not head or u <= head[-1]) and u * (depth - len(head)) >= left:
                    grow((*head, u), left - u)

    grow((), total)
    return out


def nonnegative_least_squares(parts: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, where column j of a counts the places in parts[j]; -1 is none.

    Variables enter by their gradient and leave where they'd fall below zero; those that are free solve the normal
    equations, whose matrix grows by a row and a column with each.
    """
    n, rows = len(parts), len(b)
    places = np.where(parts < 0, rows, parts)
    dense = np.zeros((n, rows + 1))
    np.add.at(dense, (np.arange(n)[:, None], places), 1)
    dense = dense[:, :rows]
    free, x, gram, goal = [], np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    def gradient() -> np.ndarray:
        left = b - (x @ dense[free] if free else 0)
        return np.append(left, 0.0)[places].sum(axis=1)

    bar = 1e-9 * max(1.0, float(np.abs(gradient()).max(initial=0)))
    for _ in range(rounds if n else 0):
        g = gradient()
        g[free] = -np.inf
        j = int(g.argmax())
        if g[j] <= bar:
            break
        row = np.append(dense[j], 0.0)[places[free]].sum(axis=1)
        gram = np.block([[gram, row[:, None]], [row[None, :], np.array([[dense[j] @ dense[j]]])]])
        free, goal, x = [*free, j], np.append(goal, dense[j] @ b), np.append(x, 0.0)
        while free:
            try:
                s = np.linalg.solve(gram, goal)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(gram, goal, rcond=None)[0]
            low = s <= 0
            if not low.any():
                x = s
                break
            step = (x[low] / (x[low] - s[low] + 1e-300)).min()
            x = x + step * (s - x)
            keep = x > 1e-12 * max(1.0, x.max())
            free, goal, x, gram = [f for f, k in zip(free, keep) if k], goal[keep], x[keep], gram[np.ix_(keep, keep)]
    out = np.zeros(n)
    out[free] = x
    return out


def plan(histogram: dict[int, int], total: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations that fill a window and how often each is taken, within what the histogram of units has.

    Repeat counts solve the histogram by non-negative least squares. They are rounded down, the largest first; then
    each combination is taken as often as what is left allows, those of fewer pieces first.
    """
    found = combinations(list(histogram), total, depth)
    if not found:
        return []
    units = sorted(histogram)
    at = {u: i for i, u in enumerate(units)}
    parts = np.array([[at[u] for u in c] + [-1] * (depth - len(c)) for c in found])
    wanted = np.floor(nonnegative_least_squares(parts, np.array([histogram[u] for u in units], float)) + 1e-6).astype(np.int64)
    left, taken = np.array([histogram[u] for u in units], np.int64), np.zeros(len(found), np.int64)
    order = [(j, int(wanted[j])) for j in np.argsort(-wanted, kind="stable")] + [(j, None) for j in sorted(range(len(found)), key=lambda j: (len(found[j]), found[j]))]
    for j, most in order:
        use, need = np.unique([at[u] for u in found[j]], return_counts=True)
        n = int((left[use] // need).min())
        n = n if most is None else min(n, most)
        taken[j] += n
        left[use] -= n * need
    return [(found[j], int(taken[j])) for j in range(len(found)) if taken[j]]


def _starts(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each, in the order of group and order; a group is one task's."""
    base = df.groupBy(group).agg(F.sum(value).alias("of_group")).select(group, (F.sum("of_group").over(Window.orderBy(group)) - F.col("of_group")).alias("base"))
    here = F.sum(value).over(Window.partitionBy(group).orderBy(order)) - F.col(value)
    return df.withColumn("here", here).join(base, group).withColumn(name, F.col("base") + F.col("here")).drop("base", "here")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end: int = END) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and the end id. It is cut into full windows, which are sequences of their own, and a
    remainder. Remainders are counted by length in units, rounded up; combinations of up to `depth` of them that
    fill a window are chosen by non-negative least squares on that histogram, and ranks within a length tell which
    remainders make each. What no combination takes is one stream of tokens, in the order of the input: it fills the
    rounding gaps of the combined sequences, then windows of its own, and the last tokens fill sequences of powers of
    two. So no sequence needs padding: each has `window` tokens (a power of two), or a smaller power of two of them.
    Where the stream is too short for the gaps, the last combined sequences join it.

    ids holds little-endian unsigned 32-bit integers. A null or empty text has the end id alone. Ids of documents keep
    nulls and repeats; each row is a document. Other columns are ignored, whatever their names. An empty table gives
    no rows. The window and the unit must be powers of two.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    table = scratch.save(chunks(docs, id_col, text_col, vocabulary, window, unit, end))
    # places within a unit: those of earlier parts come before; there is one row a unit and part
    counts = scratch.save(table.groupBy("part", "unit").agg(F.count("*").alias("n")))
    bases = counts.select("part", "unit", (F.sum("n").over(Window.partitionBy("unit").orderBy("part")) - F.col("n")).alias("base"))
    histogram = {r["unit"]: r["n"] for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(0, 0)
    spans, sequences = [], full
    used = dict.fromkeys(histogram, 0)
    for c, n in plan(histogram, window // unit, depth):
        for u in sorted(set(c)):
            m = c.count(u)
            spans.append((u, used[u], used[u] + m * n, m, sequences, c.index(u)))
            used[u] += m * n
        sequences += n
    # DEPTH rows a combination at most, whose number the window and the unit bound
    spans = spark.createDataFrame(spans, "unit int, low long, high long, many long, first long, slot int")
    rest = table.where("unit > 0").select("chunk", "part", "unit", "place", "length").join(bases, ["part", "unit"])
    rank = F.col("base") + F.col("place")
    inside = F.col("rank") - F.col("low")
    dealt = rest.withColumn("rank", rank).join(F.broadcast(spans), "unit").where("rank between low and high - 1")
    taken = dealt.select("chunk", "part", "length", (F.col("first") + F.floor(inside / F.col("many"))).cast("long").alias("sequence_id"), (F.col("slot") + inside % F.col("many")).alias("slot"))
    limits = F.create_map(*[F.lit(x) for u, n in used.items() for x in (u, n)]) if used else F.create_map(F.lit(0), F.lit(0))
    spare = rest.where(rank >= limits[F.col("unit")]).select("chunk", "part", "length", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("slot"))
    placed = scratch.save(taken.unionByName(spare))

    sums = placed.agg(F.sum(F.when(F.col("sequence_id").isNotNull(), F.col("length"))).alias("combined"), F.sum(F.when(F.col("sequence_id").isNull(), F.col("length"))).alias("spare")).first()
    gaps, stream = (sequences - full) * window - (sums["combined"] or 0), sums["spare"] or 0
    back = max(0, -(-(gaps - stream) // window))  # each sequence that is given up turns a gap and its tokens into a window
    last = sequences - back
    if back:
        given = placed.where(F.col("sequence_id") >= last).agg(F.sum("length").alias("n")).first()["n"]
        gaps, stream = gaps - (back * window - given), stream + given
    combined, spare = placed.where(F.col("sequence_id") < last), placed.where(F.col("sequence_id").isNull() | (F.col("sequence_id") >= last))

    in_order = Window.partitionBy("sequence_id").orderBy("slot")  # DEPTH rows
    whole = combined.select("chunk", F.lit(0).cast("long").alias("at"), F.col("length").cast("long").alias("length"), "sequence_id", (F.sum("length").over(in_order) - F.col("length")).alias("offset"))
    open_ = combined.groupBy("sequence_id").agg(F.sum("length").alias("held")).where(F.col("held") < window).select("sequence_id", "held", (window - F.col("held")).alias("size"), F.shiftright("sequence_id", 16).alias("group"))
    holes = _starts(open_, "group", "sequence_id", "size", "low").select("sequence_id", "held", "low", (F.col("low") + F.col("size")).alias("high"))
    flow = scratch.save(_starts(spare.select("chunk", "part", "length"), "part", "chunk", "length", "low").select("chunk", "low", (F.col("low") + F.col("length")).alias("high")))

    def by_span(df: DataFrame) -> DataFrame:
        """Intervals cut at multiples of SPAN."""
        cut = df.withColumn("span", F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor((F.col("high") - 1) / SPAN))))
        return cut.withColumn("pos", F.greatest("low", F.col("span") * SPAN))

    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    poured = by_span(flow.where(F.col("low") < gaps).withColumn("high", F.least("high", F.lit(gaps)))).select("span", "pos", "chunk", F.col("low").alias("begun"), *none("sequence_id", "held", "hole"))
    holes = by_span(holes).select("span", "pos", *none("chunk", "begun"), "sequence_id", F.col("held").cast("long").alias("held"), F.col("low").alias("hole"))
    along = Window.partitionBy("span").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    now = [F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("chunk", "begun", "sequence_id", "held", "hole")]
    ahead = F.lead("pos").over(along)
    cut = poured.unionByName(holes).select("pos", F.coalesce(ahead, F.least((F.col("span") + 1) * SPAN, F.lit(gaps))).alias("until"), *now).where("until > pos")
    filling = cut.select("chunk", (F.col("pos") - F.col("begun")).alias("at"), (F.col("until") - F.col("pos")).alias("length"), "sequence_id", (F.col("held") + F.col("pos") - F.col("hole")).alias("offset"))

    windows, odd = divmod(stream - gaps, window)
    sizes, parts, done = [1 << k for k in range(odd.bit_length() - 1, -1, -1) if odd >> k & 1], [], 0
    for i, size in enumerate(sizes):
        parts.append((done, done + size, i))
        done += size
    fields = lambda lo, hi, i: F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(i).cast("long").alias("i"))
    pieces = F.when(F.col("w") == windows, F.array(*[fields(*p) for p in parts])).otherwise(F.array(fields(0, window, 0))) if parts else F.array(fields(0, window, 0))
    rest = flow.where(F.col("high") > gaps).select("chunk", "low", F.greatest(F.col("low"), F.lit(gaps)).alias("a"), F.col("high").alias("b"))
    rest = rest.withColumn("w", F.explode(F.sequence(F.floor((F.col("a") - gaps) / window), F.floor((F.col("b") - 1 - gaps) / window)))).withColumn("p", F.explode(pieces))
    origin = gaps + F.col("w") * window
    left, right = F.greatest(F.col("a"), origin + F.col("p.lo")), F.least(F.col("b"), origin + F.col("p.hi"))
    behind = rest.where(left < right).select("chunk", (left - F.col("low")).alias("at"), (right - left).alias("length"), (F.lit(last) + F.col("w") + F.col("p.i")).alias("sequence_id"), (left - origin - F.col("p.lo")).alias("offset"))

    cuts = whole.unionByName(filling).unionByName(behind).select("chunk", "at", F.col("length").alias("size"), "sequence_id", "offset")
    cut = table.where("unit > 0").select("chunk", "doc_id", "doc_tokens", "start", "ids").join(cuts, "chunk")
    ids = F.substring(F.col("ids"), (4 * F.col("at") + 1).cast("int"), (4 * F.col("size")).cast("int"))
    cut = cut.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("size").alias("length"), ids.alias("ids"), "doc_tokens", "sequence_id", "offset")
    uncut = table.where("unit = 0").join(bases.where("unit = 0").drop("unit"), "part")
    uncut = uncut.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return uncut.unionByName(cut)
