"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.graph import connected_components
from brindle.llm.names import unused
from brindle.llm.skew import join_per_key
from brindle.session import Scratch, ship

BITS = 64
SEED = 42
#: Widths of the ring's ten segments.
WIDTHS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
MAX_DISTANCE = 3
#: Rows of one key that one comparison takes; longer buckets are compared tile by tile.
TILE = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit integer; 0 for null and for no words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """(id, fp), and what `keys` names: fp holds the 64 bits as a signed long, keys are longs that tell rows apart."""
    keys = keys or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(c.alias(k) for k, c in keys.items()))
    return rows.mapInArrow(run, "id long, fp long" + "".join(f", {k} long" for k in keys))


def _segments() -> list[int]:
    """The mask of each segment."""
    masks, at = [], 0
    for w in WIDTHS:
        masks.append(((1 << w) - 1) << at)
        at += w
    return masks


def _masks() -> list[int]:
    """What two fingerprints of a qualifying chain agree on.

    Some chain of consecutive segments has cumulative differences within l * 3 / 10 for each
    length l: no difference in its first three segments, one at most in its first six. So the
    first three segments and two of the three that follow are equal.
    """
    seg, m = _segments(), len(WIDTHS)
    out = []
    for i in range(m):
        first = seg[i] | seg[(i + 1) % m] | seg[(i + 2) % m]
        rest = [seg[(i + k) % m] for k in (3, 4, 5)]
        out += [first | rest[0] | rest[1], first | rest[0] | rest[2], first | rest[1] | rest[2]]
    return out


def chain_holds(x: np.ndarray, budget: int = MAX_DISTANCE) -> np.ndarray:
    """Whether the differing bits x of each pair have a chain within its budgets from some segment on."""
    seg, m = _segments(), len(WIDTHS)
    counts = [np.bitwise_count(x & np.uint64(s)).astype(np.int8) for s in seg]
    found = np.zeros(len(x), bool)
    for i in range(m):
        ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int8)
        for k in range(m):
            total = total + counts[(i + k) % m]
            ok &= total <= (k + 1) * budget // m
        found |= ok
    return found


def _forest(runs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by g: within each run of g, the links between fingerprints as star edges.

    A run has the rows of one bucket, or of two tiles of a large one; rows of the same tile are
    not compared when cross is set, as another run does that.
    """
    held: list[pa.Table] = []

    def close(table: pa.Table) -> pa.RecordBatch | None:
        g = table.column("g").to_numpy()
        fp = table.column("fp").to_numpy().astype(np.int64)
        x, tile, cross = fp.view(np.uint64), table.column("tile").to_numpy(), table.column("crossed").to_numpy(zero_copy_only=False)
        n = len(g)
        label = np.arange(n)
        at, d = np.arange(n), 1
        left, right = [], []
        while True:
            at = at[at + d < n]
            at = at[g[at] == g[at + d]]
            if not len(at):
                break
            i = at[(x[at] != x[at + d]) & ~(cross[at] & (tile[at] == tile[at + d]))]
            diff = x[i] ^ x[i + d]
            ok = chain_holds(diff)
            i, diff = i[ok], diff[ok]
            i = i[np.bitwise_count(diff) <= MAX_DISTANCE]
            left.append(i)
            right.append(i + d)
            d += 1
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if np.array_equal(before, label):
                break
        hit = np.flatnonzero(label != np.arange(n))
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[hit]), pa.array(fp[label[hit]])], names=["a", "b"])

    for batch in runs:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        g = table.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1], "left"))
        if cut:
            out = close(table.slice(0, cut))
            if out is not None:
                yield out
        held = [table.slice(cut)]
    if held:
        out = close(held[0])
        if out is not None:
            yield out


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (fp), enough to connect all that link.

    Fingerprints meet by the parts that a pigeonring chain needs equal. Keys that one fingerprint
    has alone go after a count, which is combined before the shuffle. A bucket of more than TILE
    rows is compared in pairs of tiles, so no task holds more than two tiles of it. What comes out
    is a star for each group found, not every pair.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for k, m in enumerate(_masks())])
    entries = distinct.select("fp", F.explode(keys).alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # keys are thirty a fingerprint, which Spark's sizes don't tell: they are merged at every size, never broadcast
    met = entries.join(shared.hint("merge"), "key").withColumn("tiles", F.ceil(F.col("n") / F.lit(TILE)).cast("int"))
    met = met.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    dealt = pairs.select(F.xxhash64("key", low, high).alias("g"), "fp", "tile", (low != high).alias("crossed"))
    ship(distinct.sparkSession)
    return dealt.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, fp (long), component_id (the smallest id reachable by links).

    Fingerprints of 3-word shingles link at 3 or fewer differing bits. A null or empty text has
    fingerprint 0 and links like any other. Equal texts share a fingerprint and never meet as
    pairs. Repeated rows come back as often; a null id stays null and takes no part in the
    smallest id of its component. An empty table gives no rows. Only id_col and text_col are read.
    """
    return _grouped(docs, id_col, text_col, shingle).select("id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """near_duplicates(), with the keys of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, id_col, text_col, shingle, keys))
    classes = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    parts = connected_components(links(classes.select("fp")), scratch)
    member = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    group = scratch.save(member.join(lowest, "root").select("fp", "n", "component_id", "root"))
    # a fingerprint may be that of a third of all texts
    total = group.agg(F.sum("n")).first()[0] or 0
    return join_per_key(fps, ["fp"], group, total).drop("n")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row, with all its columns, of each component of near duplicates: that of the smallest id.

    Of rows of the component that share this id the one whose text has the smallest hash stays, then the one whose
    columns have; so the result is the same each time. Rows are told apart by all their columns, so that rows of one id with
    unlike texts are judged each by its own text. Rows without an id stay.
    """
    scratch, names = Scratch(docs.sparkSession, "simhash-kept"), []
    for k in ("h1", "h2", "t1"):
        names.append(unused(k, [*docs.columns, *names]))
    h1, h2, t1 = names
    whole = [F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    hashes = {h1: F.xxhash64(*whole), h2: F.xxhash64(F.lit(1), *whole), t1: F.xxhash64(F.col(text_col).cast("string"))}
    found = scratch.save(_grouped(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, {"h1": hashes[h1], "h2": hashes[h2], "t1": hashes[t1]}))
    best = found.groupBy("root").agg(F.min(F.struct("id", "t1", "h1", "h2")).alias("k"))
    kept = scratch.save(best.select(F.col("k.h1").alias(h1), F.col("k.h2").alias(h2)))
    rows = docs.where(F.col(id_col).isNotNull()).withColumn(h1, hashes[h1]).withColumn(h2, hashes[h2]).join(kept, [h1, h2], "left_semi")
    repeats = found.withColumnsRenamed({"h1": h1, "h2": h2}).join(kept, [h1, h2], "left_semi").groupBy(h1, h2).agg(F.count("*").alias("n"))
    if not repeats.where("n > 1").isEmpty():
        rows = rows.dropDuplicates([h1, h2])  # of rows that are equal in all columns
    return rows.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
