"""Near-duplicate vectors by tiled comparison in the order of principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.graph import connected_components
from brindle.llm.skew import join_per_key
from brindle.llm.sums import summed
from brindle.session import Scratch, ship

#: Vectors that are compared at once, and values and vectors of a block, at most; a task holds two blocks.
TILE, BLOCK_VALUES, BLOCK_ROWS = 1024, 1 << 21, 1 << 14
#: Blocks that one part of the input has, at most, as a power of two.
BLOCK_BITS = 22
#: Leading components that order the vectors and bound the tiles, and those added in each step of a comparison.
BOX, STEP = 6, 16
#: Dimensions, the most frequent first, and the largest of them that get principal axes; others are compared along
#: their own axes, which gives the same links.
AXES, AXES_DIM = 8, 2048
SLACK = 1e-9


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small values stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent dimensions of vectors (dim, vec), the axes of their second moments, widest first.

    Each task sends one dim x dim matrix, summed over its rows; a few tasks add these, and the driver gets theirs, of AXES
    dimensions up to AXES_DIM. Axes through the origin keep inner products as they are.
    """
    sizes = vectors.where(F.col("dim") <= AXES_DIM).groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(AXES).collect()
    out = {}
    for d in (r["dim"] for r in sizes if r["n"] > 1):

        def moments(column: pa.Array, d: int = d) -> np.ndarray:
            x = _unit(_vectors(column, d))
            return x.T @ x

        out[d] = np.ascontiguousarray(np.linalg.eigh(summed(vectors.where(F.col("dim") == d).select("vec"), moments))[1][:, ::-1])
    return out


def _along(x: np.ndarray, axes: dict[int, np.ndarray], n: int | None = None) -> np.ndarray:
    """The first n components of unit vectors along their axes."""
    a = axes.get(x.shape[1])
    return x[:, :n] if a is None else x @ a[:, :n]


def blocks(classes: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Vectors in blocks of one label and dimension, sorted by cells of their leading components.

    classes: label, dim, h1, h2, m, vec. A range partitioning whose last keys are the hashes deals out labels of any
    size. Each row has a block's hashes, weights m, vectors and the box around its leading components.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cells = np.zeros((b.num_rows, 3), np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _along(_unit(_vectors(b.take(pa.array(at)).column("vec"), d)), axes, 3)
                cells[at, : x.shape[1]] = np.floor(x / (reach / 2 + SLACK))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cells.T)], names=[*b.schema.names, "c1", "c2", "c3"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        kind = None
        for b in batches:
            dims, labels = b.column("dim").to_numpy(), b.column("label").dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((np.diff(labels) != 0) | (np.diff(dims) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                if i == j:
                    continue
                part = pa.Table.from_batches([b.slice(i, j - i)])
                if held is not None and kind == (part.column("label")[0], dims[i]):
                    part = pa.concat_tables([held, part])
                elif held is not None:
                    yield pack(held)
                kind = (part.column("label")[0], dims[i])
                most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // int(dims[i])))
                while part.num_rows > most:
                    yield pack(part.slice(0, most))
                    part = part.slice(most)
                held = part
        if held is not None:
            yield pack(held)

    def pack(t: pa.Table) -> pa.RecordBatch:
        d = t.column("dim")[0].as_py()
        raw = _vectors(t.column("vec").combine_chunks(), d)
        z = _along(_unit(raw), axes, BOX)
        z = np.pad(z, ((0, 0), (0, BOX - z.shape[1])))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [t.column("label").slice(0, 1).combine_chunks(), pa.array([d], pa.int32()), *(pa.array([t.column(c).to_numpy()], longs) for c in ("h1", "h2", "m")), pa.array([np.ascontiguousarray(raw).tobytes()], pa.binary()), pa.array([raw.dtype.str]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (z.min(axis=0), z.max(axis=0)))],
            names=["label", "dim", "h1", "h2", "m", "data", "kind", "low", "high"],
        )

    placed = classes.mapInArrow(place, T.StructType([*classes.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("c1", "c2", "c3"))]))
    order = ["label", "dim", "c1", "c2", "c3", "h1", "h2"]
    dealt = placed.repartitionByRange(max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, f"label {classes.schema['label'].dataType.simpleString()}, dim int, h1 array<long>, h2 array<long>, m array<long>, data binary, kind string, low array<double>, high array<double>")


class Side:
    """A block's unit vectors, their components along the axes, and the norms of what is left from each component on."""

    def __init__(self, raw: np.ndarray, axes: dict[int, np.ndarray], tile: int):
        self.tile, self.u = tile, _unit(raw)
        self.z = _along(self.u, axes)
        self.rest = np.sqrt(np.maximum(0, np.cumsum((self.z**2)[:, ::-1], axis=1)[:, ::-1]))
        self.rest = np.column_stack([self.rest, np.zeros(len(raw))])

    def box(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        z = self.z[i : i + self.tile, :BOX]
        return z.min(axis=0), z.max(axis=0)


def compare(a: Side, b: Side, i0: int, j0: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of the tiles at i0 of a and j0 of b whose cosine is at least the threshold; i < j if a is b.

    Products of leading components are summed first. What is left of a product is at most the product
    of both suffix norms, so pairs that can't reach the threshold any more go after each step.
    """
    za, zb, ra, rb = a.z[i0 : i0 + a.tile], b.z[j0 : j0 + b.tile], a.rest[i0 : i0 + a.tile], b.rest[j0 : j0 + b.tile]
    d = za.shape[1]
    k = min(STEP, d)
    i, j = np.nonzero(za[:, :k] @ zb[:, :k].T + ra[:, k, None] * rb[None, :, k] >= threshold - SLACK)
    if a is b:
        keep = i + i0 < j + j0
        i, j = i[keep], j[keep]
    steps = [(s, min(s + STEP, d)) for s in range(k, d, STEP)]
    hits = []
    for s in range(0, len(i), 65536):  # bounded whatever the number of pairs
        p, q = i[s : s + 65536], j[s : s + 65536]
        partial = np.einsum("ij,ij->i", za[p, :k], zb[q, :k])
        for low, high in steps:
            partial = partial + np.einsum("ij,ij->i", za[p, low:high], zb[q, low:high])
            keep = partial + ra[p, high] * rb[q, high] >= threshold - SLACK
            p, q, partial = p[keep], q[keep], partial[keep]
        p, q = p + i0, q + j0
        hit = np.einsum("ij,ij->i", a.u[p], b.u[q]) >= threshold
        hits.append((p[hit], q[hit]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(p for p, _ in hits)]), np.concatenate([none, *(q for _, q in hits)])


def _lowest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place linked with each, from what was known and links (i, j)."""
    i, j = np.concatenate([i, np.arange(len(root))]), np.concatenate([j, root])
    while True:
        low, before = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal dimension link at a cosine of at least the threshold.
    Labels may be of any type that can be grouped and sorted. Null, empty and zero vectors and those with null or non-finite values have no links. Equal vectors of a
    label are one class with a weight. Blocks whose boxes are near enough meet in one task, which compares their
    near tiles and returns a sum of weights for each linked class and a star for each group it found, never
    the pairs. Repeated rows, and rows that share an id, each count as a vector of their own. A null id stays
    null; its component has the smallest of the other ids, if any. kept: vec_id = component_id (false for null).
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = ship(df.sparkSession)
    scratch = Scratch(spark, "vectors")
    vec = F.col(vec_col)
    usable = F.col(label_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(F.size(vec), F.lit(0)).alias("dim"), vec.alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    keys = ["label", "dim", "h1", "h2"]
    # two hashes stand for a vector where rows find their class again
    vectors = rows.where("usable").select("id", "label", "dim", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec")
    classes = scratch.save(vectors.groupBy(*keys, "vec").agg(F.count("*").alias("m"), F.min("id").alias("first")))
    axes = principal_axes(classes.select("dim", "vec"))
    # the number of a part and, in BLOCK_BITS, that of the block within it: with a row's place they fit a long
    at = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(at, 33), BLOCK_BITS) + at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    made = scratch.save(blocks(classes.select(*keys, "m", "vec"), axes, threshold).select(block.alias("block"), "*"))
    # near blocks: those whose boxes are within the greatest distance of linked unit vectors; they meet by cells of two components
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    boxes = made.select("block", "label", "dim", "low", "high")

    def cells(df: DataFrame, wider: int) -> DataFrame:
        for k, name in enumerate(("x", "y")):
            df = df.withColumn(name, F.explode(F.sequence(F.floor(F.get("low", F.lit(k)) / reach) - wider, F.floor(F.get("high", F.lit(k)) / reach) + wider)))
        return df

    sides = F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    gap = F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", "x", "y")]
    near = cells(boxes, 0).alias("a").join(cells(boxes, 1).alias("b"), [*same, F.col("a.block") <= F.col("b.block"), gap <= reach * reach])
    pairs = near.select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()
    load = made.select("block", "dim", "kind", "data", "m")
    left = load.select(F.col("block").alias("a"), "dim", F.col("kind").alias("ka"), F.col("data").alias("da"), F.col("m").alias("ma"))
    right = load.select(F.col("block").alias("b"), F.col("kind").alias("kb"), F.col("data").alias("db"), F.col("m").alias("mb"))
    work = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ka, kb, d = (batch.column(c)[r].as_py() for c in ("a", "b", "dim"))
                side = lambda x: Side(np.frombuffer(batch.column(f"d{x}")[r].as_py(), batch.column(f"k{x}")[r].as_py()).reshape(-1, d), axes, tile)  # noqa: B023, E731
                a = side("a")
                b = a if ka == kb else side("b")
                na, shift = len(a.u), 0 if a is b else len(a.u)
                m = np.concatenate([batch.column(c)[r].values.to_numpy() for c in (("ma",) if a is b else ("ma", "mb"))])
                links, root = np.zeros(len(m), np.int64), np.arange(len(m))
                for i0 in range(0, na, tile):
                    low_a, high_a = a.box(i0)
                    for j0 in range(i0 if a is b else 0, len(b.u), tile):
                        low_b, high_b = b.box(j0)
                        if (np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum() > reach * reach:
                            continue
                        i, j = compare(a, b, i0, j0, threshold)
                        j = j + shift
                        np.add.at(links, i, m[j])
                        np.add.at(links, j, m[i])
                        root = _lowest(root, i, j)
                hit = np.flatnonzero(links)
                key = lambda x: np.where(x < na, ka * BLOCK_ROWS + x, kb * BLOCK_ROWS + x - shift)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(key(hit)), pa.array(links[hit]), pa.array(key(root[hit]))], names=["node", "n", "root"])

    found = scratch.save(work.mapInArrow(run, "node long, n long, root long"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    nodes = made.select("label", "dim", "block", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select("label", "dim", "h.h1", "h.h2", (F.col("block") * BLOCK_ROWS + F.col("at")).alias("node"))
    named = nodes.join(classes.select(*keys, "m", "first"), keys).join(counts, "node", "left").join(parts, "node", "left")
    named = scratch.save(named.select(*keys, "m", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # a class: links of each of its vectors, those with its own copies included
    result = scratch.save(named.join(lowest, "root").select(*keys, F.col("m").alias("n"), (F.col("others") + F.col("m") - 1).alias("n_links"), "component_id"))
    total = result.agg(F.sum("n")).first()[0] or 0
    for t in (classes, made, found, named):
        scratch.drop(t)
    linked = join_per_key(vectors.drop("vec"), keys, result, total).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
