"""Whitening of vectors along the leading principal components, found by block Lanczos over distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.sums import summed
from brindle.session import Scratch, ship

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Vectors that a pass multiplies at once, and columns of its basis at which the iteration goes on with the leading ones.
BLOCK, MOST_BASIS = 16, 320
#: A component's residual, and the norm of a new direction, under which each counts as nothing, as parts of the largest eigenvalue.
CONVERGED, VANISHED = 2e-14, 1e-12
#: Components of less than this part of the largest eigenvalue can't be told from rounding and aren't given.
LEAST_SHARE = 1e-12
SEED = 11
SCHEMA = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of doubles; what a long can't hold ends at 2^62 on either side."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values)
    return np.clip(x, -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column, all of one length, without a copy."""
    if not len(column):
        return np.zeros((0, dim), np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, dim)


def _orthonormal(w: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Up to as many directions as w has columns, orthonormal to basis, and how many of them are new random ones.

    Everything is orthogonalised against the whole basis, twice. Where w has fewer independent directions (a
    breakdown: the basis is invariant in them), random ones start the iteration anew beside it.
    """
    room = min(w.shape[1], len(w) - basis.shape[1])
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, size, _ = np.linalg.svd(w, full_matrices=False)
    out = u[:, :room][:, size[:room] > VANISHED * scale]
    restarts = room - out.shape[1]
    while out.shape[1] < room:
        fresh = rng.standard_normal((len(w), room - out.shape[1]))
        out = np.column_stack([out, fresh])
        for _ in range(2):
            out = out - basis @ (basis.T @ out)
            out = np.linalg.qr(out)[0]
    for _ in range(2):
        out = np.linalg.qr(out - basis @ (basis.T @ out))[0]
    return out, restarts


def leading_components(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = BLOCK, most: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray, dict]:
    """The k largest eigenvalues of a symmetric matrix, falling, with unit eigenvectors, and what the search took.

    The matrix is only known by its product with a block of vectors. Each new block is what the last product has
    outside of the basis, so that the basis spans a block Krylov space; values and vectors are those of the matrix
    within the basis. The search ends once the residuals |V y - e y| of all k are nothing, or no longer fall, being
    rounding already, or once the basis spans the space. A basis of `most` columns is cut to its leading vectors.
    A random block finds as many copies of an eigenvalue as it has columns, so it has k at least.
    """
    rng = np.random.default_rng(SEED)
    k, block = min(k, dim), min(max(block, k), dim)
    basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    said, last = {"passes": 0, "restarts": 0, "residual": float("inf")}, float("inf")
    while True:
        new = product(fresh)
        said["passes"] += 1
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, new])
        h = basis.T @ images
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        found, scale = basis @ s[:, :k], max(abs(values[0]), abs(values[-1]))
        residual = np.linalg.norm(images @ s[:, :k] - found * values[:k], axis=0).max()
        said["residual"] = residual / scale if scale else 0.0
        settled = said["residual"] <= CONVERGED or (said["residual"] <= 50 * CONVERGED and said["residual"] > last / 2)
        if scale == 0 or settled or basis.shape[1] >= dim:
            return values[:k], found / np.linalg.norm(found, axis=0), said
        last = said["residual"]
        fresh, restarts = _orthonormal(new, basis, scale, rng)
        said["restarts"] += restarts
        if basis.shape[1] + fresh.shape[1] > max(most, 3 * block + k):
            keep = s[:, : 2 * block + k]
            basis, images = basis @ keep, images @ keep
            fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]


def squares(centred: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of longs, as Python integers: from digits of 24 bits, whose sums fit."""
    if not centred.size:
        return [0] * len(centred)
    if int(np.abs(centred).max()) < isqrt((1 << 62) // centred.shape[1]):
        return np.einsum("ij,ij->i", centred, centred).tolist()
    low, mid, high = centred & 0xFFFFFF, (centred >> 24) & 0xFFFFFF, centred >> 48
    parts = [np.einsum("ij,ij->i", a, b) for a, b in ((low, low), (low, mid), (mid, mid), (low, high), (mid, high), (high, high))]
    return [a + (b << 25) + ((c + 2 * d) << 48) + (e << 73) + (f << 96) for a, b, c, d, e, f in zip(*(p.tolist() for p in parts))]


def centre(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - S/n as doubles, the exact sums of squares of n x - S)."""
    if max(map(abs, sums), default=0) < 1 << 62 and (not x.size or int(np.abs(x).max()) < (1 << 62) // n):
        scaled = x * n - np.array(sums, np.int64)
        return scaled / n, squares(scaled)
    scaled = x.astype(object) * n - np.array(sums, object)
    return (scaled / n).astype(np.float64), [int((r * r).sum()) for r in scaled]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold null or non-finite values, are left out. An entry c counts as the integer
    x = floor(1024 c) + 100000 (what exceeds a long ends at 2^62). n vectors with sums S have the covariance V of
    divisor n. deviation is the exact sum of (n x - S)^2, null where 38 digits don't hold it; whitened is x - S/n
    along the component over the square root of its eigenvalue; explained is that over the trace, which comes from the
    deviations; identity_error is how far the covariance of what was whitened is from the identity.

    Components are numbered from 1 by falling eigenvalue. There are at most as many as dimensions; those without any
    variance can't be whitened and are left out, so that a table of equal vectors, or of one, gives no rows.
    Vectors of different lengths are fitted by length, each with its own n; those without values have no
    components. Repeated rows, and rows that share an id, count each; a null id stays null. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    spark = ship(df.sparkSession)
    scratch, vec = Scratch(spark, "whitening"), F.col(vec_col).cast("array<double>")
    usable = F.col(vec_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.r_[0, np.cumsum(b.column("dim").to_numpy())] * 8
            x = integers(b.column("vec").flatten().to_numpy(zero_copy_only=False))
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("dim"), data], names=["vec_id", "dim", "x"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.where(usable).select(F.col(id_col).alias("vec_id"), F.size(vec).alias("dim"), vec.alias("vec"))
    vectors = scratch.save(rows.mapInArrow(binary, f"vec_id {kind}, dim int, x binary"))
    out = spark.createDataFrame([], SCHEMA.format(id=kind))
    for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        out = out.unionByName(_whitened(vectors.where(F.col("dim") == r["dim"]), scratch, r["dim"], r["n"], components, kind))
    return out


def _whitened(vectors: DataFrame, scratch: Scratch, dim: int, n: int, components: int, kind: str) -> DataFrame:
    """The rows of whiten() for vectors of one length."""

    def halves(column: pa.Array) -> np.ndarray:
        x = rows_of(column, dim)
        return np.stack([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)])

    high, low = summed(vectors.select("x"), halves).tolist()
    sums = [(a << 31) + b for a, b in zip(high, low)]

    def product(q: np.ndarray) -> np.ndarray:
        def work(column: pa.Array) -> np.ndarray:
            out = np.zeros(q.shape)
            x = rows_of(column, dim)
            for i in range(0, len(x), 4096):
                c = centre(x[i : i + 4096], n, sums)[0]
                out += c.T @ (c @ q)
            return out

        return summed(vectors.select("x"), work) / n

    values, axes, _ = leading_components(product, dim, components)
    k = int((values > LEAST_SHARE * max(values[0], 0)).sum()) if len(values) else 0
    values, axes = values[:k], axes[:, :k]
    names = [f"w{i}" for i in range(k)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, exact = centre(rows_of(b.column("x"), dim), n, sums)
            w = c @ axes / np.sqrt(values)
            wide = [Decimal(e) if e < 10**38 else None for e in exact]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(wide, pa.decimal128(38, 0)), pa.array([e / (n * n) for e in exact], pa.float64()), *(pa.array(w[:, i]) for i in range(k))], names=["vec_id", "deviation", "spread", *names])

    if not k:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(id=kind))
    wide = scratch.save(vectors.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), spread double, " + ", ".join(f"{c} double" for c in names)))
    first = wide.agg(F.sum("spread").alias("spread"), *(F.avg(c).alias(c) for c in names)).first()
    trace = first["spread"] / n
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = wide.agg(*(F.avg((F.col(a) - F.lit(first[a])) * (F.col(b) - F.lit(first[b]))) for a, b in pairs)).first()
    error = max(abs(m - (a == b)) for m, (a, b) in zip(moments, pairs))
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(values[i] / trace)).alias("explained")) for i, c in enumerate(names)))).alias("c")
    return wide.select("vec_id", "deviation", each).select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
