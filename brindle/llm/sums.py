"""Sums of arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that add the sums of all others, before the driver adds theirs.
ADDERS = 16


def summed(column: DataFrame, work: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of what work gives for each batch of a column: one array a task, added by ADDERS tasks and then here.

    Only arrays of the size that work gives leave a task, whatever its rows. The table must not be empty.
    """

    def packed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["data", "kind", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(work(b.column(0)) for b in batches if b.num_rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(np.frombuffer(data, kind).reshape(shape) for b in batches for data, kind, shape in zip(*(c.to_pylist() for c in b.columns)))

    schema = "data binary, kind string, shape array<int>"
    parts = column.mapInArrow(run, schema).repartition(ADDERS).mapInArrow(add, schema)
    return sum(np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in parts.collect())
