"""Vector columns as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """Whether the vector is not null and holds neither nulls nor non-finite numbers."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= F.lit(1.7976931348623157e308)))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def floors(vector: str, factor: float) -> Column:
    """floor(factor * component) of each component, as long."""
    return F.transform(F.col(vector), lambda c: F.floor(F.lit(factor) * c.cast("double")).cast("bigint"))


def by_length(col: pa.Array):
    """(d, rows, matrix) of each length d of the lists of an Arrow column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    flat, size = col.values.to_numpy(zero_copy_only=False), np.diff(off)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        at = off[rows][:, None] + np.arange(d)[None, :]
        yield d, rows, flat[at.ravel()].reshape(len(rows), d)
