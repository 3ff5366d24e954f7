"""What the operators on vectors share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a null id, so that it comes last.
NO_ID = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists as rows of doubles, with zeros after the shorter ones."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = np.asarray(lists.flatten(), np.float64)
    if len(values) == len(lists) * width:
        return values.reshape(len(lists), width)
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 62) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Stretches of rows that agree in the first `keys` columns, of rows sorted by these: (key, rows, whether these are the
    first of the key). A key comes in several stretches where it crosses batches or has over `most` rows."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        turns = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        edges = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a].item() for c in columns)
            for at in range(a, b, min(most, b - a)):
                yield key, batch.slice(at, min(most, b - at)), key != last
                last = key
