"""Vector expressions and the batch scoring kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(vec: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = F.transform(vec, lambda x: (x.cast("double") / norm).cast("float"))
    return F.when(norm > 0, unit).otherwise(vec.cast("array<float>"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; missing components count as 0."""
    def part(x):
        return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))

    return F.aggregate(
        F.zip_with(a, b, lambda x, y: part(x) * part(y)), F.lit(0.0), lambda acc, x: acc + x
    )


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column as a float64 matrix, cut or zero-padded to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = np.nan_to_num(
        column.flatten().to_numpy(zero_copy_only=False).astype("float64"), posinf=np.inf, neginf=-np.inf
    )
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else []
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        take = min(int(width), dims)
        out[rows, :take] = values[np.asarray(starts)[rows][:, None] + np.arange(take)]
    return out
