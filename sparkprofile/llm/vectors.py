"""Vector columns as numpy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def doubles(column: str) -> Column:
    """A numeric array column as ``array<double>``."""
    return F.col(f"`{column}`").cast("array<double>")


def widest(df: DataFrame, column: str) -> int:
    """The largest number of components of a vector that can be used; 0 if there is none."""
    usable = f"`{column}` IS NOT NULL AND forall(cast(`{column}` AS array<double>), x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return int(df.where(usable).agg(F.max(F.size(F.col(f"`{column}`")))).first()[0] or 0)


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row numbers, matrix)`` of the vectors of a batch that are not null and hold only finite numbers.

    Shorter vectors are filled up with zeros to ``width``; -0.0 becomes 0.0, so that equal vectors have equal bytes.
    """
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (sizes >= 0) & (wrong[ends] == wrong[ends - np.maximum(sizes, 0)])
    held = np.repeat(good, np.maximum(sizes, 0))
    out = np.zeros((int(good.sum()), width))
    out[np.arange(width)[None, :] < sizes[good][:, None]] = flat[held]
    return np.flatnonzero(good), out + 0.0
