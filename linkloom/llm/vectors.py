"""Integer vectors and batches of them, for the operators over ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size a scaled component may have: squares summed over any real width fit 64 bits.
LIMIT = 1 << 24


def integer_vectors(rows: DataFrame, scale: int, *keep: str) -> DataFrame:
    """(embedding, more) -> the columns ``keep`` and ``v``, components as floor(scale * x).

    Rows go whose vector is null or holds a null or a component that is not finite. A scaled
    component beyond ``LIMIT`` ends the job with an error, as products of such would overflow.
    """
    x = F.col("embedding")
    off = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    too_big = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("int")

    def whole(e):
        y = e.cast("double") * scale
        return F.when(F.abs(y) < LIMIT, F.floor(y).cast("int")).otherwise(too_big)

    return rows.where(x.isNotNull()).where(~off).select(*keep, F.transform(x, whole).alias("v"))


def integer_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros to ``width``."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(column)), sizes), inner] = flat
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
