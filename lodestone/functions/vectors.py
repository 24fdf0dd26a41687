"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(ZERO), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(ZERO), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / size))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(ZERO), lambda s, x: s + x))


def quantise_scale(v: Column) -> Column:
    top = F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))
    return F.when(F.coalesce(top, F.lit(ZERO)) == 0, F.lit(1.0)).otherwise(top / 127)


def quantised(v: Column, scale: Column) -> Column:
    """int8 values by half-even rounding, clipped to -128..127."""
    return F.transform(doubles(v), lambda x: F.least(F.greatest(F.rint(x / scale), F.lit(-128.0)), F.lit(127.0)).cast("int"))


def dequantised(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the best dot product with a vector of the document; 0 for an empty document."""
    best = F.transform(query, lambda a: F.array_max(F.transform(doc, lambda b: dot(a, b))))
    return F.when(F.size(doc) == 0, F.lit(ZERO)).otherwise(F.aggregate(best, F.lit(ZERO), lambda s, x: s + x))


@F.pandas_udf(DoubleType())
def maxsim_packed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """maxsim() over int8 blobs: query bytes and scale, document bytes and scale; rows of 128."""
    for q, q_scale, d, d_scale in batches:
        out = []
        for a, s, b, t in zip(q, q_scale, d, d_scale, strict=True):
            x, y = np.frombuffer(a, np.int8).reshape(-1, 128) * s, np.frombuffer(b, np.int8).reshape(-1, 128) * t
            out.append(float((x @ y.T).max(1).sum()) if len(y) else 0.0)
        yield pd.Series(out)


@F.pandas_udf(ArrayType(FloatType()))
def unpack_int8(blobs: pd.Series, scales: pd.Series) -> pd.Series:
    """Dequantised values of a binary int8 blob."""
    return pd.Series([(np.frombuffer(b, np.int8) * np.float32(s)).astype(np.float32) for b, s in zip(blobs, scales, strict=True)])
