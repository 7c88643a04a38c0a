"""Vector columns: cosine, serialised form, dimension check, hashed text embedding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null if a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def serialised(a: Column) -> Column:
    """[x,y,...] with eight decimals of the exact value, halves to even, as C's printf; Java's rounds halves up.

    Null elements are left out; nothing but such gives null.
    """

    @F.pandas_udf("string")
    def text(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else "[" + ",".join(["%.8f" % x for x in v.tolist()]) + "]" for v in vectors], dtype=object)

    held = F.array_compact(a)
    return F.when((F.size(held) > 0) | (F.size(a) == 0), text(held))


def of_dimension(a: Column, n: int) -> Column:
    """a, or an error if it hasn't n elements."""
    return F.when(F.size(a) == n, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} dimensions, got "), F.size(a).cast("string"))))
