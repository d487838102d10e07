"""Array-column expressions for profile vectors (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_zero(vec) -> Column:
    """NaN and NULL elements become 0 (the ``fillna(0)`` before clustering)."""
    return F.transform(_c(vec), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def clip_vec(vec, lo: float = -2.0, hi: float = 2.0) -> Column:
    return F.transform(_c(vec), lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def l2norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, z: s + z * z))


def translation_distance(e_from, r, e_to) -> Column:
    """``|| e_from + r - e_to ||_2`` (identity head and tail)."""
    d = F.zip_with(F.zip_with(_c(e_from), _c(r), lambda x, y: x + y), _c(e_to), lambda x, y: x - y)
    return l2norm(d)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def _with_scalar(arr, scalar, op) -> Column:
    """Element-wise ``op(x, scalar)``. The scalar is handed to ``zip_with`` as
    a repeated array argument, which is evaluated once per row; referring to
    a row-level aggregate *inside* a lambda would re-evaluate it for every
    element (O(width^2) per row, worse once the optimizer inlines it)."""
    a = _c(arr)
    return F.zip_with(a, F.array_repeat(scalar, F.size(a)), op)


def mean(vec) -> Column:
    v = _c(vec)
    return F.aggregate(v, F.lit(0.0), lambda s, z: s + z) / F.size(v)


def centre(vec) -> Column:
    return _with_scalar(vec, mean(vec), lambda x, m: x - m)


def with_centre_unit(df: DataFrame, vec, out: str) -> DataFrame:
    """Add ``out``: the vector centred and scaled to unit length (NULL if
    constant); O(width) per row."""
    t = df.withColumn("_cu_c", centre(vec))
    n = l2norm("_cu_c")
    t = t.withColumn(out, F.when(n > 0, _with_scalar("_cu_c", n, lambda x, k: x / k)))
    return t.drop("_cu_c")
