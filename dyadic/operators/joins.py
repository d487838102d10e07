"""Joins of the screening pipeline.

Dimension tables (thresholds, names, bounds) are broadcast only after their
rows and bytes have been checked against limits; above the limit the join is left
to the planner (sort-merge, or AQE's run-time broadcast when the materialised
side turns out small).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import UNKNOWN_SE_PREFIX

DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 128 << 20
#: vectors of a profile table that are broadcast at most
PROFILE_BYTES = 256 << 20


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value, about: elements of arrays and maps by their type, texts by their length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _width(kind.elementType, x)),
                              F.lit(0)) + 8
        return F.greatest(F.size(value), F.lit(0)) * 8 + 8
    if isinstance(kind, T.MapType):
        return (_width(T.ArrayType(kind.keyType), F.map_keys(value))
                + _width(T.ArrayType(kind.valueType), F.map_values(value)))
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if ``df`` has at most ``max_rows`` rows and about ``max_bytes``
    bytes, else ``df``.

    The check reads at most ``max_rows + 1`` rows, so it stays cheap on a
    table that turns out to be large. Use it on dimension tables only.
    """
    if getattr(df, "_dyadic_size_checked", False):
        return df
    size = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    out = F.broadcast(df) if n <= max_rows and total <= max_bytes else df
    out._dyadic_size_checked = True
    return out


def assert_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    """Fail loudly on a duplicated key (a fan-out would break row identity)."""
    dup = df.groupBy(*key).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"{what}: key {list(key)} is not unique")


def _narrowed(profile: DataFrame, key_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows (_k, _v), the vectors as floats if they are doubles that all came from floats, and about their bytes."""
    kind = profile.schema[vec_col].dataType
    prof = profile.select(F.col(key_col).alias("_k"), F.col(vec_col).alias("_v"))
    of_doubles = kind == T.ArrayType(T.DoubleType())
    exact = F.every(F.col("_v").eqNullSafe(F.col("_v").cast("array<float>").cast(kind))) if of_doubles else F.lit(False)
    # counted where the rows lie
    rows, size, narrow = prof.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(kind, F.col("_v")).cast("long")), F.lit(0)),
                                  exact).first()
    if narrow:
        prof, size = prof.select("_k", F.col("_v").cast("array<float>").alias("_v")), size // 2
    return prof, size + 16 * rows


@dataclass
class HeldProfiles:
    """Profiles that workers keep over several jobs: broadcast blocks of (ids in order, vectors one after the other, where
    each begins)."""
    blocks: list[Broadcast]

    def matrix(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of ``ids`` (zeros where there is none) and which of them have one; missing elements are NaN."""
        m, present = np.zeros((len(ids), width)), np.zeros(len(ids), dtype=bool)
        for block in self.blocks:
            keys, flat, begin = block.value
            at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
            found = np.flatnonzero(keys[at] == ids)
            at = at[found]
            if len(found):
                if (lengths := np.unique(begin[at + 1] - begin[at])).tolist() != [width]:
                    raise ValueError(f"vectors of {lengths.tolist()} values for a model of {width}")
                m[found] = flat[begin[at][:, None] + np.arange(width)]
                present[found] = True
        return m, present


#: bytes of profiles in one broadcast block, about
HELD_BYTES = 16 << 20


def held_profiles(profile: DataFrame, key_col: str = "drug_id", vec_col: str = "vec") -> HeldProfiles | None:
    """The profiles as broadcasts that several jobs use, or None above ``PROFILE_BYTES``. A block at a time passes through the
    driver, which keeps none of them as rows. A duplicated id is refused."""
    assert_unique(profile, [key_col], "profile table")
    profile._dyadic_unique = True
    prof, size = _narrowed(profile, key_col, vec_col)
    if size > PROFILE_BYTES:
        return None
    narrow = prof.schema["_v"].dataType == T.ArrayType(T.FloatType())
    prof = prof.where(F.col("_k").isNotNull() & F.col("_v").isNotNull()).select(
        F.col("_k").cast("long").alias("_k"), F.col("_v").cast("array<float>" if narrow else "array<double>").alias("_v"))
    most, number = HELD_BYTES, np.float32 if narrow else np.float64

    def pack(batches):
        for batch in batches:
            step = max(1, most * len(batch) // max(1, batch.column("_v").flatten().nbytes))
            for a in range(0, len(batch), step):
                keys, vecs = batch.slice(a, step).columns
                parts = keys.to_numpy(), vecs.flatten().to_numpy(zero_copy_only=False).astype(number), vecs.value_lengths().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["keys", "flat", "sizes"])

    sc, kept, blocks = profile.sparkSession.sparkContext, [], []

    def send():
        keys, flat, sizes = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        order = np.argsort(keys, kind="stable")
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        begin = np.concatenate([[0], np.cumsum(sizes[order], dtype=np.int64)])
        flat = flat[np.repeat(starts[order] - begin[:-1], sizes[order]) + np.arange(begin[-1])]
        blocks.append(sc.broadcast((keys[order], flat, begin)))

    for row in prof.mapInArrow(pack, "keys binary, flat binary, sizes binary").toLocalIterator():
        kept.append([np.frombuffer(row[c], kind) for c, kind in (("keys", np.int64), ("flat", number), ("sizes", np.int32))])
        if sum(flat.nbytes for _, flat, _ in kept) >= HELD_BYTES:
            send()
    if kept:
        send()
    return HeldProfiles(blocks)


def profile_lookup(pairs: DataFrame, profile: DataFrame, key_col: str = "drug_id", vec_col: str = "vec",
                   check_unique: bool = True) -> DataFrame:
    """Left-join the profile of ``drug1`` and of ``drug2`` onto every pair row.

    Adds ``vec1`` and ``vec2`` (NULL when a drug has no profile). A duplicated
    profile id is refused, as it would fan out the pairs. Vectors of doubles that
    all came from floats are joined as floats, and up to ``PROFILE_BYTES`` of
    them are broadcast, so that no pair is shuffled with a vector; above it
    adaptive execution joins by shuffle and splits a popular drug.
    """
    if check_unique and not getattr(profile, "_dyadic_unique", False):
        assert_unique(profile, [key_col], "profile table")
        profile._dyadic_unique = True
    kind = profile.schema[vec_col].dataType
    prof, size = _narrowed(profile, key_col, vec_col)
    if size <= PROFILE_BYTES:
        prof = F.broadcast(prof)
    p1 = prof.select(F.col("_k").alias("drug1"), F.col("_v").alias("vec1"))
    p2 = prof.select(F.col("_k").alias("drug2"), F.col("_v").alias("vec2"))
    return (pairs.join(p1, "drug1", "left").join(p2, "drug2", "left")
            .select(*pairs.columns, F.col("vec1").cast(kind).alias("vec1"), F.col("vec2").cast(kind).alias("vec2")))


def threshold_lookup(scored: DataFrame, thr: DataFrame, thr_col: str = "optimal_thr") -> DataFrame:
    """Left-join one threshold per side effect (``thr``: se, optimal_thr)."""
    return scored.join(bounded_broadcast(thr).select("se", thr_col), "se", "left").select(*scored.columns, thr_col)


def se_name_lookup(df: DataFrame, names: DataFrame) -> DataFrame:
    """Attach ``name`` per se, defaulting to ``Unknown SE #<id>``."""
    n = bounded_broadcast(names.select("se", F.col("name").alias("_name")))
    return (df.join(n, "se", "left")
            .withColumn("name", F.coalesce(F.col("_name"), F.concat(F.lit(UNKNOWN_SE_PREFIX), F.col("se").cast("string"))))
            .drop("_name"))
