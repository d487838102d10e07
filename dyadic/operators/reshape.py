"""Projections, reshapes and set operations on pair tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import clip_vec, fill_zero


# -------------------------------------------------------------- pair orientation
def swap_pair(df: DataFrame) -> DataFrame:
    """``(drug1, drug2, ...) -> (drug2, drug1, ...)`` with the names kept."""
    cols = [F.col("drug2").alias("drug1") if c == "drug1" else F.col("drug1").alias("drug2") if c == "drug2"
            else F.col(c) for c in df.columns]
    return df.select(*cols)


def mirror_pairs(df: DataFrame, row_id: str | None = "row_id", score_cols: tuple[str, str] | None = None) -> DataFrame:
    """``UNION ALL`` of the table and its swapped copy, labels kept.

    With ``row_id`` the ids stay unique: ``2*id`` original, ``2*id+1`` swapped.
    With ``score_cols=(fwd, rev)`` the swapped copy takes the reverse score as
    ``score`` and the original the forward one.
    """
    # both rows of a pair come from one reading of the table
    both = df.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_swapped"))
    either = lambda a, b: F.when(F.col("_swapped"), F.col(b)).otherwise(F.col(a))
    out = {c: F.col(c) for c in df.columns} | {"drug1": either("drug1", "drug2"), "drug2": either("drug2", "drug1")}
    if row_id:
        out[row_id] = F.col(row_id) * 2 + F.col("_swapped").cast("int")
    if score_cols:
        fwd, rev = score_cols
        out["score"] = either(fwd, rev)
        out = {c: v for c, v in out.items() if c not in (fwd, rev)}
    mirrored = both.select(*[v.alias(c) for c, v in out.items()])
    mirrored._dyadic_stored = getattr(df, "_dyadic_stored", False)  # as cheap to read again as the table
    return mirrored


def occurs_once(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose value over ``cols`` occurs exactly once (``drop_duplicates(keep=False)``)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")


def holdout_remainder(train: DataFrame, holdout: DataFrame, cols: Sequence[str] = ("drug1", "drug2", "se", "label"),
                      strict: bool = False, key: str = "row_id") -> DataFrame:
    """Training rows left after a hold-out draw.

    Reference rule (default): concatenate train and hold-out and drop every row
    that occurs more than once on ``cols`` -- so a row already duplicated in
    ``train`` disappears even if it was never drawn. ``strict=True`` is the
    plain anti-join on ``key``.
    """
    cols = list(cols)
    if strict:
        return train.join(holdout.select(key), key, "left_anti")
    return occurs_once(train.select(*cols).unionAll(holdout.select(*cols)), cols)


# ------------------------------------------------------------ descriptor splits
def fingerprint_columns(columns: Sequence[str], pattern: str = "fp") -> list[str]:
    """Columns whose name *contains* ``pattern`` (unanchored), in file order."""
    rx = re.compile(pattern)
    return [c for c in columns if rx.search(c)]


def _arr(cols):
    return F.array(*[F.col(c).cast("double") for c in cols]) if cols else F.array().cast("array<double>")


def split_descriptor_both(df: DataFrame, n_desc: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """``(fp, desc, y)``: fp = every column containing "fp"; of the rest, the
    first ``n_desc`` are descriptors, the remainder targets (file order)."""
    fp = fingerprint_columns([c for c in df.columns if c not in keep])
    rest = [c for c in df.columns if c not in fp and c not in keep]
    return df.select(*keep, _arr(fp).alias("fp"), _arr(rest[:n_desc]).alias("desc"), _arr(rest[n_desc:]).alias("y"))


def split_fp_label(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(fp, rest)``."""
    fp = fingerprint_columns([c for c in df.columns if c not in keep])
    rest = [c for c in df.columns if c not in fp and c not in keep]
    return df.select(*keep, _arr(fp).alias("fp"), _arr(rest).alias("rest"))


def split_desc_label(df: DataFrame, n_desc: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """``(desc, y)`` with the fingerprints dropped."""
    return split_descriptor_both(df, n_desc, keep).drop("fp")


def split_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(fp, desc)`` where desc is everything that is not a fingerprint."""
    return split_fp_label(df, keep).withColumnRenamed("rest", "desc")


# ------------------------------------------------------------ vectors and lists
def pair_se_binary(df: DataFrame, n_se: int, list_col: str = "se_list") -> DataFrame:
    """Pair x side-effect indicator vector: 1 at every listed id (duplicates
    collapse). Membership is tested against the distinct ids (at most the
    catalogue); ``se_counts`` (distinct id, count) is the sparse form to keep
    when the dense vector is not needed."""
    src = "se_counts.se" if "se_counts" in df.columns else list_col
    return df.withColumn(
        "se_binary",
        F.transform(F.sequence(F.lit(0), F.lit(n_se - 1)),
                    lambda i: F.array_contains(F.col(src), i).cast("int")))


def se_one_hot(df: DataFrame, n_se: int, col: str = "se") -> DataFrame:
    """One-hot of the side-effect id as a length-``n_se`` int array."""
    return df.withColumn("se_one_hot", F.transform(F.sequence(F.lit(0), F.lit(n_se - 1)),
                                                   lambda i: (i == F.col(col)).cast("int")))


def fill_zero_vec(df: DataFrame, col: str = "vec") -> DataFrame:
    return df.withColumn(col, fill_zero(col))


def clip_values(df: DataFrame, col: str = "vec", lo: float = -2.0, hi: float = 2.0) -> DataFrame:
    return df.withColumn(col, clip_vec(col, lo, hi))
