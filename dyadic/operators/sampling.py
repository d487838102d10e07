"""Sampling and splitting without collecting anything, without putting a
stratum into one task and without moving the rows that are not drawn.

A draw keeps the smallest order keys of a stratum. The rows are read where they lie
and never repeated per sample: one pass counts, per stratum and sample, the keys in
``BINS`` equal ranges (a histogram, which adds up over partitions and is all that is
shuffled); the range in which the draw ends follows. Only the rows of that range, one
in ``BINS`` or so, are ranked by (key, row id), which gives the last row of the draw
as a bound. With the bounds (one per stratum and sample) the draw is a column
expression on the table: an array of the samples that take the row.

A draw of a tenth is itself a tenth of the rows, so heaps of its smallest keys would
be as large as the draw; histograms have a fixed size.

Draw order. A draw takes, inside each stratum, the rows with the smallest
*order key*, ties broken by the row id. The default key is
``xxhash64(row_id, k)`` (k = sample number). ``method='lcg'`` is a portable
permutation, ``((row_id % 1000003) * 7919 + k * 104729) % 1000003``, that
DuckDB computes identically -- used by the SQL-checked queries; it has only
about a million distinct values, so it is not meant for larger strata.

Sizes use half-to-even rounding, as the reference's pandas ``sample(frac=)``
does: strata of 5 rows give 0 at 10 %, 15 give 2, 25 give 2.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, stored_once
from .joins import bounded_broadcast
from .scan import ordered_scan

#: relative rank error of the quantile sketches is at most one in so many
ACCURACY = 10_000
#: equal ranges of the order keys that are counted per stratum and sample
BINS = 1024
#: rows of one (sample, stratum) in the range where its draw ends, up to which a window ranks them
WINDOW_ROWS = 200_000
PRIME = 1000003
MULT = 7919
STEP = 104729


def draw_key(row_id: str = "row_id", sample_no: Column | int = 0, method: str = "xxhash64") -> Column:
    rid = F.col(row_id)
    k = sample_no if isinstance(sample_no, Column) else F.lit(sample_no)
    if method == "lcg":
        return ((rid % PRIME) * MULT + k * STEP) % PRIME
    if method == "xxhash64":
        return F.xxhash64(rid, k)
    raise ValueError(method)


def stratified_holdout(df: DataFrame, frac: float = 0.1, strata: Sequence[str] = ("se", "label"),
                       sample_no: int = 0, row_id: str = "row_id", method: str = "xxhash64") -> DataFrame:
    """Per stratum, ``bround(frac * n)`` rows without replacement."""
    return repeated_holdout(df, frac, 1, strata, row_id, method, first=sample_no).drop("sample_no")


def repeated_holdout(df: DataFrame, frac: float = 0.1, samples: int = 1, strata: Sequence[str] = ("se", "label"),
                     row_id: str = "row_id", method: str = "xxhash64", first: int = 0) -> DataFrame:
    """``samples`` independent draws in one job (rows may recur across draws).
    ``row_id`` identifies a row."""
    return (with_samples(df, frac, samples, strata, row_id, method, first)
            .select(F.explode("_samples").alias("sample_no"), *df.columns))


def with_samples(df: DataFrame, frac: float = 0.1, samples: int = 1, strata: Sequence[str] = ("se", "label"),
                 row_id: str = "row_id", method: str = "xxhash64", first: int = 0) -> DataFrame:
    """``df`` with ``_samples``, the (ascending) numbers of the draws that take the row."""
    df = stored_once(df, "drawn-from")  # read for the histogram, the last rows and the draw
    return _taken(df, draw_bounds(df, frac, samples, strata, row_id, method, first), strata, row_id, method)


def _taken(df: DataFrame, bounds: DataFrame, strata: Sequence[str], row_id: str, method: str) -> DataFrame:
    """``df`` with ``_samples``, the draws whose bound its ``row_id`` keeps to."""
    bounds = bounds.checkpoint()  # counted and read
    # one row per stratum
    per = bounded_broadcast(bounds.groupBy(*strata).agg(F.collect_list(F.struct(
        "sample_no", F.col("_key").alias("key"), F.col("_row").alias("row"))).alias("_bounds")))
    rows = df.join(per, [df[c].eqNullSafe(per[c]) for c in strata], "left")
    key = lambda b: draw_key(row_id, b["sample_no"], method)
    taken = F.filter(F.coalesce("_bounds", F.array()), lambda b: (key(b) < b["key"])
                     | ((key(b) == b["key"]) & (F.col(row_id) <= b["row"])))
    return rows.select(*[df[c] for c in df.columns], F.array_sort(F.transform(taken, lambda b: b["sample_no"])).alias("_samples"))


def training_rows(df: DataFrame, frac: float = 0.1, samples: int = 1,
                  cols: Sequence[str] = ("drug1", "drug2", "se", "label"), strata: Sequence[str] = ("se", "label"),
                  row_id: str = "row_id", method: str = "xxhash64", first: int = 0) -> DataFrame:
    """What every draw leaves for training, in one pass: the values of ``cols`` that occur once in the table, and in
    ``train_in`` the draws that do not take them (the rule of ``reshape.holdout_remainder``: table and hold-out
    together, values that occur more than once dropped). One shuffle, on ``cols``, whatever the number of draws."""
    n = F.count(F.lit(1))
    drawn = with_samples(df, frac, samples, strata, row_id, method, first)
    # a value that occurs once has one row, so any of its lists is the list
    once = drawn.groupBy(*cols).agg(n.alias("_n"), F.first("_samples").alias("_samples")).where(F.col("_n") == 1)
    numbers = F.sequence(F.lit(first), F.lit(first + samples - 1))
    return once.select(*cols, F.array_except(numbers, "_samples").alias("train_in"))


def key_bin(key: Column, method: str) -> Column:
    """The key's range, from 0 to ``BINS`` - 1, ascending with it."""
    if method == "lcg":
        return F.floor(key * BINS / PRIME).cast("int")
    return (F.shiftright(key, 64 - (BINS - 1).bit_length()) + BINS // 2).cast("int")


def draw_bounds(df: DataFrame, frac: float, samples: int, strata: Sequence[str], row_id: str, method: str,
                first: int = 0) -> DataFrame:
    """Per sample and stratum that draws any rows: the order key and the row id of the last one (``_key``, ``_row``)."""
    import numpy as np
    import pandas as pd
    ensure_checkpoint_dir(df.sparkSession)
    strata = list(strata)
    by = ["sample_no", *strata]
    numbers = F.sequence(F.lit(first), F.lit(first + samples - 1))
    bins = F.transform(numbers, lambda k: key_bin(draw_key(row_id, k, method), method))
    fields = [f for f in df.schema.fields if f.name in strata]

    def count(batches):
        found: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, at in pdf.groupby(strata, dropna=False, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(v) else v for v in key)
                flat = np.stack(pdf["_bins"].to_numpy()[at]) + np.arange(samples) * BINS
                got = np.bincount(flat.ravel(), minlength=samples * BINS)
                found[key] = found[key] + got if key in found else got
        for key, total in found.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({**{c: pd.Series([v] * len(at), dtype=object) for c, v in zip(strata, key)},
                                "sample_no": (first + at // BINS).astype(np.int32), "_bin": (at % BINS).astype(np.int32),
                                "_n": total[at]})

    schema = T.StructType([*[f for c in strata for f in fields if f.name == c], T.StructField("sample_no", T.IntegerType()),
                           T.StructField("_bin", T.IntegerType()), T.StructField("_n", T.LongType())])
    keys = df.select(*strata, bins.alias("_bins"))
    histogram = keys.mapInPandas(count, schema).groupBy(*by, "_bin").agg(F.sum("_n").alias("_n"))
    # at most BINS rows a group
    so_far = Window.partitionBy(*by).orderBy("_bin")
    ends = (histogram.select("*", F.sum("_n").over(so_far).alias("_upto"),
                             F.bround(F.lit(frac) * F.sum("_n").over(Window.partitionBy(*by)), 0).alias("_take"))
            .where((F.col("_take") > 0) & (F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
            .select(*by, "_bin", "_n", (F.col("_take") - F.col("_upto") + F.col("_n")).cast("long").alias("_rest"))
            .checkpoint())  # one row per sample and stratum, read twice
    most = ends.agg(F.max("_n")).first()[0] or 0
    per = bounded_broadcast(ends.groupBy(*strata).agg(F.collect_list(F.struct("sample_no", "_bin", "_rest")).alias("_ends")))
    rows = df.select(*strata, row_id).join(per, [df[c].eqNullSafe(per[c]) for c in strata])
    inside = F.filter("_ends", lambda e: key_bin(draw_key(row_id, e["sample_no"], method), method) == e["_bin"])
    near = rows.select(*[df[c] for c in strata], df[row_id].alias("_row"), F.explode(inside).alias("_e"))
    near = near.select("_e.sample_no", *strata, "_row", F.col("_e._rest").alias("_rest"),
                       draw_key("_row", F.col("_e.sample_no"), method).alias("_key"))
    if most <= WINDOW_ROWS:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_key", "_row"))
        last = near.withColumn("_place", place).where(F.col("_place") == F.col("_rest"))
    else:
        last = ordered_scan(near.withColumn("_one", F.lit(1)), by, ["_key", "_row"], sums=["_one"]).where(
            F.col("cum__one") == F.col("_rest"))
    return last.select(*by, "_key", "_row")


def pair_holdout(df: DataFrame, frac: float = 0.1, strata: Sequence[str] = ("se", "label"),
                 sample_no: int = 0, method: str = "xxhash64") -> DataFrame:
    """Hold-out by *unordered pair*: both orientations of a drawn pair leave
    training together (against the leakage of drawing mirrored rows one by
    one). The draw runs over canonical rows ``(least, greatest, se, label)``
    keyed by ``row_id = min(row_id)`` of the pair; every row of ``df`` whose
    canonical key was drawn is returned."""
    lo, hi = F.least("drug1", "drug2"), F.greatest("drug1", "drug2")
    # one shuffle brings the rows of a canonical row together; all carry its id, and one stands for it in the draw
    same = Window.partitionBy("_a", "_b", *strata)
    keyed = (df.select("*", lo.alias("_a"), hi.alias("_b"))
             .select("*", F.min("row_id").over(same).alias("_first"), F.row_number().over(same.orderBy("row_id")).alias("_place")))
    # a row without one of the keys counts in the draw but is never returned
    known = reduce(and_, [F.col(c).isNotNull() for c in ("_a", "_b", *strata)])
    keyed = stored_once(keyed.select(*df.columns, "_first", (F.col("_place") == 1).alias("_stands"), known.alias("_known")), "pairs")
    bounds = draw_bounds(keyed.where("_stands").select(*strata, "_first"), frac, 1, strata, "_first", method, sample_no)
    drawn = _taken(keyed, bounds, strata, "_first", method).where("_known").where(F.size("_samples") > 0)
    return drawn.select(*df.columns)


def _as_double(key: str) -> Column:
    """Keys as the sketch sees them: it works on doubles, which keep the order of longs but not all their digits."""
    return F.col(key).cast("double")


def row_at_rank(df: DataFrame, order: Sequence[str], share: float, rank: int) -> tuple | None:
    """Values of ``order`` of the row with this 1-based rank, where ``rank`` is
    about ``share`` of all rows. ``order[0]`` is narrowed by a quantile sketch;
    only the rows between two sketch values are ranked exactly."""
    key = order[0]
    slack = 2 / ACCURACY + 3 / max(1, df.count())
    at = [max(0.0, share - slack), min(1.0, share + slack)]
    low, high = df.agg(F.percentile_approx(key, at, ACCURACY)).first()[0]
    value = _as_double(key)
    below = df.where(value < float(low)).count()
    near = df.where(value.between(float(low), float(high))).select(*order, F.lit(1).alias("_one"))
    row = ordered_scan(near, [], order, sums=["_one"], broadcast_offsets=True).where(
        F.col("cum__one") == rank - below).first()
    return None if row is None else tuple(row[c] for c in order)


def _up_to(order: Sequence[str], row: tuple) -> Column:
    """Is a row at or before ``row`` in this order? (lexicographic)"""
    out = F.lit(True)
    for c, v in reversed(list(zip(order, row))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def train_test_split(df: DataFrame, train_frac: float = 0.8, row_id: str = "row_id", seed: int = 0,
                     method: str = "xxhash64") -> DataFrame:
    """Shuffle and cut: the first ``bround(train_frac * n)`` rows of the shuffled
    order are ``train``, the rest ``test`` (column ``split``). The cut row is
    found first; the split itself is a column expression."""
    df = stored_once(df, "split")  # read for the size, the sketch, the cut row and the split
    keyed = df.select("*", draw_key(row_id, seed, method).alias("_key"))
    n = df.count()
    cut = round(train_frac * n)  # half to even
    order = ["_key", row_id]
    row = row_at_rank(keyed.select(*order), order, train_frac, cut) if cut else None
    train = _up_to(order, row) if row else F.lit(False)
    return keyed.select(*df.columns, F.when(train, "train").otherwise("test").alias("split"))


def tail_validation_split(df: DataFrame, validation_split: float = 0.1, row_id: str = "row_id") -> DataFrame:
    """The last rows in row order, as a trailing validation split of a fit
    (``floor(n * (1 - v))`` rows train, the rest validation)."""
    df = stored_once(df, "split")
    n = df.count()
    cut = math.floor(n * (1.0 - validation_split))
    row = row_at_rank(df.select(row_id), [row_id], 1.0 - validation_split, cut) if cut else None
    return df.where(~_up_to([row_id], row)) if row else df
