"""Q2 -- calibrate one decision threshold per side effect from hold-out draws.

mirror the observations -> ``samples`` stratified hold-out draws (one job,
``sample_no`` is a column) -> score the drawn rows -> per (sample, se):
medians, ROC cut-off, SN/SP/PR/AUC/AUPR -> long thresholds
``(se, sample_no, thr)``. The fit between draw and scoring is not part of
this job: the scorer is an argument (weights arrive as inputs).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import calibrate_se
from ..operators.sampling import repeated_holdout
from ..session import stored_once

PAIR_COLS = ["drug1", "drug2", "se", "label"]


@dataclass
class Calibration:
    thresholds: DataFrame      # se, sample_no, thr
    table: DataFrame           # sample_no, se, median_pos, median_neg, optimal_thr, sn, sp, pr, auc, aupr
    holdout: DataFrame         # sample_no + drawn rows
    train: DataFrame
    samples: int

    @cached_property
    def sizes(self) -> DataFrame:
        """sample_no, n_train, n_holdout (computed on first use)."""
        return remainder_sizes(self.train, self.holdout, self.samples)


def remainder_sizes(train: DataFrame, holdout: DataFrame, samples: int, first: int = 0) -> DataFrame:
    """Per sample, the size of the reference's remainder (rows occurring once
    in train + hold-out) and of the hold-out.

    The drawn rows are training rows, so a row survives exactly when its key
    occurs once in ``train`` and was not drawn: ``n_train = (#keys occurring
    once in train) - (#drawn rows with such a key)``. No copy of the training
    set per sample is made: training rows and drawn rows meet in one shuffle on
    the key, where the drawn rows of each sample are counted. A key with a
    missing value is no drawn row's key."""
    numbers = range(first, first + samples)
    n, sample = F.count(F.lit(1)), F.lit(None).cast(holdout.schema["sample_no"].dataType)
    rows = train.select(*PAIR_COLS, sample.alias("sample_no")).unionByName(
        holdout.dropna(subset=[*PAIR_COLS, "sample_no"]).select(*PAIR_COLS, "sample_no"))
    per_key = rows.groupBy(*PAIR_COLS).agg(F.count_if(F.col("sample_no").isNull()).alias("_n"),
                                           *[F.count_if(F.col("sample_no") == k).alias(f"_d{k}") for k in numbers])
    n_once, *drawn = per_key.where(F.col("_n") == 1).agg(
        n, *[F.coalesce(F.sum(f"_d{k}"), F.lit(0)).cast("long") for k in numbers]).first()
    left = F.array(*[F.lit(n_once - d) for d in drawn]).cast("array<long>")
    n_hold = holdout.groupBy("sample_no").agg(n.alias("n_holdout"))
    return n_hold.select("sample_no", F.coalesce(F.get(left, F.col("sample_no") - first), F.lit(n_once)).cast("long").alias("n_train"),
                         "n_holdout")


def calibrate(train: DataFrame, samples: int = 1, frac: float = 0.1,
              score_fn: Callable[[DataFrame], DataFrame] | None = None, score: str = "score",
              method: str = "xxhash64") -> Calibration:
    """``train`` holds ``row_id, drug1, drug2, se, label`` (already mirrored if
    wanted) and, without ``score_fn``, a ``score`` column."""
    train = stored_once(train, "observations")
    hold = repeated_holdout(train, frac, samples, ("se", "label"), "row_id", method)
    scored = score_fn(hold) if score_fn else hold
    table = calibrate_se(scored, by=["sample_no", "se"], score=score)
    thresholds = table.select("se", "sample_no", F.col("optimal_thr").alias("thr"))
    return Calibration(thresholds, table, hold, train, samples)
