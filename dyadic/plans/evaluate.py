"""Q1 -- evaluate scored pairs against calibrated thresholds.

thresholds (long) -> one threshold per se -> label both orientations ->
merge orientations -> per-se SN/SP/PR/AUC/AUPR -> describe.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from ..operators.metrics import merged_performance, perf_describe
from ..operators.thresholds import apply_threshold, merge_both_pairs, merge_scored_orientations, threshold_mean


@dataclass
class Evaluation:
    """The merged table is a plan; the performance tables are built on first
    use (their ordered scan writes a checkpoint, so they cost a job)."""
    merged: DataFrame
    thresholds: DataFrame

    @cached_property
    def _perf(self):
        return merged_performance(self.merged, with_excluded=True)

    @property
    def performance(self) -> DataFrame:
        return self._perf[0]

    @property
    def excluded(self) -> DataFrame:
        return self._perf[1]

    @cached_property
    def describe(self) -> DataFrame:
        return perf_describe(self.performance)


def orientations(scored: DataFrame, fwd: str = "score_fwd", rev: str = "score_rev"):
    """Split a table holding both orientations' scores into the original rows
    and the swapped rows, as two externally scored tables."""
    copies = [c for c in ("n_copies",) if c in scored.columns]
    ori = scored.select("drug1", "drug2", "se", "label", F.col(fwd).alias("predicted_score"), *copies)
    swi = scored.select(F.col("drug2").alias("drug1"), F.col("drug1").alias("drug2"), "se", "label",
                        F.col(rev).alias("predicted_score"), *copies)
    return ori, swi


def evaluate_scored(scored: DataFrame, thresholds: DataFrame, mode: str = "last5") -> Evaluation:
    """As ``evaluate`` when one table (one row per drug1, drug2 and se) holds the scores of both orientations
    (``score_fwd``, ``score_rev``): nothing is joined to its swap."""
    thr = bounded_broadcast(threshold_mean(thresholds, mode))
    return Evaluation(merge_scored_orientations(scored, thr), thr)


def evaluate(ori: DataFrame, swi: DataFrame, thresholds: DataFrame, mode: str = "last5") -> Evaluation:
    thr = bounded_broadcast(threshold_mean(thresholds, mode))
    merged = merge_both_pairs(apply_threshold(ori, thr), apply_threshold(swi, thr), thr)
    return Evaluation(merged, thr)
