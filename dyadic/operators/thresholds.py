"""Thresholds: averaging calibration samples, labelling scores, merging the two
orientations of a pair.

Thresholds are kept long, ``(se, sample_no, thr)``; the wide CSV of the
reference (``SE`` then one column per sample) is only an edge format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gap, mean_of_orientations, predicted_label
from .joins import bounded_broadcast

SCORED_COLUMNS = ["drug1", "drug2", "se", "label", "predicted_label", "predicted_score", "gap"]
MERGED_COLUMNS = ["drug1", "drug2", "se", "label", "predicted_label_x", "predicted_label_y",
                  "predicted_score_x", "predicted_score_y", "mean_predicted_score",
                  "final_predicted_label", "gap", "n_copies"]


def threshold_mean(thr: DataFrame, mode: str = "last5", out: str = "optimal_thr") -> DataFrame:
    """One threshold per se from ``n`` calibration samples; ``n`` is the width of
    the whole table (its largest sample number + 1), so a side effect that lacks
    the last samples still averages the same sample numbers as the others.

    ``mode='last5'`` averages the last five samples. ``mode='compat'`` is the
    reference's slice of the wide frame, samples ``n-7 .. n-3``; fewer than seven
    samples are refused, as that slice would run into the id column. Missing
    sample values are skipped, as in a pandas mean.
    """
    last = thr.agg(F.max("sample_no")).first()[0]
    n = 0 if last is None else last + 1
    if mode == "compat":
        if 0 < n < 7:
            raise ValueError(f"mode 'compat' needs at least 7 samples, found {n}")
        lo, hi = n - 7, n - 3
    elif mode == "last5":
        lo, hi = n - 5, n - 1
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return thr.groupBy("se").agg(F.avg(F.when(F.col("sample_no").between(lo, hi), F.col("thr"))).alias(out))


def apply_threshold(scored: DataFrame, thr: DataFrame, score: str = "predicted_score",
                    thr_col: str = "optimal_thr") -> DataFrame:
    """Label and gap per row: ``predicted_label = score < thr`` (strict),
    ``gap = |score - thr|``. ``thr`` has one row per se (broadcast after a
    size check)."""
    t = bounded_broadcast(thr).select("se", thr_col)
    j = scored.join(t, "se", "left")
    return j.select(*[c for c in scored.columns],
                    predicted_label(score, thr_col).alias("predicted_label"),
                    gap(score, thr_col).alias("gap"))


def merge_both_pairs(ori: DataFrame, swi: DataFrame, thr: DataFrame, thr_col: str = "optimal_thr") -> DataFrame:
    """Join of the scores of ``(drug1, drug2, se)`` with the scores of the
    swapped rows ``(drug2, drug1, se)``; mean score, final label and gap.

    ``ori``/``swi`` carry ``drug1, drug2, se, label, predicted_label,
    predicted_score``. Identical rows are collapsed on each side first (map-side
    partial aggregation) and joined once: a key present k times on one side
    and k' times on the other gives one row with ``n_copies = k * k'`` where a
    row-level inner join would emit k x k' copies -- same multiset, no blow-up
    on a heavily copied key.
    """
    wa = F.col("n_copies") if "n_copies" in ori.columns else F.lit(1)
    wb = F.col("n_copies") if "n_copies" in swi.columns else F.lit(1)
    a = (ori.groupBy("drug1", "drug2", "se", "label",
                     F.col("predicted_label").alias("predicted_label_x"),
                     F.col("predicted_score").alias("predicted_score_x"))
         .agg(F.sum(wa).cast("long").alias("_na")))
    b = (swi.groupBy(F.col("drug2").alias("drug1"), F.col("drug1").alias("drug2"), "se",
                     F.col("predicted_label").alias("predicted_label_y"),
                     F.col("predicted_score").alias("predicted_score_y"))
         .agg(F.sum(wb).cast("long").alias("_nb")))
    m = a.join(b, ["drug1", "drug2", "se"])
    m = m.withColumn("mean_predicted_score", mean_of_orientations("predicted_score_x", "predicted_score_y"))
    t = bounded_broadcast(thr).select("se", thr_col)
    m = m.join(t, "se", "left")
    return m.select(*MERGED_COLUMNS[:-3],
                    predicted_label("mean_predicted_score", thr_col).alias("final_predicted_label"),
                    gap("mean_predicted_score", thr_col).alias("gap"),
                    (F.col("_na") * F.col("_nb")).alias("n_copies"))


def merge_scored_orientations(df: DataFrame, thr: DataFrame, fwd: str = "score_fwd", rev: str = "score_rev",
                              thr_col: str = "optimal_thr") -> DataFrame:
    """The merge when one row already holds both orientations' scores (our own
    scorer emits both in one pass): no join, same columns as ``merge_both_pairs``."""
    t = bounded_broadcast(thr).select("se", thr_col)
    m = df.join(t, "se", "left").select(
        "drug1", "drug2", "se", "label",
        predicted_label(fwd, thr_col).alias("predicted_label_x"),
        predicted_label(rev, thr_col).alias("predicted_label_y"),
        F.col(fwd).alias("predicted_score_x"), F.col(rev).alias("predicted_score_y"),
        mean_of_orientations(fwd, rev).alias("mean_predicted_score"), thr_col)
    return m.select(*MERGED_COLUMNS[:-3],
                    predicted_label("mean_predicted_score", thr_col).alias("final_predicted_label"),
                    gap("mean_predicted_score", thr_col).alias("gap"), F.lit(1).cast("long").alias("n_copies"))
