"""Per-outcome evaluation: confusion counts, SN/SP/PR, ROC AUC, average
precision, ROC points, optimal cut-off, medians, calibration and test tables.

All curve metrics come from one *score histogram* per group (one row per
distinct score with the count of each class), scanned in score order with
``operators.scan.ordered_scan`` -- no group is ever gathered into one task and
nothing is collected. Conventions of the reference:

* the curve metrics (AUC, AP, ROC, cut-off) treat ``1 - label`` as the
  positive class -- a *high* score means "no interaction";
* the confusion counts treat ``label = 1`` (interaction) as positive;
* ties in the score count one half in AUC; AP is the step sum
  ``sum(dR * P)`` without interpolation;
* ROC points drop collinear intermediate points (equal consecutive steps),
  a ``(0, 0)`` point with threshold ``+inf`` is prepended; the optimal cut-off
  is the kept point with the smallest ``|tpr + fpr - 1|``, ties to the highest
  threshold;
* a missing score is NULL (the reference's NaN); ratios with a zero
  denominator are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import calibration_label, safe_ratio
from .joins import bounded_broadcast
from .scan import ordered_scan

INF = float("inf")


def _cnt(cond, weight: str | None = None):
    w = F.col(weight) if weight else F.lit(1)
    return F.sum(F.when(cond, w).otherwise(0)).cast("long")


def score_histogram(scored: DataFrame, by: Sequence[str], score: str, label: str,
                    extra: dict | None = None, weight: str | None = None) -> DataFrame:
    """One row per (group, distinct score) -- the missing score included as
    its own row -- with ``c0`` / ``c1`` = rows of label 0 / 1 with a score, and
    one count per ``extra`` condition. Partial aggregation happens before the
    shuffle, so this is the only pass over the scored rows. ``weight`` names a
    copy-count column (a row standing for ``weight`` identical rows)."""
    s, l = F.col(score), F.col(label)
    aggs = [_cnt(s.isNotNull() & (l == 0), weight).alias("c0"), _cnt(s.isNotNull() & (l == 1), weight).alias("c1")]
    aggs += [_cnt(cond, weight).alias(name) for name, cond in (extra or {}).items()]
    return scored.groupBy(*by, s.alias("score")).agg(*aggs)


def _scanned(scored, by, score, label, broadcast_offsets=None, extra=None, weight=None):
    hist = score_histogram(scored, by, score, label, extra, weight)
    return ordered_scan(hist, by, ["score"], sums=["c0", "c1"], lags=["c0", "c1"],
                        broadcast_offsets=broadcast_offsets)


def _point_columns(s: DataFrame) -> DataFrame:
    """Curve quantities of each distinct score (descending-order view). The
    missing-score row (counts 0, sorted first) is never a curve point."""
    P, N = F.col("tot_c0"), F.col("tot_c1")
    tps = P - F.col("cum_c0") + F.col("c0")          # y=1 (label 0) with score >= s
    fps = N - F.col("cum_c1") + F.col("c1")          # y=0 (label 1) with score >= s
    lowest = (F.col("cum_c0") == F.col("c0")) & (F.col("cum_c1") == F.col("c1"))
    highest = (F.col("cum_c0") == P) & (F.col("cum_c1") == N)
    kept = F.col("score").isNotNull() & (
        lowest | highest | (F.col("c0") != F.col("prev_c0")) | (F.col("c1") != F.col("prev_c1")))
    tpr = F.try_divide(tps.cast("double"), P)
    fpr = F.try_divide(fps.cast("double"), N)
    return s.select("*", tps.alias("tps"), fps.alias("fps"), kept.alias("kept"),
                    tpr.alias("tpr"), fpr.alias("fpr"),
                    F.abs(tpr + fpr - 1).alias("obj"))


def _quantile_aggs(count_col: str, cum_col: str, total_col: str, p: float, name: str):
    """Exact ``quantile_cont(p)`` of one class from the ascending scan."""
    pos = F.lit(p) * (F.col(total_col) - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    below = F.col(cum_col) - F.col(count_col)
    at = lambda r: (F.col(count_col) > 0) & (below <= r) & (r < F.col(cum_col))
    return [F.max(F.when(at(lo), F.col("score"))).alias(f"_{name}_lo"),
            F.max(F.when(at(hi), F.col("score"))).alias(f"_{name}_hi"),
            F.first(pos - lo).alias(f"_{name}_frac")]


def _interp(name: str):
    lo, hi, frac = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_frac")
    return (lo + frac * (hi - lo)).alias(name)


def curve_summary(scored: DataFrame, by: Sequence[str] = ("se",), score: str = "score",
                  label: str = "label", broadcast_offsets: bool | None = None,
                  extra: dict | None = None, weight: str | None = None) -> DataFrame:
    """Per group: class sizes, AUC, AP, optimal cut-off, the counts at the
    cut-off and the medians of both classes -- all from one scan. Each
    ``extra`` condition is counted per row and summed per group (same pass)."""
    by = list(by)
    extra = extra or {}
    pts = _point_columns(_scanned(scored, by, score, label, broadcast_offsets, extra, weight))
    P, N = F.col("tot_c0"), F.col("tot_c1")
    auc_term = F.col("c0") * (F.col("cum_c1") - F.col("c1") / 2.0)
    ap_term = F.col("c0") * F.try_divide(F.col("tps").cast("double"), F.col("tps") + F.col("fps"))
    best = F.min_by(F.struct(F.col("score"), F.col("cum_c0"), F.col("cum_c1"), F.col("obj")),
                    F.when(F.col("kept"), F.struct(F.col("obj"), -F.col("score"))))
    agg = pts.groupBy(*by).agg(
        F.first(P).alias("n_label0"), F.first(N).alias("n_label1"),
        F.sum(auc_term).alias("_auc_num"), F.sum(ap_term).alias("_ap_num"),
        best.alias("_best"),
        *_quantile_aggs("c1", "cum_c1", "tot_c1", 0.5, "median_pos"),
        *_quantile_aggs("c0", "cum_c0", "tot_c0", 0.5, "median_neg"),
        *[F.sum(name).alias(name) for name in extra])
    two = (F.col("n_label0") > 0) & (F.col("n_label1") > 0)
    use_inf = F.col("_best.obj") >= 1.0
    return agg.select(
        *by, "n_label0", "n_label1",
        F.when(two, F.col("_auc_num") / (F.col("n_label0") * F.col("n_label1"))).alias("auc"),
        F.when(two, F.col("_ap_num") / F.col("n_label0")).alias("aupr"),
        F.when(two, F.when(use_inf, F.lit(INF)).otherwise(F.col("_best.score"))).alias("optimal_thr"),
        F.when(two, F.when(use_inf, F.col("n_label0")).otherwise(F.col("_best.cum_c0"))).alias("cut_le_label0"),
        F.when(two, F.when(use_inf, F.col("n_label1")).otherwise(F.col("_best.cum_c1"))).alias("cut_le_label1"),
        _interp("median_pos"), _interp("median_neg"), *list(extra))


# ----------------------------------------------------------------- single metrics
def roc_auc(scored, by=("se",), score="score", label="label") -> DataFrame:
    return curve_summary(scored, by, score, label).select(*by, "auc")


def average_precision(scored, by=("se",), score="score", label="label") -> DataFrame:
    return curve_summary(scored, by, score, label).select(*by, "aupr")


def optimal_cutoff(scored, by=("se",), score="score", label="label") -> DataFrame:
    return curve_summary(scored, by, score, label).select(*by, "optimal_thr")


def se_medians(scored, by=("se",), score="score", label="label") -> DataFrame:
    return curve_summary(scored, by, score, label).select(*by, "median_pos", "median_neg")


def roc_points(scored: DataFrame, by: Sequence[str] = ("se",), score: str = "score",
               label: str = "label") -> DataFrame:
    """Kept ROC points per group plus the ``(0, 0, +inf)`` origin."""
    by = list(by)
    pts = _point_columns(_scanned(scored, by, score, label)).where(F.col("kept"))
    curve = pts.select(*by, F.col("score").alias("threshold"), "fpr", "tpr")
    origin = (pts.select(*by).distinct()
              .select(*by, F.lit(INF).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return curve.unionByName(origin)


def confusion_counts(df: DataFrame, pred: str, label: str = "label", by: Sequence[str] = ("se",),
                     weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp with interaction (label 1) as the positive class."""
    l, p = F.col(label), F.col(pred)
    cnt = lambda cond: _cnt(cond, weight)
    return df.groupBy(*by).agg(cnt((l == 0) & (p == 0)).alias("tn"), cnt((l == 0) & (p == 1)).alias("fp"),
                               cnt((l == 1) & (p == 0)).alias("fn"), cnt((l == 1) & (p == 1)).alias("tp"))


def sn_sp_pr(conf: DataFrame) -> DataFrame:
    return conf.select("*", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sn"),
                       safe_ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("sp"),
                       safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("pr"))


def midpoint_threshold(scored: DataFrame, by=("se",), score="score", label="label") -> DataFrame:
    """Midpoint of the class medians and its confusion counts (calibration rule)."""
    by = list(by)
    med = curve_summary(scored, by, score, label).select(
        *by, ((F.col("median_pos") + F.col("median_neg")) / 2).alias("midpoint_thr"))
    med = bounded_broadcast(med)  # one row per group, against all scored rows
    rows = scored.join(med, by).withColumn("_pred", calibration_label(score, "midpoint_thr"))
    return med.join(confusion_counts(rows, "_pred", label, by), by)


# ------------------------------------------------------------ composite tables
def class_profile(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Per group: number of labels seen and number of missing scores."""
    return df.groupBy(*by).agg(
        F.countDistinct(label).alias("n_classes"),
        F.sum(F.when(F.col(score).isNull(), 1).otherwise(0)).cast("long").alias("n_missing"),
        F.count(F.lit(1)).alias("n_rows"))


def calibrate_se(scored: DataFrame, by: Sequence[str] = ("se",), score: str = "score",
                 label: str = "label") -> DataFrame:
    """Calibration table per group: medians, optimal cut-off and the metrics of
    the rule ``score > thr -> 0 else 1`` (missing scores count as 1).

    Groups with a single class keep their row with NULL curve metrics.
    """
    by = list(by)
    s, l = F.col(score), F.col(label)
    t = curve_summary(scored, by, score, label,
                      extra={"_null0": s.isNull() & (l == 0), "_null1": s.isNull() & (l == 1)})
    tp = F.col("cut_le_label1") + F.col("_null1")
    fp = F.col("cut_le_label0") + F.col("_null0")
    fn = F.col("n_label1") - F.col("cut_le_label1")
    tn = F.col("n_label0") - F.col("cut_le_label0")
    return t.select(*by, "median_pos", "median_neg", "optimal_thr",
                    safe_ratio(tp, tp + fn).alias("sn"), safe_ratio(tn, tn + fp).alias("sp"),
                    safe_ratio(tp, tp + fp).alias("pr"), "auc", "aupr")


def test_performance(df: DataFrame, pred: str = "predicted_label", score: str = "predicted_score",
                     label: str = "label", by: Sequence[str] = ("se",),
                     with_excluded: bool = False, weight: str | None = None):
    """SN, SP, PR, AUC, AUPR per group on given predicted labels (binary labels).

    Groups with one class only are skipped; groups with a missing score are
    skipped too (the reference swallows the error) and, with
    ``with_excluded=True``, returned in a second DataFrame with the reason.
    Confusion counts, class counts and missing scores are counted in the same
    histogram pass as the curves.
    """
    by = list(by)
    s, l, p = F.col(score), F.col(label), F.col(pred)
    extra = {"_l0": l == 0, "_l1": l == 1, "_miss": s.isNull(), "_rows": F.lit(True),
             "tn": (l == 0) & (p == 0), "fp": (l == 0) & (p == 1),
             "fn": (l == 1) & (p == 0), "tp": (l == 1) & (p == 1)}
    cs = curve_summary(df, by, score, label, extra=extra, weight=weight)
    n_classes = (F.col("_l0") > 0).cast("int") + (F.col("_l1") > 0).cast("int")
    ok = (n_classes > 1) & (F.col("_miss") == 0)
    perf = sn_sp_pr(cs.where(ok)).select(*by, "sn", "sp", "pr", "auc", "aupr")
    if not with_excluded:
        return perf
    excluded = cs.where(~ok).select(
        *by, F.when(n_classes <= 1, F.lit("single class")).otherwise(F.lit("missing score")).alias("reason"),
        F.col("_rows").alias("n_rows"), F.col("_miss").alias("n_missing"))
    return perf, excluded


def merged_performance(merged: DataFrame, by: Sequence[str] = ("se",), with_excluded: bool = False):
    """Test performance of the merged table; a ``n_copies`` column (from the
    merge) weights each row."""
    weight = "n_copies" if "n_copies" in merged.columns else None
    return test_performance(merged, pred="final_predicted_label", score="mean_predicted_score",
                            by=by, with_excluded=with_excluded, weight=weight)


PERF_METRICS = ("sn", "sp", "pr", "auc", "aupr")


def perf_describe(perf: DataFrame, metrics: Sequence[str] = PERF_METRICS) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear), max of each metric.

    The input has one row per side effect, so exact percentiles are bounded.
    """
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = perf.selectExpr(f"stack({len(metrics)}, {stack}) as (metric, value)")
    v = F.col("value")
    return long.groupBy("metric").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.5).alias("q50"),
        F.percentile(v, 0.75).alias("q75"), F.max(v).alias("max"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, computed from a value
    histogram with a distributed ordered scan (no group in one task)."""
    by = list(by)
    hist = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("score"))
            .agg(F.count(F.lit(1)).alias("c")))
    s = ordered_scan(hist, by, ["score"], sums=["c"])
    aggs = []
    for p, nm in zip(probs, names):
        aggs += _quantile_aggs("c", "cum_c", "tot_c", p, nm)
    q = s.groupBy(*by).agg(F.first("tot_c").alias("n"), *aggs)
    return q.select(*by, "n", *[_interp(nm) for nm in names])


def score_box_stats(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Box-plot numbers of the score per label: quartiles and whisker ends
    (furthest datum within 1.5 IQR of the box)."""
    q = exact_quantiles(scored, [label], score, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    fence = q.select(label, "n", "q1", "median", "q3",
                     (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
                     (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    s = F.col(score)
    w = scored.join(bounded_broadcast(fence), label).groupBy(label).agg(
        F.min(F.when(s >= F.col("_lo"), s)).alias("whisker_low"),
        F.max(F.when(s <= F.col("_hi"), s)).alias("whisker_high"),
        F.sum(F.when((s < F.col("_lo")) | (s > F.col("_hi")), 1).otherwise(0)).cast("long").alias("n_outliers"))
    return fence.drop("_lo", "_hi").join(w, label)


def raw_accuracy(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The pair model's monitoring accuracy: distance rounded at 0.5 vs label."""
    return df.agg(F.avg(((F.col(score) > 0.5) == (F.col(label) == 1)).cast("double")).alias("raw_accuracy"))


def margin_loss(df: DataFrame, score: str = "score", label: str = "label", margin: float = 1.0) -> DataFrame:
    """Sum of ``max(0, y*s - |1-y|*s + margin)``: positives add ``s + margin``,
    negatives ``max(0, margin - s)``."""
    y = F.col(label).cast("double")
    s = F.col(score)
    term = F.greatest(F.lit(0.0), y * s - F.abs(1 - y) * s + margin)
    return df.agg(F.sum(term).alias("loss"), F.count(F.lit(1)).alias("n"))
