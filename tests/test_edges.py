"""Hand-made edge tables (FIXTURES.md section 3) and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.operators import metrics as M
from dyadic.operators import reshape as R
from dyadic.operators import sampling as S
from dyadic.operators.analysis import top_positions
from dyadic.operators.joins import se_name_lookup
from dyadic.operators.scan import ordered_scan
from dyadic.operators.thresholds import apply_threshold, merge_both_pairs, threshold_mean
from dyadic.functions.scalar import calibration_label, capitalize, predicted_label


def _scored(spark, rows):
    return spark.createDataFrame(rows, "se int, score double, label int")


def _one(df):
    return df.collect()[0].asDict()


def test_all_tied(spark):
    df = _scored(spark, [(0, 0.5, 0), (0, 0.5, 1), (0, 0.5, 0), (0, 0.5, 1)])
    r = _one(M.curve_summary(df))
    assert r["auc"] == 0.5
    assert math.isinf(r["optimal_thr"])
    cal = _one(M.calibrate_se(df))
    assert cal["sn"] == 1.0 and cal["sp"] == 0.0       # everything labelled 1 at +inf


def test_perfect_separation(spark):
    df = _scored(spark, [(0, 0.1, 1), (0, 0.2, 1), (0, 0.8, 0), (0, 0.9, 0)])
    r = _one(M.curve_summary(df))
    assert r["auc"] == 1.0 and r["aupr"] == 1.0
    assert r["optimal_thr"] == 0.8                     # lowest label-0 score
    cal = _one(M.calibrate_se(df))
    assert cal["sn"] == 1.0 and cal["sp"] == 0.5       # non-strict rule labels 0.8 as 1


def test_auc_complement_and_monotone_invariance(spark):
    rng = np.random.default_rng(1)
    rows = [(0, float(s), int(l)) for s, l in zip(rng.random(200).round(2), rng.integers(0, 2, 200))]
    df = _scored(spark, rows)
    a = _one(M.curve_summary(df))["auc"]
    flipped = df.withColumn("label", 1 - F.col("label"))
    b = _one(M.curve_summary(flipped))["auc"]
    assert abs(a + b - 1) < 1e-12
    mono = df.withColumn("score", F.exp(F.col("score") * 3))
    m = _one(M.curve_summary(mono))
    assert abs(m["auc"] - a) < 1e-12
    assert abs(m["aupr"] - _one(M.curve_summary(df))["aupr"]) < 1e-12


def test_single_class_excluded(spark):
    df = spark.createDataFrame([(0, 0.1, 0, 0), (0, 0.2, 0, 1), (1, 0.3, 1, 1), (1, 0.4, 0, 0)],
                               "se int, predicted_score double, label int, predicted_label int")
    perf, excl = M.test_performance(df, with_excluded=True)
    assert [r["se"] for r in perf.collect()] == [1]
    assert [(r["se"], r["reason"]) for r in excl.collect()] == [(0, "single class")]
    cal = M.calibrate_se(df.withColumnRenamed("predicted_score", "score"))
    row0 = [r for r in cal.collect() if r["se"] == 0][0]
    assert row0["auc"] is None and row0["optimal_thr"] is None


def test_missing_score_reported(spark):
    df = spark.createDataFrame([(0, None, 0, 0), (0, 0.2, 1, 1), (0, 0.3, 0, 0)],
                               "se int, predicted_score double, label int, predicted_label int")
    perf, excl = M.test_performance(df, with_excluded=True)
    assert perf.count() == 0
    assert excl.collect()[0]["reason"] == "missing score"


def test_score_equals_threshold(spark):
    df = spark.createDataFrame([(0.4, 0.4)], "s double, t double")
    r = df.select(predicted_label("s", "t").alias("c2"), calibration_label("s", "t").alias("a9")).collect()[0]
    assert r["c2"] == 0 and r["a9"] == 1


def test_missing_profile_label_zero(spark):
    df = spark.createDataFrame([(1, 2, 0, 0, None)], "drug1 long, drug2 long, se int, label int, predicted_score double")
    thr = spark.createDataFrame([(0, 0.5)], "se int, optimal_thr double")
    r = apply_threshold(df, thr).collect()[0]
    assert r["predicted_label"] == 0 and r["gap"] is None


def test_duplicate_pair_multiplies(spark):
    rows = [(1, 2, 0, 1, 0.3), (1, 2, 0, 1, 0.35)]
    ori = spark.createDataFrame(rows, "drug1 long, drug2 long, se int, label int, predicted_score double")
    swi = R.swap_pair(ori)
    thr = spark.createDataFrame([(0, 0.5)], "se int, optimal_thr double")
    m = merge_both_pairs(apply_threshold(ori, thr), apply_threshold(swi, thr), thr)
    rows = m.collect()
    # 2 copies x 2 copies: the multiset of the row-level join (4 rows), carried as counts
    assert sum(r["n_copies"] for r in rows) == 4
    assert len(rows) == 4      # the two copies differ in score, so 2 x 2 distinct combinations
    same = spark.createDataFrame([(1, 2, 0, 1, 0.3)] * 3, "drug1 long, drug2 long, se int, label int, predicted_score double")
    m2 = merge_both_pairs(apply_threshold(same, thr), apply_threshold(R.swap_pair(same), thr), thr).collect()
    assert len(m2) == 1 and m2[0]["n_copies"] == 9


def test_self_pair_removed_by_remainder(spark):
    df = spark.createDataFrame([(0, 5, 5, 1, 1), (1, 1, 2, 1, 0)], "row_id long, drug1 long, drug2 long, se int, label int")
    mirrored = R.mirror_pairs(df)
    hold = mirrored.where("false")
    rest = R.holdout_remainder(mirrored, hold).collect()
    assert all(r["drug1"] != r["drug2"] for r in rest) and len(rest) == 2


@pytest.mark.parametrize("n", [1, 2, 6, 7, 8])
def test_threshold_samples(spark, n):
    rows = [(3, k, 0.1 * (k + 1)) for k in range(n)] + [(4, 0, 7.0)]      # se 4 lacks all but the first sample
    df = spark.createDataFrame(rows, "se int, sample_no int, thr double")
    mean = lambda mode: {r["se"]: r["optimal_thr"] for r in threshold_mean(df, mode).collect()}
    last = [0.1 * (k + 1) for k in range(n)][-5:]
    got = mean("last5")
    assert abs(got[3] - sum(last) / len(last)) < 1e-12 and got[4] == (7.0 if n <= 5 else None)
    if n < 7:
        with pytest.raises(ValueError):
            threshold_mean(df, "compat")
    else:
        vals = [0.1 * (k + 1) for k in range(n - 7, n - 2)]
        assert abs(mean("compat")[3] - sum(vals) / 5) < 1e-12 and mean("compat")[4] == (7.0 if n == 7 else None)


def test_threshold_width_is_that_of_the_whole_table(spark):
    rows = [(1, k, float(k)) for k in range(8)] + [(2, k, float(k)) for k in range(7)]
    df = spark.createDataFrame(rows, "se int, sample_no int, thr double")
    got = {r["se"]: r["optimal_thr"] for r in threshold_mean(df, "compat").collect()}
    assert got == {1: 3.0, 2: 3.0}


def test_json_text_is_escaped(spark):
    import json
    from dyadic.plans.screen import responses
    names = ['plain', 'a "quoted" \\ name', 'tab\there', 'ünï']
    res = spark.createDataFrame([(1, 2, i + 1, i, n, 0.25, 0.5, "High", 4) for i, n in enumerate(names)],
                                "drug1 long, drug2 long, rank int, se int, name string, confidence_gap double, "
                                "probability_score double, severity string, total_predicted_reactions long")
    valid = spark.createDataFrame([(7, 1, 2)], "request_id long, drug1 long, drug2 long")
    doc = json.loads(responses(valid, res).first()["response_json"])
    assert [x["name"] for x in doc["top_results"]] == names
    from dyadic.sources.sinks import drug_record
    drugs = spark.createDataFrame(list(enumerate(names)), "drug_id long, name string")
    assert [json.loads(r[0])["name"] for r in drugs.select(drug_record()).collect()] == names


def test_self_pair_is_listed_on_both_sides(spark):
    from dyadic.operators.analysis import drug_pairs_both_sides, drug_positive_pairs, se_lists
    df = spark.createDataFrame([(0, 5, 5, 1, 1), (1, 5, 6, 2, 1)], "row_id long, drug1 long, drug2 long, se int, label int")
    for out in (drug_positive_pairs(df), drug_pairs_both_sides(df), se_lists(df)):
        assert sorted(r["focus"] for r in out.collect()) == [5, 5, 5, 6]


def test_nan_score_counts_as_missing_in_calibration(spark):
    row = spark.createDataFrame([(float("nan"), 0.5)], "s double, t double").select(
        calibration_label("s", "t").alias("c"), predicted_label("s", "t").alias("p")).first()
    assert (row["c"], row["p"]) == (1, 0)


def test_duplicated_profile_id_is_refused(spark):
    from dyadic.operators.joins import profile_lookup
    prof = spark.createDataFrame([(1, [0.0]), (1, [1.0])], "drug_id long, vec array<double>")
    with pytest.raises(ValueError):
        profile_lookup(spark.createDataFrame([(1, 1)], "drug1 long, drug2 long"), prof)


def test_small_strata_sizes(spark):
    sizes = [4, 5, 14, 15, 25, 35]
    rows, rid = [], 0
    for se, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rid, 0, 0, se, 1))
            rid += 1
    df = spark.createDataFrame(rows, "row_id long, drug1 long, drug2 long, se int, label int")
    got = dict(S.stratified_holdout(df, 0.1).groupBy("se").count().collect())
    assert [got.get(i, 0) for i in range(len(sizes))] == [0, 0, 1, 2, 2, 4]


def test_unknown_se_name(spark):
    ses = spark.createDataFrame([(0,), (7,)], "se int")
    names = spark.createDataFrame([(0, "HEADACHE")], "se int, name string")
    out = dict(se_name_lookup(ses, names).select("se", capitalize("name").alias("n")).collect())
    assert out == {0: "Headache", 7: "Unknown se #7"}


def test_topk_ties_prefer_lower_position(spark):
    df = spark.createDataFrame([(1, [0.5, -0.9, 0.9, 0.1])], "id int, vec array<double>")
    t = top_positions(df, "vec", 2).orderBy("rank").collect()
    assert [r["pos"] for r in t] == [1, 2]


def test_negative_se_in_list(spark):
    from dyadic.operators.analysis import se_lists
    df = spark.createDataFrame([(0, 1, 2, 3, 1), (1, 1, 2, 4, 0)], "row_id long, drug1 long, drug2 long, se int, label int")
    lists = {r["focus"]: r["se_list"] for r in se_lists(df).collect()}
    assert lists == {1: [3, 4], 2: [3, 4]}


def test_ordered_scan_hot_group_equals_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("g"),
        F.col("id").alias("k"), (F.col("id") % 5).alias("m"))
    res = ordered_scan(df, ["g"], ["k"], sums=["m"], lags=["m"], slices=6)
    w = Window.partitionBy("g").orderBy("k")
    ref = df.select("*", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_m"),
                    F.sum("m").over(Window.partitionBy("g")).alias("tot_m"), F.lag("m").over(w).alias("prev_m"))
    assert res.exceptAll(ref).count() == 0 and ref.exceptAll(res).count() == 0


def test_edge_none_flagged(spark):
    from dyadic.plans.screen import rank_flagged
    sc = spark.createDataFrame([(1, 2, 0, 0.9, 0.9, 0.9, 0.5)],
                               "drug1 long, drug2 long, se int, predicted_score_x double, predicted_score_y double, "
                               "mean_predicted_score double, optimal_thr double")
    names = spark.createDataFrame([(0, "X")], "se int, name string")
    assert rank_flagged(sc, names).count() == 0


def test_request_rejects(spark):
    from dyadic.plans.screen import valid_requests
    from dyadic.sources.readers import requests_from_rows
    req = requests_from_rows(spark, [(1, "5", "7"), (2, "0", "7"), (3, None, "7"), (4, "abc", "7"), (5, "", "7"),
                                     (6, "9", "9")])
    ok, rej = valid_requests(req, distinct_guard=True)
    assert sorted(r["request_id"] for r in ok.collect()) == [1]
    assert dict((r["request_id"], r["reason"]) for r in rej.collect()) == {
        2: "missing drug id", 3: "missing drug id", 4: "invalid drug id", 5: "missing drug id", 6: "same drug twice"}


def test_ordered_scan_null_group_key(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 3).alias("g"),
                                     F.col("id").alias("k"), (F.col("id") % 5).alias("m"))
    res = ordered_scan(df, ["g"], ["k"], sums=["m"], lags=["m"], slices=5)
    w = Window.partitionBy("g").orderBy("k")
    ref = df.select("*", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_m"),
                    F.sum("m").over(Window.partitionBy("g")).alias("tot_m"), F.lag("m").over(w).alias("prev_m"))
    assert res.count() == 3000
    assert res.exceptAll(ref).count() == 0 and ref.exceptAll(res).count() == 0


def test_hot_group_spans_many_slices(spark):
    """A group holding a third of all rows is spread over several range slices
    (and so several tasks) by the ordered scan."""
    from dyadic.operators import scan as SC
    df = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("int").alias("g"),
        F.col("id").alias("k"), F.lit(1).alias("one"))
    ranged = df.repartitionByRange(8, "g", "k").withColumn("_slice", F.spark_partition_id())
    hot_slices = ranged.where("g = 0").select("_slice").distinct().count()
    assert hot_slices >= 3
    res = SC.ordered_scan(df, ["g"], ["k"], sums=["one"], slices=8)
    top = res.where("g = 0").agg(F.max("cum_one").alias("m"), F.max("tot_one").alias("t")).collect()[0]
    assert top["m"] == top["t"] == 20000
