"""Properties of the metrics and draws against brute-force NumPy versions."""

import numpy as np
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dyadic.operators import metrics as M
from dyadic.operators import reshape as R
from dyadic.operators import sampling as S


def roc_np(y, s):
    """ROC with the reference library's rules: distinct thresholds descending,
    collinear points dropped, (0, 0, +inf) prepended."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    if len(tps) > 2:
        keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
        tps, fps, thr = tps[keep], fps[keep], thr[keep]
    tps, fps, thr = np.r_[0, tps], np.r_[0, fps], np.r_[np.inf, thr]
    return fps / fps[-1], tps / tps[-1], thr


def auc_np(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def ap_np(y, s):
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    prec, rec = tps / (tps + fps), tps / tps[-1]
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


def cutoff_np(y, s):
    fpr, tpr, thr = roc_np(y, s)
    obj = np.abs(tpr + fpr - 1)
    best = obj.min()
    return thr[obj == best].max()


data = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=4, max_size=60).filter(
    lambda rows: len({l for _, l in rows}) == 2)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=data)
def test_curve_metrics_match_bruteforce(spark, rows):
    df = spark.createDataFrame([(0, float(v) / 4, l) for v, l in rows], "se int, score double, label int")
    got = M.curve_summary(df).collect()[0]
    y = 1 - np.array([l for _, l in rows])           # positive class of the curves is 1 - label
    s = np.array([float(v) / 4 for v, _ in rows])
    assert abs(got["auc"] - auc_np(y, s)) < 1e-12
    assert abs(got["aupr"] - ap_np(y, s)) < 1e-12
    assert got["optimal_thr"] == cutoff_np(y, s)
    assert got["median_pos"] == float(np.median(s[y == 0])) and got["median_neg"] == float(np.median(s[y == 1]))


def test_holdout_sizes_and_partition(spark, sf_dir):
    from dyadic.sources import fixtures as fx
    p = fx.pairs(spark, sf_dir)
    hold = S.stratified_holdout(p, 0.1)
    sizes = p.groupBy("se", "label").count().collect()
    expected = sum(int(round(0.1 * r["count"])) for r in sizes)   # Python round: half to even
    assert hold.count() == expected
    rest = R.holdout_remainder(p, hold, strict=True)
    assert rest.count() + hold.count() == p.count()
    assert rest.join(hold, "row_id").count() == 0


def test_mirror_doubles_and_keeps_pair_set(spark, sf_dir):
    from dyadic.sources import fixtures as fx
    p = fx.pairs(spark, sf_dir)
    m = R.mirror_pairs(p)
    assert m.count() == 2 * p.count()
    key = lambda d: d.select(F.least("drug1", "drug2").alias("a"), F.greatest("drug1", "drug2").alias("b"), "se").distinct()
    assert key(m).exceptAll(key(p)).count() == 0


def test_row_index_is_dense_over_many_partitions(spark, tmp_path):
    from dyadic.sources.readers import with_row_index
    path = str(tmp_path / "rows")
    spark.range(0, 5000, numPartitions=7).select((F.col("id") * 3).alias("v")).write.parquet(path)
    idx = with_row_index(spark.read.parquet(path)).collect()
    assert sorted(r["row_id"] for r in idx) == list(range(5000))
    assert all(r["v"] == 3 * r["row_id"] for r in idx)


def test_holdout_sizes_and_ranks_with_the_default_key(spark):
    """Each stratum gives its smallest keys, exactly as many as its rounded share, for every sample."""
    from dyadic.operators import sampling as S
    df = spark.range(0, 30000).select(F.col("id").alias("row_id"), (F.col("id") % 97 % 7).cast("int").alias("se"),
                                      (F.col("id") % 2).cast("int").alias("label"), F.lit("x").alias("wide")).union(
        spark.range(30000, 30015).select("id", F.lit(99), F.lit(0), F.lit("y")))
    got = S.repeated_holdout(df, 0.1, 2)
    keyed = df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("sample_no"))
    keyed = keyed.withColumn("_k", F.xxhash64("row_id", "sample_no"))
    from pyspark.sql import Window
    w = Window.partitionBy("sample_no", "se", "label")
    want = (keyed.withColumn("rn", F.row_number().over(w.orderBy("_k", "row_id")))
            .withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("rn") <= F.bround(F.col("n") * 0.1, 0))
            .select("sample_no", *df.columns))
    assert got.count() == want.count() > 5000 and got.exceptAll(want).count() == 0


def test_global_splits_are_exact(spark):
    from dyadic.operators import sampling as S
    df = spark.range(0, 20011).select((F.col("id") * 3).alias("row_id"))
    split = S.train_test_split(df, 0.8)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 16009, "test": 4002}
    tail = sorted(r["row_id"] for r in S.tail_validation_split(df, 0.1).collect())
    assert tail == [3 * k for k in range(18009, 20011)]
    one = spark.createDataFrame([(5,)], "row_id long")
    assert S.tail_validation_split(one, 0.1).count() == 1 and S.train_test_split(one, 0.1).first()["split"] == "test" and S.train_test_split(one).first()["split"] == "train"
    assert S.train_test_split(df.limit(0)).count() == 0


def test_evaluate_swap_invariance_and_totals(spark, sf_dir):
    """Swapping the two inputs of the evaluation keeps mean, label and gap;
    confusion counts add up to the rows; gaps are non-negative."""
    from dyadic.plans.evaluate import evaluate, orientations
    from dyadic.sources import fixtures as fx
    s = fx.scored(spark, sf_dir)
    thr = fx.threshold(spark, sf_dir)
    ori, swi = orientations(s)
    a = evaluate(ori, swi, thr).merged
    b = evaluate(swi, ori, thr).merged     # the swapped table as the "original"
    cols = ["se", "label", "mean_predicted_score", "final_predicted_label", "gap"]
    ka = a.select(F.least("drug1", "drug2").alias("x"), F.greatest("drug1", "drug2").alias("y"), *cols)
    kb = b.select(F.least("drug1", "drug2").alias("x"), F.greatest("drug1", "drug2").alias("y"), *cols)
    assert ka.exceptAll(kb).count() == 0 and kb.exceptAll(ka).count() == 0
    assert a.where(F.col("gap") < 0).count() == 0
    conf = M.confusion_counts(a, "final_predicted_label", weight="n_copies")
    tot = conf.select(F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).collect()[0][0]
    assert tot == a.select(F.sum("n_copies")).collect()[0][0]


def test_screen_ranks_contiguous(spark, sf_dir):
    import __spark_entry__ as e
    res = e.queries()["screen"](spark, sf_dir)
    bad = (res.groupBy("drug1", "drug2")
           .agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"), F.min("rank").alias("lo"),
                F.max("total_predicted_reactions").alias("t"))
           .where((F.col("n") != F.col("m")) | (F.col("lo") != 1) | (F.col("n") > 30) | (F.col("t") < F.col("n"))))
    assert res.count() > 0 and bad.count() == 0


def test_pair_model_weights_roundtrip(spark, tmp_path):
    from dyadic.operators.scoring import PairModel, load_pair_model, save_pair_model
    m = PairModel.random(11, 6, 3, [0, 4, 7])
    save_pair_model(spark, m, str(tmp_path / "w"))
    back = load_pair_model(spark, str(tmp_path / "w"))
    for k, v in m.__dict__.items():
        if isinstance(v, np.ndarray):
            assert np.allclose(getattr(back, k), v)
    x = np.random.default_rng(0).standard_normal((5, 6))
    assert np.allclose(m.embed(x, x[::-1])[0], back.embed(x, x[::-1])[0])


def test_correlations_survive_large_offsets(spark):
    from dyadic.operators.analysis import gene_corr_distance, gene_pearson
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 4)) + 1e6
    y = x + rng.standard_normal((400, 4))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)],
                               "vec array<double>, other array<double>").repartition(5)
    want = 1 - np.corrcoef(x.T)
    for r in gene_corr_distance(df).collect():
        assert abs(r["distance"] - want[r["pos_i"], r["pos_j"]]) < 1e-6
    for r in gene_pearson(df, "vec", "other").collect():
        assert abs(r["r"] - np.corrcoef(x[:, r["pos"]], y[:, r["pos"]])[0, 1]) < 1e-6


def test_clusters_keep_rows_without_direction(spark):
    from dyadic.operators.analysis import profile_clusters
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(30)] + [(100, [2.0] * 6), (101, None)]
    got = {r["drug_id"]: r["cluster"] for r in
           profile_clusters(spark.createDataFrame(rows, "drug_id long, vec array<double>"), k=3).collect()}
    assert len(got) == 32 and got[100] == got[101] == 3 and all(got[i] < 3 for i in range(30))
