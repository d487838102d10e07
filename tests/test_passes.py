"""Work that grows with the rows is done once: one reading of the table, no vectors through a shuffle, bounded Arrow batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.operators import analysis as A
from dyadic.operators import neighbours as N
from dyadic.operators import reshape as R
from dyadic.operators import sampling as S
from dyadic.operators.joins import profile_lookup
from dyadic.operators.scoring import PairModel, pair_embed, score_observations
from dyadic.plans.calibrate import calibrate

ROWS = 40
COLS = "row_id long, drug1 long, drug2 long, se int, label int, score double"


def _counted(spark):
    """A table of ``ROWS`` rows and the number of its rows that were produced so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            i = pdf["id"].to_numpy()
            yield pd.DataFrame({"row_id": i, "drug1": i % 7, "drug2": 10 + i % 5, "se": (i % 3).astype(np.int32),
                                "label": (i % 2).astype(np.int32), "score": i / ROWS})

    return spark.range(0, ROWS, 1, 2).mapInPandas(run, COLS), seen


def _profile(spark):
    return spark.createDataFrame([(d, [0.5 * d, 1.0, -0.25 * d, 2.0]) for d in range(20)], "drug_id long, vec array<double>")


@pytest.mark.parametrize("job", [
    lambda df: R.mirror_pairs(df),
    lambda df: S.train_test_split(df, 0.8),
    lambda df: S.tail_validation_split(df, 0.1),
    lambda df: S.repeated_holdout(df, 0.3, 2),
    lambda df: S.pair_holdout(R.mirror_pairs(df), 0.3),
    lambda df: A.se_lists(df),
    lambda df: calibrate(df, samples=2, frac=0.3).sizes,
    lambda df: calibrate(df, samples=2, frac=0.3).thresholds,
    lambda df: score_observations(df, _profile(df.sparkSession), model=PairModel.formula(4, 2, [0, 1, 2])),
])
def test_the_table_is_read_once(spark, job):
    df, seen = _counted(spark)
    assert job(df).collect()
    assert seen.value == ROWS


def test_no_vector_is_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(1, 2), (2, 99), (None, 1)], "drug1 long, drug2 long")
        got = profile_lookup(pairs, _profile(spark))
        assert "Exchange hashpartitioning" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
        out = {(r["drug1"], r["drug2"]): (r["vec1"], r["vec2"]) for r in got.collect()}
        assert out == {(1, 2): ([0.5, 1.0, -0.25, 2.0], [1.0, 1.0, -0.5, 2.0]), (2, 99): ([1.0, 1.0, -0.5, 2.0], None),
                       (None, 1): (None, [0.5, 1.0, -0.25, 2.0])}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_doubles_that_are_no_floats_keep_their_digits(spark):
    vec = [0.1, None, float("nan"), 1e300]
    profile = spark.createDataFrame([(1, vec), (2, [0.5, 0.5, 0.5, 0.5])], "drug_id long, vec array<double>")
    got = profile_lookup(spark.createDataFrame([(1, 2)], "drug1 long, drug2 long"), profile).first()["vec1"]
    assert got[:2] == [0.1, None] and np.isnan(got[2]) and got[3] == 1e300


def test_sums_in_place_of_arrays(spark):
    model = PairModel.formula(4, 2, [0])
    pv = profile_lookup(spark.createDataFrame([(1, 2), (3, 4), (5, 99)], "drug1 long, drug2 long"), _profile(spark))
    arrays = {r["drug1"]: r for r in pair_embed(pv, model).collect()}
    sums = pair_embed(pv, model, ("s1", "h1"), sums=True)
    assert sums.columns == ["drug1", "drug2", "s1_sum", "s1_wsum", "h1_sum", "h1_wsum"]
    for r in sums.collect():
        for c in ("s1", "h1"):
            x = arrays[r["drug1"]][c]
            if x is None:
                assert r[f"{c}_sum"] is None and r[f"{c}_wsum"] is None
            else:
                assert np.allclose([r[f"{c}_sum"], r[f"{c}_wsum"]], [sum(x), sum(v * (i + 1) for i, v in enumerate(x))], atol=1e-12)


def test_rows_sent_to_rings_leave_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(N, "SENT_BYTES", 8 * 4 * 6 * 3)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pdf = pd.DataFrame({"id": np.arange(20), "u": [r.tobytes() for r in x]})
    cell, every = np.array([0, 0, 1, 1, 2, 2]), np.full(6, np.pi)
    frames = list(N.sent_rows(pdf, x[:3], cell, np.zeros(6), every, every))
    assert max(len(b) for f in frames for b in [b"".join(f["v"])]) <= N.SENT_BYTES
    assert sorted((o, b) for f in frames for o, b in zip(f["other"], f["b"])) == [(o, b) for o in range(20) for b in range(6)]


@pytest.mark.parametrize("lane_bytes", [1, 40, 1 << 20])
def test_lanes_do_not_change_the_ranking(spark, monkeypatch, lane_bytes):
    from dyadic.operators import heads as H
    from dyadic.operators.scoring import _model_block, screen_ranked
    monkeypatch.setattr(H, "LANE_BYTES", lane_bytes)
    model = PairModel.formula(4, 2, list(range(9)))
    pv = profile_lookup(spark.createDataFrame([(1, 2), (3, 4), (5, 99), (6, 7)], "drug1 long, drug2 long"), _profile(spark))
    thr = [3.0 + 0.2 * s for s in range(9)]
    heads = H.formula_heads(spark.createDataFrame([(s,) for s in range(9)], "se int"), 2, block_bytes=100)
    got = H.screen_by_blocks(pv, _model_block(model, 0, 0), heads,
                             spark.createDataFrame(list(enumerate(thr)), "se int, optimal_thr double"), 3)
    rows = lambda d: sorted((r["drug1"], r["drug2"], r["rank"], r["se"], round(r["gap"], 9), r["total_predicted_reactions"])
                            for r in d.collect())
    want = rows(screen_ranked(pv, np.array(thr), 3, model=model))
    assert want and rows(got) == want


def test_a_drug_is_clustered_once_and_labels_each_of_its_pairs(spark, monkeypatch):
    from dyadic.plans import signature as G
    fitted, whole = [], A.profile_clusters

    def counted(df, *args, **options):
        fitted.append({r["drug1"]: r["weight"] for r in df.collect()})
        return whole(df, *args, **options)

    monkeypatch.setattr(G, "profile_clusters", counted)
    pairs = spark.createDataFrame([(i, i % 4, 4 + i % 5, i % 3, 1) for i in range(40)] + [(90, 0, 0, 1, 1), (91, 1, 2, 0, 0), (92, 50, 1, 0, 1)],
                                  "row_id long, drug1 long, drug2 long, se int, label int")
    flat, left, right = [1.0] * 4, [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.5]
    vecs = [(d, flat if d == 4 else left if d % 2 else right) for d in range(9)] + [(3, right), (60, left), (None, left)]
    sig = G.drug_signature(pairs, spark.createDataFrame(vecs, "drug_id long, vec array<double>"), 3, n_clusters=2)
    got = sig.clusters().collect()
    keys = [tuple(r) for r in sig.vectors.select("focus", "drug1", "drug2").collect()]
    assert sorted((r["focus"], r["drug1"], r["drug2"]) for r in got) == sorted(keys)
    (weights,) = fitted
    n = {d: sum(k[1] == d for k in set(keys)) for d in range(9)}
    n[0] += 1  # a drug paired with itself stands on both sides
    assert weights == n
    of = {}
    for r in got:
        of.setdefault(r["drug1"], set()).add(r["cluster"])
    assert of[4] == of[50] == {2}  # no direction; no profile
    assert of[3] == {0, 1} and of[0] == of[2] == of[6] == of[8] != of[1] == of[5] == of[7] and len(of[1]) == 1


def test_observations_are_shuffled_once(spark, monkeypatch):
    """Rows are dealt by pair and leave with their scores; lists of a much observed pair are cut."""
    from dyadic.operators import scoring
    monkeypatch.setattr(scoring, "LIST_ROWS", 7)
    rows = [(i, 1, 2, i % 3, f"t{i}") for i in range(100)] + [(200, 3, 4, None, "x"), (201, None, 1, 0, None), (202, 5, 99, 1, "y"), (203, 2, 1, 8, "z")]
    df = spark.createDataFrame(rows, "row_id long, drug1 long, drug2 long, se int, note string").repartition(3)
    got = score_observations(df, _profile(spark), model=PairModel.formula(4, 2, [0, 1, 2]))
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    out = {r["row_id"]: r for r in got.collect()}
    assert got.columns == [*df.columns, "score_fwd", "score_rev"]
    assert [tuple(out[r[0]])[:5] for r in rows] == rows
    assert all(out[i]["score_fwd"] is None and out[i]["score_rev"] is None for i in (200, 201, 202, 203))
    for s in range(3):
        assert len({(round(out[i]["score_fwd"], 9), round(out[i]["score_rev"], 9)) for i in range(100) if i % 3 == s}) == 1
