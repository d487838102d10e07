"""Model kernels: batched Spark output equals a row-at-a-time NumPy pass."""

import numpy as np
from pyspark.sql import functions as F

from dyadic.operators import scoring
from dyadic.operators.scoring import (FeatureModel, PairModel, pair_embed, predict_expression, score_rows_full,
                                      screen_ranked)


def _pairs(spark, n=40, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(i + 1), rng.standard_normal(d).tolist(), rng.standard_normal(d).tolist()) for i in range(n)]
    rows.append((999, 1000, None, rng.standard_normal(d).tolist()))
    return spark.createDataFrame(rows, "drug1 long, drug2 long, vec1 array<double>, vec2 array<double>"), rows


def _bn(x, p):
    return (x - p["mean"]) / np.sqrt(p["var"] + 1e-3) * p["gamma"] + p["beta"]


def _row_forward(m, x1, x2):
    elu = lambda z: np.where(z > 0, z, np.exp(np.minimum(z, 0)) - 1)
    sig = lambda z: 1 / (1 + np.exp(-z))
    h1, h2 = _bn(elu(x1 @ m.W1 + m.b1), m.bn1), _bn(elu(x2 @ m.W1 + m.b1), m.bn1)
    c = np.concatenate([h1, h2])
    s1, s2 = _bn(h1 * sig(c @ m.G1 + m.g1), m.bn_s1), _bn(h2 * sig(c @ m.G2 + m.g2), m.bn_s2)
    e1, e2 = _bn(elu(s1 @ m.V + m.v), m.bn_e), _bn(elu(s2 @ m.V + m.v), m.bn_e)
    return e1, e2


def test_pair_embed_matches_rowwise(spark):
    df, rows = _pairs(spark)
    m = PairModel.random(3, 8, 4, [0, 1, 2])
    out = {(r["drug1"], r["drug2"]): r for r in pair_embed(df, m).collect()}
    for d1, d2, v1, v2 in rows[:-1]:
        e1, e2 = _row_forward(m, np.array(v1), np.array(v2))
        assert np.allclose(out[(d1, d2)]["e1"], e1) and np.allclose(out[(d1, d2)]["e2"], e2)
    assert out[(999, 1000)]["e1"] is None


def _every_score(rows, m):
    """(drug1, se) -> scores of both orientations, row by row."""
    out = {}
    for d1, d2, v1, v2 in rows:
        if v1 is None or v2 is None:
            continue
        e1, e2 = _row_forward(m, np.array(v1), np.array(v2))
        f1, f2 = _row_forward(m, np.array(v2), np.array(v1))
        for k, s in enumerate(m.se_ids):
            H, T, r = m.heads[k], m.tails[k], m.r[k]
            out[(d1, int(s))] = (np.linalg.norm(H @ e1 + r - T @ e2) + np.linalg.norm(H @ e2 + r - T @ e1),
                                 np.linalg.norm(H @ f1 + r - T @ f2) + np.linalg.norm(H @ f2 + r - T @ f1))
    return out


def test_expression_predictor_range(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 2, 6).astype(float).tolist(), rng.standard_normal(4).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, fp array<double>, desc array<double>")
    m = FeatureModel.random(1, 6, 4, 5, "both", hidden_fp=(5, 3), hidden_pr=(3,))
    out = predict_expression(df, m).collect()
    assert len(out) == 20 and all(len(r["pred"]) == 5 and max(abs(v) for v in r["pred"]) <= 10 for r in out)
    ref = m.predict(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    got = {r["row_id"]: r["pred"] for r in out}
    assert np.allclose(np.array([got[i] for i in range(20)]), ref)


def test_row_scores_match_rowwise_over_blocks_and_partitions(spark, monkeypatch):
    df, rows = _pairs(spark, n=12)
    m = PairModel.random(9, 8, 4, [0, 1, 2])
    want = _every_score(rows, m)
    with_se = df.withColumn("se", (F.col("drug1") % 4).cast("int"))      # se 3 is unknown to the model
    for block, parts in ((scoring.BLOCK_BYTES, 1), (1, 3)):
        monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
        for r in score_rows_full(with_se.repartition(parts), m).collect():
            got = (r["score_fwd"], r["score_rev"])
            if r["se"] == 3 or r["drug1"] == 999:
                assert got == (None, None)
            else:
                assert np.allclose(got, want[(r["drug1"], r["se"])], atol=1e-9)


def test_ranking_matches_rowwise_over_blocks(spark, monkeypatch):
    """In-kernel top-k per pair equals flagged rows sorted row by row, with one
    block of side effects and with several."""
    df, rows = _pairs(spark, n=30)
    m = PairModel.random(4, 8, 4, list(range(12)))
    want = {k: sum(v) / 2 for k, v in _every_score(rows, m).items()}
    med = float(np.median(list(want.values())))
    th, k = np.full(12, med), 5
    for per_block in (12, 5, 1):
        size = (m.heads.nbytes + m.tails.nbytes + m.r.nbytes) // 12 + 16
        monkeypatch.setattr(scoring, "BLOCK_BYTES", per_block * size)
        assert len(scoring.se_blocks(12, size)) == -(-12 // per_block)
        got = screen_ranked(df, th, k, model=m).collect()
        assert got
        by_pair = {}
        for r in got:
            by_pair.setdefault(r["drug1"], []).append((r["rank"], r["se"], r["total_predicted_reactions"]))
        for d1, *_ in rows[:-1]:
            flagged = sorted((-abs(want[(d1, s)] - med), s) for s in range(12) if want[(d1, s)] < med)
            assert sorted(by_pair.get(d1, [])) == [(i + 1, s, len(flagged)) for i, (_, s) in enumerate(flagged[:k])]
    # the identity head goes through the same blocks
    R = np.random.default_rng(0).standard_normal((7, 8))
    ids, thr = np.arange(7), np.full(7, 9.0)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1 << 20)
    one = screen_ranked(df, thr, 3, se_ids=ids, R=R)
    whole = sorted(map(tuple, one.select("drug1", "se", "rank", "total_predicted_reactions").collect()))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 100)
    cut = screen_ranked(df, thr, 3, se_ids=ids, R=R)
    assert whole == sorted(map(tuple, cut.select("drug1", "se", "rank", "total_predicted_reactions").collect())) != []


def test_offsets_by_counts_equal_the_mean_of_differences(spark):
    from dyadic.operators.joins import profile_lookup
    rng = np.random.default_rng(6)
    prof = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(1, 9)], "drug_id long, vec array<double>")
    obs = [(int(a), int(b), int(s), int(y)) for a, b, s, y in zip(*(rng.integers(1, 11, 300), rng.integers(1, 11, 300),
                                                                    rng.integers(0, 4, 300), rng.integers(0, 2, 300)))]
    pairs = spark.createDataFrame(obs, "drug1 long, drug2 long, se int, label int")
    a = {r["se"]: r["r"] for r in scoring.se_translation_fit(profile_lookup(pairs, prof)).collect()}
    b = {r["se"]: r["r"] for r in scoring.se_translation_fit_by_counts(pairs, prof).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_observations_score_like_rows(spark):
    """Vectors once per distinct pair: repeated rows, unknown side effects and missing profiles included."""
    df, rows = _pairs(spark, n=12)
    profile = spark.createDataFrame([(d, v) for r in rows for d, v in ((r[0], r[2]),) if v] , "drug_id long, vec array<double>")
    m = PairModel.random(3, 8, 4, [4, 1, 9])
    obs = [(100 * i + s, i, i + 1, s) for i in range(13) for s in (1, 4, 9, 77)] + [(5000, 0, 1, 1), (5001, 0, 1, None), (5002, 3, None, 1)]
    table = spark.createDataFrame(obs, "row_id long, drug1 long, drug2 long, se int").repartition(3)
    vec = {r[0]: np.array(r[2]) for r in rows if r[2]}
    got = {r.row_id: r for r in scoring.score_observations(table, profile, model=m).collect()}
    R = np.random.default_rng(1).standard_normal((3, 8))
    flat = {r.row_id: r for r in scoring.score_observations(table, profile, se_ids=np.array([4, 1, 9]), R=R).collect()}
    assert len(got) == len(flat) == len(obs)
    for i, a, b, s in obs:
        if s not in (1, 4, 9) or a not in vec or b not in vec:
            assert got[i].score_fwd is None and flat[i].score_rev is None
            continue
        e1, e2 = _row_forward(m, vec[a], vec[b])
        k = m.se_ids.tolist().index(s)
        want = np.linalg.norm(m.heads[k] @ e1 + m.r[k] - m.tails[k] @ e2) + np.linalg.norm(m.heads[k] @ e2 + m.r[k] - m.tails[k] @ e1)
        assert np.isclose(got[i].score_fwd, want)
        r = R[[4, 1, 9].index(s)]
        assert np.isclose(flat[i].score_fwd, np.linalg.norm(vec[a] + r - vec[b]) + np.linalg.norm(vec[b] + r - vec[a]))
        assert flat[i].score_fwd == flat[i].score_rev
