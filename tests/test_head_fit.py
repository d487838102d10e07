"""Heads by alternating least squares: planted ones come back, the objective never rises, sums are those of the rows."""

import numpy as np
import pytest

from dyadic.operators import head_fit as A
from dyadic.operators.heads import _unpacked

D = 5


def planted(spark, rng, n=400, noise=0.0, tail=False):
    """Three side effects with their own H, r (and T); the last one holds most pairs."""
    truth, rows = {}, []
    for se, share in ((2, 0.1), (7, 0.2), (9, 0.7)):
        h = np.eye(D) + 0.4 * rng.standard_normal((D, D))
        t = np.eye(D) + (0.3 * rng.standard_normal((D, D)) if tail else 0)
        r = rng.standard_normal(D)
        truth[se] = (h, t, r)
        for _ in range(int(n * share)):
            e1 = rng.standard_normal(D) * 2
            e2 = np.linalg.solve(t, h @ e1 + r) + noise * rng.standard_normal(D)
            rows.append((se, e1.tolist(), e2.tolist(), 1))
    rows += [(2, None, [0.0] * D, 1), (None, [1.0] * D, [0.0] * D, 1), (2, [9.0] * D, [-9.0] * D, 0)]
    return truth, spark.createDataFrame(rows, "se int, e1 array<double>, e2 array<double>, label int").repartition(6)


def fitted(df):
    rows = df.toPandas().sort_values("se", ignore_index=True)
    return _unpacked(rows), rows


def test_planted_heads_come_back(spark):
    truth, df = planted(spark, np.random.default_rng(1))
    model, rows = fitted(A.fit_heads(df, l2=1e-6, label="label"))
    assert model.se_ids.tolist() == [2, 7, 9] and rows["n"].tolist() == [40.0, 80.0, 280.0]
    for k, se in enumerate(model.se_ids):
        h, _, r = truth[se]
        assert np.allclose(model.heads[k], h, atol=1e-4) and np.allclose(model.tails[k], np.eye(D), atol=1e-4)
        assert np.allclose(model.r[k], r, atol=1e-4)


def test_planted_tails_come_back_as_maps(spark):
    truth, df = planted(spark, np.random.default_rng(2), tail=True)
    model, _ = fitted(A.fit_heads(df, l2=1e-4, label="label"))
    for k, se in enumerate(model.se_ids):  # heads and tails are only fixed together
        h, t, r = truth[se]
        assert np.allclose(np.linalg.solve(model.tails[k], model.heads[k]), np.linalg.solve(t, h), atol=1e-2)
        assert np.allclose(np.linalg.solve(model.tails[k], model.r[k]), np.linalg.solve(t, r), atol=1e-2)


def test_objective_never_rises_and_is_that_of_the_rows(spark):
    _, df = planted(spark, np.random.default_rng(3), noise=0.5, tail=True)
    l2 = 3.0
    model, rows = fitted(A.fit_heads(df, l2=l2, label="label", sweeps=200))
    pairs = df.where("label = 1 and se is not null and e1 is not null").toPandas()
    for k, se in enumerate(model.se_ids):
        history = rows["objective"][k]
        assert all(b <= a * (1 + 1e-12) for a, b in zip(history, history[1:])) and history[-1] < history[0]
        e1, e2 = (np.stack(pairs[pairs["se"] == se][c].to_numpy()) for c in ("e1", "e2"))
        h, t, r = model.heads[k], model.tails[k], model.r[k]
        want = ((e1 @ h.T + r - e2 @ t.T) ** 2).sum() + l2 * (((h - np.eye(D)) ** 2).sum() + ((t - np.eye(D)) ** 2).sum())
        assert np.isclose(history[-1], want, rtol=1e-4)  # heads are stored as float32
        # a stationary point: no half step improves it
        grad = 2 * ((e1 @ h.T + r - e2 @ t.T).T @ e1 + l2 * (h - np.eye(D)))
        assert np.abs(grad).max() < 1e-2 * max(1.0, history[0])


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_sums_are_those_of_each_side_effect(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD_BYTES", held)
    _, df = planted(spark, np.random.default_rng(4), n=100, noise=0.2)
    got = {r.se: r for r in A.pair_sums(df.where("label = 1")).collect()}
    pairs = df.where("label = 1 and se is not null and e1 is not null").toPandas()
    assert set(got) == set(pairs["se"])
    for se, rows in pairs.groupby("se"):
        z = np.hstack([np.stack(rows["e1"]), np.stack(rows["e2"]), np.ones((len(rows), 1))])
        assert np.allclose(got[se].m, (z.T @ z)[np.triu_indices(2 * D + 1)]) and got[se].n == len(rows)


def test_few_pairs_stay_near_the_identity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [2.0, 1.0])], "se int, e1 array<double>, e2 array<double>")
    model, _ = fitted(A.fit_heads(df, l2=10.0))
    assert np.abs(model.heads[0] - np.eye(2)).max() < 0.2 and np.allclose(model.r[0], [1, 1], atol=0.2)
    assert A.fit_heads(df.limit(0)).count() == 0


def test_weights_count_as_copies(spark):
    rng = np.random.default_rng(6)
    rows = [(1, rng.standard_normal(2).tolist(), rng.standard_normal(2).tolist(), k % 3 + 1) for k in range(20)]
    df = spark.createDataFrame(rows, "se int, e1 array<double>, e2 array<double>, w int")
    copies = spark.createDataFrame([r for r in rows for _ in range(r[3])], df.schema)
    a, b = A.pair_sums(df, "w").first(), A.pair_sums(copies).first()
    assert a.n == b.n == sum(r[3] for r in rows) and np.allclose(a.m, b.m)
