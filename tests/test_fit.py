"""Ridge fits against NumPy on the rows themselves."""

import numpy as np
import pytest

from dyadic.operators import fit


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    X = rng.standard_normal((300, 7)) * np.array([1, 2, 5, 0.3, 1, 1, 9]) + 3
    Y = X @ rng.standard_normal((7, 3)) + 4 + rng.standard_normal((300, 3))
    rows = [(i, i % 4, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(X, Y))]
    return X, Y, spark.createDataFrame(rows, "row_id long, fold int, x array<double>, y array<double>").repartition(5).persist()


def by_hand(X, Y, l2, intercept=True):
    Z = np.hstack([np.ones((len(X), 1)), X]) if intercept else X
    pen = np.eye(Z.shape[1]) * l2
    if intercept:
        pen[0, 0] = 0
    return np.linalg.solve(Z.T @ Z + pen, Z.T @ Y)


@pytest.mark.parametrize("intercept", [True, False])
def test_fit_and_conjugate_gradients(data, intercept):
    X, Y, df = data
    want = by_hand(X, Y, 0.5, intercept)
    assert np.allclose(fit.ridge_fit(df, "x", "y", 0.5, intercept), want, atol=1e-9)
    got, passes = fit.ridge_cg(df, "x", "y", 0.5, intercept)
    assert np.abs(got - want).max() < 1e-6 and passes <= 40


def test_conjugate_gradients_say_when_passes_do_not_do(data):
    with pytest.raises(RuntimeError):
        fit.ridge_cg(data[2], "x", "y", 0.5, passes=2)


def test_penalty_chosen_as_by_refitting(data):
    X, Y, df = data
    Z, folds, penalties = np.hstack([np.ones((300, 1)), X]), np.arange(300) % 4, [0.01, 1.0, 50.0, 1e4]
    want = []
    for l2 in penalties:
        wrong = sum(((Y[folds == f] - Z[folds == f] @ by_hand(X[folds != f], Y[folds != f], l2)) ** 2).sum() for f in range(4))
        want.append(wrong / Y.size)
    best, errors, W = fit.ridge_choose(df, "x", "y", penalties)
    assert [p for p, _ in errors] == penalties and np.allclose([e for _, e in errors], want, rtol=1e-8)
    assert best == penalties[int(np.argmin(want))] and np.allclose(W, by_hand(X, Y, best))
    with pytest.raises(ValueError):
        fit.ridge_choose(df.where("fold = 1"), "x", "y", penalties)


def test_no_rows(data):
    with pytest.raises(ValueError):
        fit.ridge_fit(data[2].limit(0), "x", "y")
