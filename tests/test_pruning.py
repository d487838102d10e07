"""The pruned screen gives what the whole one gives, with fewer scores."""

import numpy as np
import pytest

from dyadic.operators import pruned_screen as P
from dyadic.operators.scoring import PairModel, screen_ranked


def pairs(spark, spread):
    rng = np.random.default_rng(0)
    middle = rng.standard_normal((6, 2, 8)) * 3
    rows = []
    for i in range(400):
        a, b = middle[i % 6] + spread * rng.standard_normal((2, 8))
        rows.append((i, 1000 + i, a.tolist(), b.tolist()))
    rows += [(5000, 5001, None, rows[0][3])]
    return spark.createDataFrame(rows, "drug1 long, drug2 long, vec1 array<double>, vec2 array<double>").repartition(3)


def rows_of(df):
    return sorted((r.drug1, r.drug2, r.rank, r.se, round(r.mean_predicted_score, 9), round(r.gap, 9),
                   r.total_predicted_reactions) for r in df.collect())


@pytest.mark.parametrize("kind, spread", [("identity", 0.05), ("identity", 2.0), ("full", 0.05), ("full", 2.0)])
def test_same_rows_with_fewer_scores(spark, monkeypatch, kind, spread):
    from dyadic.operators import scoring
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)  # several blocks
    df, rng = pairs(spark, spread), np.random.default_rng(1)
    ids = np.arange(0, 60, 2)
    if kind == "identity":
        options = {"se_ids": ids, "R": rng.standard_normal((30, 8)) * 3}
    else:
        options = {"model": PairModel.random(3, 8, 4, ids)}
    probe = screen_ranked(df, np.full(30, 1e9), 30, **options).toPandas()
    th = np.full(30, probe["mean_predicted_score"].quantile(0.1))
    th[4] = np.nan
    want = rows_of(screen_ranked(df, th, 5, **options))
    ranked, figures = P.screen_pruned(df, th, 5, **options)
    assert rows_of(ranked) == want and len(want) > 200
    f = figures.first()
    assert (f.n_pairs, f.n_scores) == (400, 12_000) and f.n_scored <= 400 * 29
    if spread < 1:
        assert f.n_scored < 0.6 * f.n_scores


def test_farthest_first_groups_by_the_nearest_pivot():
    x = np.random.default_rng(2).standard_normal((200, 3))
    pivots, group = P.farthest_first(x, 12)
    away = np.linalg.norm(x[:, None] - x[pivots][None], axis=2)
    assert len(set(pivots.tolist())) == 12 and np.allclose(away[np.arange(200), group], away.min(axis=1))
    assert P.farthest_first(np.ones((5, 2)), 3)[0].tolist() == [0]


def test_nothing_to_screen(spark):
    df = pairs(spark, 1.0)
    ranked, figures = P.screen_pruned(df.limit(0), np.ones(2), 5, se_ids=np.arange(2), R=np.ones((2, 8)))
    assert ranked.count() == 0 and tuple(figures.first()) == (0, 0, 0)
    ranked, figures = P.screen_pruned(df, np.zeros(0), 5, se_ids=np.zeros(0, int), R=np.zeros((0, 8)))
    assert ranked.count() == 0 and figures.first().n_scored == 0


def test_the_figures_read_one_stored_column(spark):
    """The lists of ranked rows are stored by columns: whoever only counts the scores does not read them."""
    rng = np.random.default_rng(4)
    ranked, figures = P.screen_pruned(pairs(spark, 1.0), np.full(3, 1e9), 2, se_ids=np.arange(3), R=rng.standard_normal((3, 8)))
    plan = figures._sc._jvm.PythonSQLUtils.explainString(figures._jdf.queryExecution(), "simple")
    assert "ReadSchema: struct<n_scored:bigint>" in plan
    assert ranked.count() == 2 * 400


@pytest.mark.parametrize("top", [1, 3, 50])
def test_best_of_a_chunk_is_the_ranking_by_pair(top):
    from dyadic.operators.scoring import _rank_rows
    rng = np.random.default_rng(5)
    sx, sy = np.round(rng.random((2, 40, 12)), 1)  # many ties
    sx[3], sy[3] = np.nan, np.nan
    sx[rng.random((40, 12)) < 0.2] = np.nan
    th, ids = np.round(rng.random(12), 1), np.arange(0, 24, 2)
    th[5] = np.nan
    total, best = P._best(ids, th, sx, sy, top)
    want = _rank_rows(np.arange(40), np.arange(40), ids, sx, sy, th, top).sort_values(["drug1", "rank"])
    assert list(zip(best["at"], best["se"])) == list(zip(want["drug1"], want["se"])) and len(want)
    assert np.array_equal(best["gap"], want["gap"]) and np.array_equal(total[best["at"]], want["total_predicted_reactions"])


def test_vectors_of_another_width_are_refused(spark):
    df = spark.createDataFrame([(1, 2, [1.0], [1.0, 2.0, 3.0]), (3, 4, [1.0, 2.0, 3.0], [1.0])],
                               "drug1 long, drug2 long, vec1 array<double>, vec2 array<double>").coalesce(1)
    with pytest.raises(Exception, match="for a model of 2"):
        P.screen_pruned(df, np.ones(1), 1, se_ids=np.arange(1), R=np.ones((1, 2)))
