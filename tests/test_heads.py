"""Heads as rows: stored block by block, and screened like the model that holds them all."""

import numpy as np
import pytest

from dyadic.operators import heads as H
from dyadic.operators.scoring import PairModel, _model_block, screen_ranked


@pytest.fixture()
def pairs(spark):
    rng = np.random.default_rng(0)
    vec = lambda: rng.standard_normal(8).tolist()
    rows = [(i, i + 1, vec(), vec()) for i in range(70)] + [(900, 901, None, vec()), (902, 903, vec(), None)]
    return spark.createDataFrame(rows, "drug1 long, drug2 long, vec1 array<double>, vec2 array<double>").repartition(3)


def rows_of(df):
    return sorted((r.drug1, r.drug2, r.rank, r.se, round(r.mean_predicted_score, 4), round(r.gap, 4),
                   r.total_predicted_reactions) for r in df.collect())


def thresholds(spark, ids, at):
    return spark.createDataFrame([(int(s), float(at)) for s in ids if s % 5], "se int, optimal_thr double")


@pytest.mark.parametrize("slice_rows", [16_384, 20])
def test_blocks_screen_like_the_whole_model(spark, pairs, tmp_path, monkeypatch, slice_rows):
    monkeypatch.setattr(H, "SLICE", slice_rows)
    model = PairModel.random(3, 8, 4, range(0, 46, 2))
    for name in ("heads", "tails", "r"):  # as float32 has them
        setattr(model, name, getattr(model, name).astype(np.float32).astype(float))
    H.save_model_rows(spark, model, str(tmp_path / "m"), block_bytes=800)
    shared, heads = H.load_model_rows(spark, str(tmp_path / "m"))
    assert heads.select("block").distinct().count() == 5 and shared.heads.size == 0
    thr = thresholds(spark, model.se_ids, 3.4)
    th = np.array([3.4 if s % 5 else np.nan for s in model.se_ids])
    got = rows_of(H.screen_by_blocks(pairs, shared, heads, thr, 6))
    assert got == rows_of(screen_ranked(pairs, th, 6, model=model)) and len(got) > 100
    assert max(r[2] for r in got) == 6 and max(r[6] for r in got) > 6


def test_heads_by_rule_are_exact(spark):
    ids = spark.createDataFrame([(s,) for s in (0, 3, 17)], "se int")
    model = PairModel.formula(8, 4, list(range(20)))
    rows = H.formula_heads(ids, 4).toPandas().sort_values("se", ignore_index=True)
    got = H._unpacked(rows)
    assert got.se_ids.tolist() == [0, 3, 17]
    assert np.allclose(got.heads, model.heads[got.se_ids], atol=1e-15) and np.allclose(got.tails, model.tails[got.se_ids], atol=1e-15)
    assert np.array_equal(got.r, model.r[got.se_ids])


def test_blocks_are_drawn_one_at_a_time(spark, tmp_path):
    model, drawn = PairModel.random(1, 4, 2, range(9)), []

    def blocks():
        for b in H.model_blocks(model, block_bytes=100):
            drawn.append(len(b[0]))
            yield b

    H.write_heads(spark, blocks(), str(tmp_path / "h"))
    assert drawn == [2, 2, 2, 2, 1]
    assert sorted(r.se for r in H.read_heads(spark, str(tmp_path / "h")).collect()) == list(range(9))


def test_awkward_heads(spark, pairs):
    model = PairModel.random(1, 8, 4, range(3))
    shared = _model_block(model, 0, 0)
    heads = spark.createDataFrame([H._packed(0, s, model.heads[s], model.tails[s], model.r[s], 1.0) for s in range(3)], H.HEADS_SCHEMA)
    none = thresholds(spark, [], 1)
    assert H.screen_by_blocks(pairs, shared, heads, none, 5).count() == 0
    assert H.screen_by_blocks(pairs, shared, heads.limit(0), thresholds(spark, [1], 9), 5).count() == 0
    assert H.screen_by_blocks(pairs.limit(0), shared, heads, thresholds(spark, [1], 9), 5).count() == 0
    with pytest.raises(ValueError):
        H.screen_by_blocks(pairs, shared, heads.union(heads), none, 5)
