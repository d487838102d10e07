"""Hold-out draws against a plain ranking per stratum."""

import math

import pytest
from pyspark.sql import functions as F

from dyadic.operators import sampling as S


def table(spark):
    rows = [(i, 1 if i % 3 else 2, "a" if i % 7 else None) for i in range(5000)]
    rows += [(10_000 + i, 3, "b") for i in range(15)] + [(20_000 + i, 4, "b") for i in range(5)] + [(30_000, 5, "c")]
    return spark.createDataFrame(rows, "row_id long, se int, label string").withColumn("sample", F.lit("x")).repartition(6)


def half_even(x):
    return round(x)


def plain(df, frac, samples, method, first=0):
    keyed = df.select("*", *[S.draw_key("row_id", first + k, method).alias(f"k{k}") for k in range(samples)]).collect()
    out = set()
    for k in range(samples):
        strata = {}
        for r in keyed:
            strata.setdefault((r.se, r.label), []).append((r[f"k{k}"], r.row_id))
        for rows in strata.values():
            out |= {(first + k, i) for _, i in sorted(rows)[:half_even(frac * len(rows))]}
    return out


@pytest.mark.parametrize("method, window_rows", [("lcg", 200_000), ("xxhash64", 200_000), ("xxhash64", 0)])
def test_draws_against_plain_ranking(spark, monkeypatch, method, window_rows):
    monkeypatch.setattr(S, "WINDOW_ROWS", window_rows)
    df = table(spark)
    got = S.repeated_holdout(df, 0.1, 3, method=method, first=4)
    assert got.columns == ["sample_no", *df.columns]
    rows = [(r.sample_no, r.row_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(df, 0.1, 3, method, 4)
    assert {(0, r.row_id) for r in S.stratified_holdout(df, 0.25, method=method).collect()} == plain(df, 0.25, 1, method)


def test_a_draw_of_everything_and_of_nothing(spark):
    df = table(spark)
    assert S.repeated_holdout(df, 1.0, 2).count() == 2 * df.count()
    assert S.repeated_holdout(df, 0.0, 2).count() == 0
    assert S.repeated_holdout(df.limit(0), 0.1, 2).count() == 0


def test_rows_with_equal_keys_are_drawn_by_id(spark):
    # the portable key repeats after a million ids
    df = spark.createDataFrame([(1000003 * k + 5, 1, 1) for k in range(40)], "row_id long, se int, label int")
    got = {r.row_id for r in S.stratified_holdout(df, 0.25, method="lcg").collect()}
    assert got == {1000003 * k + 5 for k in range(10)}


def test_training_rows_of_every_draw(spark):
    df = table(spark).withColumn("drug1", F.col("row_id") % 1500).withColumn("drug2", F.lit(1))
    left = S.training_rows(df, 0.1, 3, method="lcg")
    drawn = plain(df, 0.1, 3, "lcg")
    seen = {}
    for r in df.collect():
        seen.setdefault((r.drug1, r.drug2, r.se, r.label), []).append(r.row_id)
    want = {key: [k for k in range(3) if (k, ids[0]) not in drawn] for key, ids in seen.items() if len(ids) == 1}
    assert {(r.drug1, r.drug2, r.se, r.label): r.train_in for r in left.collect()} == want


def test_draws_move_no_rows(spark):
    """Nothing but histograms, the rows of one range and bounds is shuffled: the table itself is filtered where it lies."""
    plan = S.repeated_holdout(table(spark).drop("sample"), 0.1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(se") <= 1
    assert math.isclose(S.BINS, 2 ** round(math.log2(S.BINS)))
