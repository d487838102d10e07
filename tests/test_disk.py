"""What leaves a task is written once and no wider than the job needs: exchanges that are shared, copies that are bounded."""

import collections
import dataclasses

import numpy as np
import pytest

from dyadic.operators import joins
from dyadic.operators import neighbours as nb
from dyadic.plans import catalog
from dyadic.sources import fixtures as fx
from dyadic.sources import sinks
from dyadic.streaming import screen_stream as ss

LINES = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_extendedprice double"


@pytest.fixture
def orders_dir(spark, tmp_path):
    """Lines with copies, nulls, a negative quantity, and copies that differ in the label alone."""
    rows = [(1, 1, 10, 7.0, "R", 1.25), (1, 1, 10, 7.0, "R", 1.25), (1, 2, 11, 8.0, "N", 2.5), (1, 3, 10, 9.0, None, 0.5),
            (1, 3, 10, 9.0, "R", 0.5), (2, 1, 10, 37.0, "N", 3.0), (2, 2, 11, -8.0, "R", None), (2, 2, 11, None, "R", 4.0),
            (2, -1, 12, None, "N", 4.0), (2, 3, 10, -38.0, "N", 1.0), (3, 1, 10, 5.0, "R", 1.0),
            (None, 1, 10, 5.0, "R", 1.0), (None, 2, 11, 5.0, "R", 1.0), (4, None, 10, 5.0, "R", 1.0),
            (4, 1, None, 5.0, "R", 1.0), (4, 2, 11, 5.0, "R", 1.0)]
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path), rows


def test_pairs_of_an_order_against_plain_python(spark, orders_dir):
    path, rows = orders_dir
    cents = lambda p: None if p is None else round(p * 100)
    se = lambda q: None if q is None else int(abs(q)) % 30 * (1 if q > 0 else -1)
    want = collections.Counter((a[2], b[2], se(a[3]), int(a[4] == "R"), cents(a[5]), cents(b[5])) for a in rows for b in rows
                               if None not in (a[0], a[1], a[2], b[0], b[1], b[2])
                               and a[0] == b[0] and a[1] < b[1] and a[2] != b[2])
    got = collections.Counter()
    for r in fx.pairs_raw(spark, path).collect():
        got[tuple(r)[:6]] += r.n
    assert got == want and sum(want.values()) > 10


def _exchanges(df):
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled")
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [x for x in df.select("*")._jdf.queryExecution().executedPlan().toString().split("\n")
                if " Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_both_orientations_share_their_exchanges(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _exchanges(catalog._evaluation(spark, sf_dir).merged)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("order_key" in x for x in lines) == 1
    assert sum("drug1" in x for x in lines) == 1
    assert not any("drug2" in x and "drug1" not in x for x in lines)


def test_predictions_are_compressed_by_zstd(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, 0.5)], "drug1 long, drug2 long, se int, gap double")
    sinks.write_predictions(df, str(tmp_path / "p"), partition_by_se=True)
    assert list((tmp_path / "p" / "se=3").glob("*.zstd.parquet"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(1, 2, 0.5, 3)]


def _profiles(spark, kind="double"):
    rows = [(9, [0.5, None, -1.0]), (2, [1.0, 2.0, 3.0]), (7, None), (5, [float("nan"), 0.25, 4.0]), (-3, [0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, f"drug_id long, vec array<{kind}>").repartition(3)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_held_profiles_are_those_of_the_table(spark, monkeypatch, kind):
    monkeypatch.setattr(joins, "HELD_BYTES", 20)  # several blocks
    held = joins.held_profiles(_profiles(spark, kind))
    assert len(held.blocks) > 1
    m, present = held.matrix(np.array([5, 2, 4, 9, 7, -3, 2, 100]), 3)
    assert present.tolist() == [True, True, False, True, False, True, True, False]
    want = [[np.nan, 0.25, 4], [1, 2, 3], [0, 0, 0], [0.5, np.nan, -1], [0, 0, 0], [0, 0, 1], [1, 2, 3], [0, 0, 0]]
    np.testing.assert_array_equal(m, want)
    with pytest.raises(ValueError):
        held.matrix(np.array([2]), 4)
    with pytest.raises(ValueError):
        joins.held_profiles(_profiles(spark).unionAll(_profiles(spark)))
    assert joins.held_profiles(_profiles(spark).limit(0)).matrix(np.array([2]), 3)[1].tolist() == [False]
    monkeypatch.setattr(joins, "PROFILE_BYTES", 10)
    assert joins.held_profiles(_profiles(spark, kind)) is None


def test_a_micro_batch_broadcasts_no_profiles(spark, sf_dir, monkeypatch):
    side = ss.prepare(fx.profile(spark, sf_dir), fx.screen_threshold(spark, sf_dir), fx.side_effect(spark, sf_dir),
                      catalog._r_table(spark, sf_dir))
    requests = spark.createDataFrame([(i, i % 7, 1 + i % 5) for i in range(30)] + [(40, 10 ** 9, 1), (41, None, 2)],
                                     "request_id long, drug1 long, drug2 long")
    answered, _ = ss.screen_batch(requests, side)
    assert "embeddings.parquet" not in answered._jdf.queryExecution().executedPlan().toString()
    joined, _ = ss.screen_batch(requests, dataclasses.replace(side, held=None))
    assert "embeddings.parquet" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, answered.collect())) == sorted(map(tuple, joined.collect()))
    assert answered.where("total_predicted_reactions > 0").count() > 5


def test_stream_state_lies_in_rocksdb(spark, sf_dir, tmp_path):
    schema = "request_id long, drug1 long, drug2 long"
    spark.createDataFrame([(1, 1, 2), (1, 1, 2), (2, 0, 2)], schema).write.parquet(str(tmp_path / "in"))
    side = ss.prepare(fx.profile(spark, sf_dir), fx.screen_threshold(spark, sf_dir), fx.side_effect(spark, sf_dir),
                      catalog._r_table(spark, sf_dir))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get(ss.PROVIDER, None)
    ss.start(spark, stream, side, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert spark.conf.get(ss.PROVIDER, None) == before
    assert list((tmp_path / "chk").glob("state/**/*.zip"))  # snapshots of RocksDB
    assert spark.read.parquet(str(tmp_path / "out/responses")).count() == 1


def _plain_nearest(rows, k):
    x = {i: np.array(v, dtype=float) - np.mean(v) for i, v in rows}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    return [(i, r + 1, j) for i in sorted(x) for r, (_, j) in enumerate(sorted(
        (np.floor((1 - x[i] @ x[j]) * 1e9 + 0.5), j) for j in x if j != i)[:k])]


@pytest.mark.parametrize("floats, lane_bytes", [(True, 64 << 20), (False, 64 << 20), (True, 2000), (False, 1)])
def test_a_row_travels_once_to_each_lane(spark, monkeypatch, floats, lane_bytes):
    monkeypatch.setattr(nb, "LANE_BYTES", lane_bytes)
    monkeypatch.setattr(nb, "TILE", (7, 16))
    rng, n, d = np.random.default_rng(4), 60, 10
    x = rng.standard_normal((n, d)).astype(np.float32 if floats else np.float64)
    x[20:32] = x[3]  # copies: equal distances go to the lower id
    rows = [(int(7 * i % n), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "drug_id long, vec array<double>").repartition(5)
    got, sent = nb._nearest(df, 4, "vec", "drug_id", 16, 4, 4)
    lanes = max(8, -(-n // max(1, lane_bytes // (8 * d))))
    assert sent.count() <= n * lanes  # not once for each of up to 64 rings
    assert {len(r.v) for r in sent.collect()} == {d * (4 if floats else 8)}
    assert sorted(tuple(r)[:3] for r in got.collect()) == _plain_nearest(rows, 4)


def test_units_are_those_of_the_expression(spark):
    from dyadic.functions.vector import with_centre_unit
    x = np.random.default_rng(6).standard_normal((50, 33))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, z array<double>")
    want = [r.u for r in with_centre_unit(df, "z", "u").orderBy("id").collect()]
    np.testing.assert_array_equal(nb._units(x), want)
