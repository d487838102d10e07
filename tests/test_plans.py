"""Plan properties of every registered query (scale guards)."""

import pytest

import __spark_entry__ as entry_mod

Q = entry_mod.queries()
HEAVY = {"profile_clusters", "signature_clusters", "screen_stream", "ridge_fit"}   # fitted / streamed; plans trivial


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q) - HEAVY))
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    plan = _plan(Q[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_screen_reads_only_needed_columns(spark, sf_dir):
    plan = _plan(Q["screen"](spark, sf_dir))
    events = [line for line in plan.split("\n") if "events.parquet" in line]
    assert events and all("ReadSchema: struct<event_id:bigint,user_id:bigint>" in line for line in events)
    emb = [line for line in plan.split("\n") if "embeddings.parquet" in line]
    assert emb and all("ReadSchema: struct<vec_id:bigint,embedding:" in line and "label" not in line for line in emb)


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from dyadic.operators.joins import bounded_broadcast
    big, small = spark.range(50), spark.range(40).select(
        "id", F.array_repeat(F.lit(1.0), 1000).alias("v"), F.lit("text").alias("t"),
        F.array(F.struct(F.lit("a").alias("x"))).alias("s"), F.create_map(F.lit("k"), F.lit(2)).alias("m"),
        F.lit(None).cast("array<string>").alias("n"))
    hinted = lambda df, **limits: "ResolvedHint" in bounded_broadcast(df, **limits).join(
        big, "id")._jdf.queryExecution().analyzed().toString()
    fresh = lambda: small.select("*")  # noqa: E731  (a checked frame remembers that it was)
    assert hinted(fresh()) and not hinted(fresh(), max_rows=39)
    assert hinted(fresh(), max_bytes=400_000) and not hinted(fresh(), max_bytes=300_000)


def test_evaluation_without_a_join_equals_the_joined_one(spark, sf_dir):
    from dyadic.plans.evaluate import evaluate, evaluate_scored, orientations
    from dyadic.sources import fixtures as fx
    scored, thr = fx.scored(spark, sf_dir), fx.threshold(spark, sf_dir)
    a, b = evaluate_scored(scored, thr).merged, evaluate(*orientations(scored), thr).merged
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 100
