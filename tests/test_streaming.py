"""Streaming screen: every request ends in responses or rejects, once, however
late it comes, and the responses equal the batch responses."""

import datetime as dt

from dyadic.plans.catalog import _r_table
from dyadic.plans.screen import screen
from dyadic.sources import fixtures as fx
from dyadic.streaming import screen_stream as ss


def test_stream_answers_every_request_once(spark, sf_dir, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), 1 + i % 7, 2 + i % 5) for i in range(40)]
    late = (100, base - dt.timedelta(days=1), 1, 2)
    bad = [(101, base, None, 2), (102, base - dt.timedelta(days=2), 0, 3)]
    batches = [rows[:25], rows[20:] + [bad[0]], rows[:10] + [late, bad[1], bad[0]]]  # later files replay requests
    src = tmp_path / "requests"
    schema = "request_id long, ts timestamp, drug1 long, drug2 long"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    side = ss.prepare(fx.profile(spark, sf_dir), fx.screen_threshold(spark, sf_dir), fx.side_effect(spark, sf_dir),
                      _r_table(spark, sf_dir))
    out_path = str(tmp_path / "out")
    ss.start(spark, stream, side, out_path, str(tmp_path / "chk")).awaitTermination()
    valid = spark.createDataFrame([*rows, late], schema)
    batch = screen(valid, fx.profile(spark, sf_dir), fx.screen_threshold(spark, sf_dir), fx.side_effect(spark, sf_dir),
                   fx.se_catalogue(spark, sf_dir), r_table=_r_table(spark, sf_dir)).responses
    out = spark.read.schema(batch.schema).parquet(f"{out_path}/responses").select(*batch.columns)
    assert out.count() == 41
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0
    rejects = spark.read.schema("request_id long, reason string").parquet(f"{out_path}/rejects").collect()
    assert sorted(r["request_id"] for r in rejects) == [101, 102]
    # a replayed batch writes the same again
    again = spark.read.schema("request_id long, batch_id long").parquet(f"{out_path}/responses")
    assert again.where("batch_id >= 0").select("batch_id").distinct().count() == 3


def _run(spark, side, tmp_path, batches, **options):
    """Four or more files, one a batch, through the stream; (responses, rejects, state operator's figures by batch)."""
    schema = "request_id long, ts timestamp, drug1 long, drug2 long, received timestamp"
    src, out = tmp_path / "requests", str(tmp_path / "out")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    query = ss.start(spark, stream, side, out, str(tmp_path / "chk"), **options)
    query.awaitTermination()
    read = lambda part, columns: spark.read.schema(columns).parquet(f"{out}/{part}").collect()
    state = [op for p in query.recentProgress for op in p["stateOperators"]]
    return (read("responses", "request_id long, drug1 long, response_json string"),
            read("rejects", "request_id long, reason string"), state)


def _side(spark, sf_dir):
    return ss.prepare(fx.profile(spark, sf_dir), fx.screen_threshold(spark, sf_dir), fx.side_effect(spark, sf_dir),
                      _r_table(spark, sf_dir))


def test_state_is_bounded_by_the_watermark(spark, sf_dir, tmp_path):
    base = dt.datetime(2024, 1, 1)
    hour = lambda h: base + dt.timedelta(hours=h)
    # six batches, ten hours apart; each has 30 new ids, repeats of the one before, and ids late by their own time
    batches = []
    for k in range(6):
        new = [(100 * k + j, hour(-500 + k), 1 + j % 7, 2 + j % 5, hour(10 * k)) for j in range(30)]
        again = [(*r[:4], hour(10 * k)) for r in batches[-1][:30]] if batches else []
        batches.append(new + again + again[:5] + [(10 ** 6 + k, hour(0), None, 2, hour(10 * k))])
    answered, rejected, state = _run(spark, _side(spark, sf_dir), tmp_path, batches, keep="15 hours", arrival="received")
    assert sorted(r.request_id for r in answered) == sorted(100 * k + j for k in range(6) for j in range(30))
    assert sorted(r.request_id for r in rejected) == [10 ** 6 + k for k in range(6)]
    assert max(s["numRowsTotal"] for s in state) <= 4 * 31 < 6 * 31  # not the whole history
    assert sum(s["numRowsRemoved"] for s in state) > 0
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 0


def test_repeats_after_the_horizon_are_new_requests(spark, sf_dir, tmp_path):
    base = dt.datetime(2024, 1, 1)
    hour = lambda h: base + dt.timedelta(hours=h)
    row = lambda i, h: (i, base, 1, 2, hour(h))
    batches = [[row(1, 0), row(1, 0)], [row(2, 1), row(1, 1)], [row(3, 10)], [row(4, 20)], [row(1, 21), row(4, 21)]]
    answered, _, _ = _run(spark, _side(spark, sf_dir), tmp_path, batches, keep="2 hours", arrival="received")
    assert sorted(r.request_id for r in answered) == [1, 1, 2, 3, 4]


def test_requests_without_an_id_are_all_answered(spark, sf_dir, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(None, base, 1, 2, base), (None, base, 1, 2, base), (5, base, 1, 2, base), (None, base, 0, 2, base)]
    answered, rejected, _ = _run(spark, _side(spark, sf_dir), tmp_path, [rows, rows, rows[:1]])
    assert [r.request_id for r in answered if r.request_id] == [5]
    assert len(answered) == 6 and len(rejected) == 2
