"""Q6 -- the screen as a Structured Streaming job with bounded state.

A stream of requests ``(request_id, drug1, drug2)`` is screened micro-batch by
micro-batch with ``foreachBatch``: the catalogue side (profiles, offsets,
thresholds, names) is static and prepared once: up to ``PROFILE_BYTES`` of
profiles are broadcast once for all micro-batches, not once in each; each
micro-batch runs the same screen as the batch job. Every request ends in exactly one of two outputs,
``responses`` or ``rejects``.

Repeated ids are taken out before the batch by ``dropDuplicatesWithinWatermark``:
the state store holds an id from its arrival until the watermark has passed it by
``keep``, so the state is as large as the ids that arrive in that time, whatever
the length of the history, and a batch reads no earlier output. Unless the session
names another provider, the state lies in RocksDB, on the executors' disks and not
in their heaps.

The watermark runs on *arrival* time, not on the time a request bears: a request
that is late by its own time is still the first with its id and is answered.
Arrival is the time of the micro-batch, which never goes back, so no row is behind
the watermark; a source that records arrival itself names that column (rows more
than ``keep`` behind the latest arrival are then dropped by Spark and counted in
the query's progress). A repeat that arrives after its id has left the state is a
new request.

Requests without an id cannot be told apart: each has a key of its own and is
answered. Output is written per batch id with overwrite semantics, so a batch that
is replayed after a failure rewrites the same output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import HeldProfiles, bounded_broadcast, held_profiles, profile_lookup
from ..functions.scalar import TOP_RESULTS
from ..operators.scoring import identity_params, screen_ranked
from ..operators.thresholds import threshold_mean
from ..plans.screen import format_ranked, responses, valid_requests
from ..session import ensure_checkpoint_dir, stored_once

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class StaticSide:
    profile: DataFrame
    names: DataFrame
    thr: DataFrame
    se_ids: object
    R: object
    th: object
    held: HeldProfiles | None = None


def prepare(profile: DataFrame, thresholds: DataFrame, names: DataFrame, r_table: DataFrame,
            mode: str = "last5") -> StaticSide:
    thr = bounded_broadcast(threshold_mean(thresholds, mode))
    se_ids, R, th = identity_params(r_table, thr)
    return StaticSide(profile, bounded_broadcast(names), thr, se_ids, R, th, held_profiles(profile))


def screen_batch(requests: DataFrame, side: StaticSide) -> tuple[DataFrame, DataFrame]:
    """Responses and rejects of one batch of requests (same rules as ``plans.screen``)."""
    valid, rejects = valid_requests(requests)
    pairs = valid.select("drug1", "drug2").distinct()
    looked_up = pairs if side.held else profile_lookup(pairs, side.profile)
    ranked = screen_ranked(looked_up, side.th, TOP_RESULTS, se_ids=side.se_ids, R=side.R, held=side.held)
    return responses(valid, format_ranked(ranked, side.names)), rejects


def first_arrivals(stream: DataFrame, keep: str = "1 day", arrival: str | None = None) -> DataFrame:
    """The stream without the repeats that arrive within ``keep``; adds ``_arrival`` and ``_key``."""
    seen = F.current_timestamp() if arrival is None else F.col(arrival).cast("timestamp")
    # one branch for all rows: a second one without rows would hold the watermark back
    key = F.coalesce(F.col("request_id").cast("string"), F.uuid())
    return (stream.withColumn("_arrival", seen).withColumn("_key", key).withWatermark("_arrival", keep)
            .dropDuplicatesWithinWatermark(["_key"]))


def start(spark: SparkSession, stream: DataFrame, side: StaticSide, out_path: str, checkpoint: str,
          trigger_available_now: bool = True, keep: str = "1 day", arrival: str | None = None):
    """Run the streaming screen into ``out_path``/responses and /rejects; returns the ``StreamingQuery``."""
    ensure_checkpoint_dir(spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        # read several times, and the state is to be asked once, also after a lost executor
        fresh = stored_once(batch.drop("_arrival", "_key"), "batch")
        for part, rows in zip(("responses", "rejects"), screen_batch(fresh, side)):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out_path}/{part}/batch_id={batch_id}")

    w = (first_arrivals(stream, keep, arrival).writeStream.outputMode("append").foreachBatch(each)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    if spark.conf.get(PROVIDER, None) is not None:
        return w.start()
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings that hold when it starts
    try:
        return w.start()
    finally:
        spark.conf.unset(PROVIDER)
