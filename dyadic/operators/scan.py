"""Ordered scans per group that do not put a whole group into one task.

ROC curves, cut-offs, exact quantiles and stratified draws all need running
totals in a given order inside a group (a side effect, a stratum). A plain
``Window.partitionBy(group).orderBy(...)`` sends each group to one task, so a
group holding a third of all rows would be processed by one core. The scan
here is the textbook distributed prefix sum:

1. ``repartitionByRange(n, *group, *order)`` splits the data into ``n``
   contiguous, sampled ranges -- a hot group spans many slices -- and
   ``spark_partition_id()`` is recorded as the slice number. The sliced data
   is written once with a reliable ``checkpoint()`` (the session's
   ``spark.checkpoint.dir``): the range bounds come from a sample whose rows
   depend on shuffle arrival order, so two evaluations of the same plan, or a
   recomputation after a lost executor, could otherwise slice differently.
2. Per slice and group a small summary (totals, last row) is aggregated; a
   window over that summary (at most ``groups + n`` rows) turns it into the
   offsets of each slice and the group totals. This table is checkpointed
   and counted, and broadcast when the count is under the limit, so the big
   side is never shuffled for the join in step 4.
3. Inside each slice the rows are already contiguous and sorted, so the local
   running sums are one pass of ``mapInPandas`` -- no second shuffle.
4. Local sums + offsets give exact running totals; the last row of the
   previous slice supplies the lag of a slice's first row.

Both branches read the same checkpointed slices, so they always agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_slices, ensure_checkpoint_dir

OFFSET_BROADCAST_ROWS = 2_000_000
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _key(row) -> tuple:
    return tuple(None if pd.isna(v) else v for v in row.tolist())


def _local_scan(by: list[str], sums: list[str], lags: list[str], int_lags: set[str]):
    def run(batches):
        prev_key = None
        carry = {c: 0 for c in sums}
        last = {c: None for c in lags}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            n = len(pdf)
            if by:
                keys = pdf[by]
                prev = keys.shift()
                same = (keys == prev) | (keys.isna() & prev.isna())      # NULL keys form one group
                change = (~same.all(axis=1)).to_numpy().copy()
                first_key = _key(keys.iloc[0])
                change[0] = prev_key is None or first_key != prev_key
            else:
                change = np.zeros(n, dtype=bool)
                change[0] = prev_key is None
            gid = np.cumsum(change)
            cont = not change[0]
            head = gid == gid[0]
            out = {}
            for c in sums:
                cs = pd.Series(pdf[c].fillna(0).to_numpy()).groupby(gid).cumsum().to_numpy()
                if cont:
                    cs = cs + np.where(head, carry[c], 0)
                out[f"_loc_{c}"] = cs
                carry[c] = cs[-1]
            for c in lags:
                s = pdf[c].astype("Int64") if c in int_lags else pdf[c]
                lg = s.groupby(gid).shift(1)
                if cont:
                    lg.iloc[0] = last[c] if last[c] is not None else pd.NA if c in int_lags else np.nan
                out[f"_lagl_{c}"] = lg.to_numpy()
                last[c] = s.iloc[-1]
            out["_first"] = change
            res = pdf.assign(**{k: v for k, v in out.items()})
            for c in lags:
                if c in int_lags:
                    res[f"_lagl_{c}"] = pd.array(res[f"_lagl_{c}"], dtype="Int64")
            prev_key = _key(pdf[by].iloc[-1]) if by else ()
            yield res
    return run


def ordered_scan(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 sums: Sequence[str] = (), lags: Sequence[str] = (),
                 slices: int | None = None, broadcast_offsets: bool | None = None) -> DataFrame:
    """Running totals and lags per group, ascending in ``order``.

    Adds, for every ``c`` in ``sums``: ``cum_c`` (inclusive running sum) and
    ``tot_c`` (group total); for every ``c`` in ``lags``: ``prev_c`` (value of
    the previous row of the group, NULL on the first row). ``order`` must be a
    total order inside a group (unique per row); a NULL group key is a group
    of its own.

    ``broadcast_offsets``: None (default) broadcasts the offset table when its
    counted size is at most ``OFFSET_BROADCAST_ROWS`` (it has at most
    ``groups + slices`` rows), otherwise the planner joins it by shuffle.
    """
    by, order, sums, lags = list(by), list(order), list(sums), list(lags)
    n = slices or default_slices(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in by + order])
              .withColumn("_slice", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)

    aggs = [F.sum(c).alias(c) for c in sums]
    if lags:
        aggs.append(F.max_by(F.struct(*lags), F.struct(*order)).alias("_last"))
    if not aggs:
        aggs.append(F.count(F.lit(1)).alias("_rows"))
    summary = ranged.groupBy(*by, "_slice").agg(*aggs)
    w = Window.partitionBy(*by).orderBy("_slice")
    whole = Window.partitionBy(*by)
    off_cols = [F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{c}")
                for c in sums]
    off_cols += [F.sum(c).over(whole).alias(f"tot_{c}") for c in sums]
    if lags:
        off_cols.append(F.lag("_last").over(w).alias("_prev_last"))
    # the offset table has at most groups + slices rows; it is written once
    # (cheap: one pass over the sliced data, aggregated per slice) so its size
    # is known before the join is planned
    offsets = summary.select(*by, "_slice", *off_cols).checkpoint(eager=True)
    if broadcast_offsets is None:
        broadcast_offsets = offsets.limit(OFFSET_BROADCAST_ROWS + 1).count() <= OFFSET_BROADCAST_ROWS

    schema = ranged.schema
    types = {f.name: f.dataType for f in schema.fields}
    int_lags = {c for c in lags if isinstance(types[c], _INTEGRAL)}
    out_fields = list(schema.fields)
    for c in sums:
        out_fields.append(T.StructField(f"_loc_{c}", T.LongType() if isinstance(types[c], _INTEGRAL) else T.DoubleType()))
    for c in lags:
        out_fields.append(T.StructField(f"_lagl_{c}", types[c]))
    out_fields.append(T.StructField("_first", T.BooleanType()))
    local = (ranged.sortWithinPartitions(*[F.col(c) for c in by + order])
             .mapInPandas(_local_scan(by, sums, lags, int_lags), T.StructType(out_fields)))

    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in by + ["_slice"]],
                             *[c for c in offsets.columns if c not in by and c != "_slice"])
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    cond = [local[c].eqNullSafe(offsets[f"_o_{c}"]) for c in by] + [local["_slice"] == offsets["_o__slice"]]
    joined = local.join(offsets, cond)
    cols = [F.col(c) for c in df.columns]
    cols += [(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums]
    cols += [F.col(f"tot_{c}") for c in sums]
    cols += [F.when(F.col("_first"), F.col(f"_prev_last.{c}")).otherwise(F.col(f"_lagl_{c}")).alias(f"prev_{c}")
             for c in lags]
    return joined.select(*cols)
