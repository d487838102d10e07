"""Side-effect heads as rows, met with pair embeddings block by block.

``scoring.screen_ranked`` ships the whole per-side-effect part of the pair model
through the driver. Here the heads are a table instead: one row per side effect
with its head, tail and offset as float32 bytes (times a float64 ``scale``, so that
weights on a grid stay exact), grouped into blocks of bounded size. The driver
holds the shared layers (whose size the layer widths fix), or one block while a
local model is written, and never the table.

Screening embeds each distinct pair once, with both orientations, and deals the
embeddings into slices of bounded size. Blocks that together take ``LANE_BYTES`` are a
lane. Lanes and slices meet in a grid: a slice is copied to every lane and a lane to
every slice (by the two counts, not by rows), both sides are shuffled by the same key
(lane, slice), and a cogroup holds one lane and one slice, which its blocks meet one
by one. It gives the lane's best side effects of each pair of the slice and their
number; what is left per pair are at most ``top`` rows a lane, from which the pair's
ranking follows.

Defined cases: pairs with a missing profile have no rows; a side effect without a
threshold flags nothing; a head stored twice is refused; no heads or no pairs give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .joins import assert_unique
from .scoring import (BLOCK_BYTES, RANKED_SCHEMA, PairModel, _mat, _merge_blocks, _model_block, _rank_rows, load_pair_model,
                      save_pair_model)

HEADS_SCHEMA = "block int, se int, d_se int, d_emb int, scale double, head binary, tail binary, r array<double>"
#: bytes of heads (as stored) that one cogroup meets
LANE_BYTES = 32 << 20
#: pairs of one slice
SLICE = 16_384
#: pairs x side effects of one matrix in a cogroup
CELLS = 2_000_000


def heads_per_block(d_se: int, d_emb: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, block_bytes // (8 * d_se * d_emb + 8 * d_se))


def _packed(block: int, se: int, head: np.ndarray, tail: np.ndarray, r: np.ndarray, scale: float) -> tuple:
    flat = lambda m: np.rint(m / scale).astype(np.float32).tobytes() if scale != 1.0 else m.astype(np.float32).tobytes()
    return block, int(se), head.shape[0], head.shape[1], scale, flat(head), flat(tail), [float(x) for x in r]


def write_heads(spark: SparkSession, blocks: Iterable[tuple], path: str, scale: float = 1.0) -> None:
    """Write heads to ``path`` block by block: ``blocks`` yields (se ids, heads, tails, offsets) and is drawn from one
    at a time. ``scale`` other than 1 says that all weights are multiples of it."""
    mode = "overwrite"
    for k, (ids, heads, tails, r) in enumerate(blocks):
        rows = [_packed(k, *row, scale) for row in zip(ids, heads, tails, r)]
        spark.createDataFrame(rows, HEADS_SCHEMA).coalesce(1).write.mode(mode).parquet(path)
        mode = "append"


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADS_SCHEMA).parquet(path)


def model_blocks(model: PairModel, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    step = heads_per_block(*model.heads.shape[1:], block_bytes)
    for a in range(0, len(model.se_ids), step):
        yield model.se_ids[a:a + step], model.heads[a:a + step], model.tails[a:a + step], model.r[a:a + step]


def save_model_rows(spark: SparkSession, model: PairModel, path: str, block_bytes: int = BLOCK_BYTES,
                    scale: float = 1.0) -> None:
    """The shared layers as ``save_pair_model`` writes them, below ``shared``; the heads as rows below ``heads``."""
    save_pair_model(spark, _model_block(model, 0, 0), f"{path}/shared")
    write_heads(spark, model_blocks(model, block_bytes), f"{path}/heads", scale)


def load_model_rows(spark: SparkSession, path: str) -> tuple[PairModel, DataFrame]:
    """Shared layers (a model without side effects) and the table of heads."""
    return load_pair_model(spark, f"{path}/shared"), read_heads(spark, f"{path}/heads")


def formula_heads(se: DataFrame, d_emb: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Heads by the index rules of ``PairModel.formula``, the side-effect id being the first index; built on the
    executors. All weights are twentieths."""
    step = heads_per_block(d_emb, d_emb, block_bytes)

    def run(batches):
        i, j = np.indices((d_emb, d_emb))
        for pdf in batches:
            rows = []
            for k in pdf["se"]:
                grid = lambda salt: ((3 * k + 7 * i + 13 * j + salt) % 11 - 5) / 20.0
                rows.append(_packed(int(k) // step, k, grid(5), grid(6), ((k + np.arange(d_emb)) % 7 - 3) / 10.0, 0.05))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADS_SCHEMA.split(", ")])

    return se.select(F.col("se").cast("int").alias("se")).distinct().mapInPandas(run, HEADS_SCHEMA)


def _unpacked(heads: pd.DataFrame) -> PairModel:
    """The heads of one block as the per-side-effect part of a model."""
    heads = heads.sort_values("se")
    shape = (len(heads), int(heads["d_se"].iloc[0]), int(heads["d_emb"].iloc[0]))
    scale = heads["scale"].to_numpy()[:, None, None]
    many = lambda c: np.stack([np.frombuffer(b, np.float32) for b in heads[c]]).reshape(shape).astype(float) * scale
    none = {k: None for k in PairModel.__dataclass_fields__ if k not in ("se_ids", "heads", "tails", "r", "extra")}
    return PairModel(**none, se_ids=heads["se"].to_numpy(np.int64), heads=many("head"), tails=many("tail"),
                     r=np.stack(heads["r"].to_numpy()).astype(float))


_EMBEDDED = "drug1 long, drug2 long, e1 binary, e2 binary, f1 binary, f2 binary"


def embed_pairs(pairs_with_vecs: DataFrame, shared: PairModel) -> DataFrame:
    """Embeddings of both orientations of every pair that has both profiles (float64 bytes)."""
    layers = pairs_with_vecs.sparkSession.sparkContext.broadcast(_model_block(shared, 0, 0))
    width = shared.W1.shape[0]

    def run(batches):
        for pdf in batches:
            x1, p1 = _mat(pdf["vec1"], width)
            x2, p2 = _mat(pdf["vec2"], width)
            ok = p1 & p2
            e1, e2, *_ = layers.value.embed(x1[ok], x2[ok])
            f1, f2, *_ = layers.value.embed(x2[ok], x1[ok])
            out = pdf.loc[ok, ["drug1", "drug2"]].copy()
            for name, m in (("e1", e1), ("e2", e2), ("f1", f1), ("f2", f2)):
                out[name] = [row.tobytes() for row in m]
            yield out

    return pairs_with_vecs.select("drug1", "drug2", "vec1", "vec2").mapInPandas(run, _EMBEDDED)


def _screened(top: int):
    def run(key, pairs: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in [*RANKED_SCHEMA.fieldNames(), "lane"]})
        if not len(pairs) or not len(heads):
            return none
        e1, e2, f1, f2 = (np.stack([np.frombuffer(b) for b in pairs[c]]) for c in ("e1", "e2", "f1", "f2"))
        d1, d2 = pairs["drug1"].to_numpy(), pairs["drug2"].to_numpy()
        found = []
        for block, some in heads.groupby("block"):
            some = some.sort_values("se")
            model, th = _unpacked(some), some["optimal_thr"].to_numpy(float)
            step = max(1, CELLS // len(some))
            for a in range(0, len(pairs), step):
                cut = slice(a, a + step)
                sx, sy = model.scores(e1[cut], e2[cut], cells=CELLS), model.scores(f1[cut], f2[cut], cells=CELLS)
                rows = _rank_rows(d1[cut], d2[cut], model.se_ids, sx, sy, th, top)
                if len(rows):
                    found.append(rows.assign(_block=block))
        return _merge_blocks(found, top).assign(lane=key[0]) if found else none

    return run


def screen_by_blocks(pairs_with_vecs: DataFrame, shared: PairModel, heads: DataFrame, thr: DataFrame, top: int) -> DataFrame:
    """``screen_ranked`` (same columns, same rows) for *distinct* pairs, with the heads as a table (``HEADS_SCHEMA``);
    ``thr``: se, optimal_thr."""
    ensure_checkpoint_dir(heads.sparkSession)
    assert_unique(heads, ["se"], "heads")
    limits = thr.select(F.col("se").cast("int").alias("se"), F.col("optimal_thr").cast("double").alias("optimal_thr"))
    heads = heads.join(limits, "se", "left")
    n_slices = max(1, -(-pairs_with_vecs.where("vec1 is not null and vec2 is not null").count() // SLICE))
    # blocks of up to LANE_BYTES together are a lane, which a slice of pairs meets block by block in one cogroup; a slice
    # is sent once per lane, not once per block
    size = F.sum(F.octet_length("head") + F.octet_length("tail") + 8 * F.size("r")).alias("bytes")
    lane, filled = {}, 0
    for r in heads.groupBy("block").agg(size).orderBy("block").collect():  # as many as the weights have 64 MB
        filled += r["bytes"]
        at = max(lane.values(), default=0)
        if lane and filled > LANE_BYTES:
            at, filled = at + 1, r["bytes"]
        lane[r["block"]] = at
    lanes = sorted(set(lane.values()))
    embedded = embed_pairs(pairs_with_vecs, shared)
    pairs = (embedded.withColumn("slice", F.pmod(F.xxhash64("drug1", "drug2"), F.lit(n_slices)).cast("int"))
             .withColumn("lane", F.explode(F.array(*[F.lit(k) for k in lanes]).cast("array<int>"))))
    # each slice gets its own copy of a lane: as many as there are bounded slices
    places = heads.sparkSession.createDataFrame(sorted(lane.items()), "block int, lane int")
    copies = heads.join(F.broadcast(places), "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    part = (pairs.groupBy("lane", "slice").cogroup(copies.groupBy("lane", "slice"))
            .applyInPandas(_screened(top), T.StructType([*RANKED_SCHEMA.fields, T.StructField("lane", T.IntegerType())])))
    if len(lanes) <= 1:
        return part.select(*RANKED_SCHEMA.fieldNames())  # ranked over all blocks already
    pair = Window.partitionBy("drug1", "drug2")
    # each lane repeats its own count on its rows, the first of which has rank 1
    ranked = part.select(
        "drug1", "drug2", "se", "predicted_score_x", "predicted_score_y", "mean_predicted_score", "gap",
        F.row_number().over(pair.orderBy(F.col("gap").desc(), F.col("se"))).alias("rank"),
        F.sum(F.when(F.col("rank") == 1, F.col("total_predicted_reactions"))).over(pair).alias("total_predicted_reactions"))
    return ranked.where(F.col("rank") <= top).select(*RANKED_SCHEMA.fieldNames())
