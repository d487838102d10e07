"""Batch scoring with supplied weights.

Two forms of the pair model:

* **identity head** (``H = T = I``, offset ``r`` per side effect, embedding =
  profile): available as column expressions (``identity_score``, used for
  per-row scoring of a pair table) and as the same Arrow-batched kernel as
  the full model (``screen_ranked``) for the screen of pairs against the
  catalogue, where the higher-order array functions would run interpreted per row;
* **full model**: per pair, shared dense + batch norm on each drug, two
  sigmoid gates on the concatenation, gated batch norms, a shared dense
  embedding; per side effect, ``||H e1 + r - T e2|| + ||H e2 + r - T e1||``.
  It runs in ``mapInPandas``: each Arrow batch of pairs becomes one matrix,
  every layer is a GEMM, side effects are processed in blocks, and the
  threshold test happens inside the batch so only flagged rows leave it;
  for a screen of distinct pairs (``screen_ranked``) the per-pair count and
  top-k ranking are done there too.

Weights are inputs (arrays or parquet), never trained here. The per-side-effect
part is shipped as a list of broadcast blocks of ``BLOCK_BYTES`` each, and the
kernels go through the blocks with a running count and top list, so a larger
catalogue means more blocks on the same path; the shared layers are one more
broadcast, whose size the layer widths fix.

The expression predictor (descriptors -> expression profile) is the second
model: fingerprints 1024->512->128, properties 100->128, output ``10 tanh``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import translation_distance
from ..session import default_slices, stored_once
from .joins import HeldProfiles

BN_EPS = 1e-3          # batch-norm epsilon of the reference's layers (library default)
BLOCK_BYTES = 64 << 20     # per-side-effect weights in one broadcast


# ------------------------------------------------------------------ identity head
def identity_score(e1, e2, r) -> "F.Column":
    """``||e1 + r - e2|| + ||e2 + r - e1||`` on array columns."""
    return translation_distance(e1, r, e2) + translation_distance(e2, r, e1)


def se_translation_fit(pairs_with_vecs: DataFrame, label: str = "label") -> DataFrame:
    """Offset per side effect under the identity head: the mean of ``e2 - e1``
    over the positive pairs in canonical orientation (``drug1 < drug2``).

    Element-wise means are a vector ``Summarizer`` aggregate (partial
    aggregation, no explode); rows with a missing profile are skipped.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    pos = pairs_with_vecs.where((F.col(label) == 1) & F.col("vec1").isNotNull() & F.col("vec2").isNotNull())
    lo_first = F.col("drug1") < F.col("drug2")
    diff = F.when(lo_first, F.zip_with("vec2", "vec1", lambda a, b: a - b)) \
        .otherwise(F.zip_with("vec1", "vec2", lambda a, b: a - b))
    d = pos.select("se", array_to_vector(diff).alias("_d"))
    return (d.groupBy("se").agg(Summarizer.mean(F.col("_d")).alias("_m"))
            .select("se", vector_to_array(F.col("_m")).alias("r")))


def se_translation_fit_by_counts(pairs: DataFrame, profile: DataFrame, label: str = "label") -> DataFrame:
    """``se_translation_fit`` without carrying a vector per observation: the mean
    is linear in the vectors, so the +1 / -1 uses of each drug are counted per
    side effect first and every drug's vector is joined once per side effect
    that it occurs with."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from .joins import bounded_broadcast

    have = bounded_broadcast(profile.where(F.col("vec").isNotNull()).select("drug_id"))
    side = lambda c: have.select(F.col("drug_id").alias(c))
    lo_first = F.col("drug1") < F.col("drug2")
    pos = (pairs.where(F.col(label) == 1).join(side("drug1"), "drug1", "left_semi")
           .join(side("drug2"), "drug2", "left_semi")
           .select("se", F.when(lo_first, F.col("drug2")).otherwise(F.col("drug1")).alias("plus"),
                   F.when(lo_first, F.col("drug1")).otherwise(F.col("drug2")).alias("minus")))
    one = F.lit(1).cast("long")
    # at most a row per side effect and drug; read for the sizes and for the vectors
    uses = stored_once(pos.select("se", F.explode(F.array(
        F.struct(F.col("plus").alias("drug_id"), one.alias("w")),
        F.struct(F.col("minus").alias("drug_id"), (-one).alias("w")))).alias("u"))
        .groupBy("se", "u.drug_id").agg(F.sum("u.w").alias("w"), F.count(F.lit(1)).alias("uses")), "uses")
    # every observation counts once on either side
    size = uses.groupBy("se").agg((F.sum("uses") / 2).alias("rows"))
    scaled = (uses.join(profile.select("drug_id", "vec"), "drug_id")
              .select("se", array_to_vector(F.transform("vec", lambda x: x * F.col("w"))).alias("_d")))
    total = scaled.groupBy("se").agg(vector_to_array(Summarizer.sum(F.col("_d"))).alias("_s"))
    return total.join(size, "se").select("se", F.transform("_s", lambda x: x / F.col("rows")).alias("r"))


# ------------------------------------------------------------------- weights
def _bn(rng, n):
    return dict(gamma=1.0 + 0.1 * rng.standard_normal(n), beta=0.1 * rng.standard_normal(n),
                mean=0.1 * rng.standard_normal(n), var=1.0 + 0.1 * rng.random(n))


def _bn_apply(x, p):
    return (x - p["mean"]) / np.sqrt(p["var"] + BN_EPS) * p["gamma"] + p["beta"]


def _elu(x):
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def formula_matrix(salt: int, *shape: int) -> np.ndarray:
    """Weights by a rule on their indices, for checks that another engine can
    repeat: ``((7 i + 13 j + salt) mod 11 - 5) / 20``, a leading third index times 3 more."""
    steps = (7, 13) if len(shape) == 2 else (3, 7, 13)
    total = sum(step * index for step, index in zip(steps, np.indices(shape))) + salt
    return (total % 11 - 5) / 20.0


def formula_bias(salt: int, n: int) -> np.ndarray:
    return ((np.arange(n) + salt) % 5 - 2) / 10.0


def formula_norm(n: int) -> dict:
    j = np.arange(n)
    return dict(gamma=1 + j % 3 / 10.0, beta=(j % 4 - 1) / 10.0, mean=j % 2 / 10.0, var=1 + j % 5 / 10.0)


#: layers of the pair model that ``embed`` returns
OUTPUTS = ("e1", "e2", "s1", "s2", "h1")


@dataclass
class PairModel:
    """Dense weights of the pair model (Keras layout: ``y = x @ W + b``)."""
    W1: np.ndarray
    b1: np.ndarray
    bn1: dict
    G1: np.ndarray
    g1: np.ndarray
    G2: np.ndarray
    g2: np.ndarray
    bn_s1: dict
    bn_s2: dict
    V: np.ndarray
    v: np.ndarray
    bn_e: dict
    se_ids: np.ndarray          # (S,)
    heads: np.ndarray           # (S, E_se, E)
    tails: np.ndarray           # (S, E_se, E)
    r: np.ndarray               # (S, E_se)
    extra: dict = field(default_factory=dict)

    @staticmethod
    def random(seed: int, d_in: int, d_emb: int, se_ids: Sequence[int], d_se: int | None = None) -> "PairModel":
        rng = np.random.default_rng(seed)
        d_se = d_se or d_emb
        s = len(se_ids)
        g = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        return PairModel(
            W1=g(d_in, d_in), b1=0.01 * rng.standard_normal(d_in), bn1=_bn(rng, d_in),
            G1=g(2 * d_in, d_in), g1=0.01 * rng.standard_normal(d_in),
            G2=g(2 * d_in, d_in), g2=0.01 * rng.standard_normal(d_in),
            bn_s1=_bn(rng, d_in), bn_s2=_bn(rng, d_in),
            V=g(d_in, d_emb), v=0.01 * rng.standard_normal(d_emb), bn_e=_bn(rng, d_emb),
            se_ids=np.asarray(sorted(se_ids), dtype=np.int64),
            heads=rng.standard_normal((s, d_se, d_emb)) / np.sqrt(d_emb),
            tails=rng.standard_normal((s, d_se, d_emb)) / np.sqrt(d_emb),
            r=0.1 * rng.standard_normal((s, d_se)))

    @staticmethod
    def formula(d_in: int, d_emb: int, se_ids: Sequence[int]) -> "PairModel":
        """Weights by the index rules above; salts 1 to 6 in the order of the layers."""
        s = len(se_ids)
        return PairModel(
            W1=formula_matrix(1, d_in, d_in), b1=formula_bias(1, d_in), bn1=formula_norm(d_in),
            G1=formula_matrix(2, 2 * d_in, d_in), g1=formula_bias(2, d_in),
            G2=formula_matrix(3, 2 * d_in, d_in), g2=formula_bias(3, d_in),
            bn_s1=formula_norm(d_in), bn_s2=formula_norm(d_in),
            V=formula_matrix(4, d_in, d_emb), v=formula_bias(4, d_emb), bn_e=formula_norm(d_emb),
            se_ids=np.asarray(sorted(se_ids), dtype=np.int64), heads=formula_matrix(5, s, d_emb, d_emb),
            tails=formula_matrix(6, s, d_emb, d_emb),
            r=((np.arange(s)[:, None] + np.arange(d_emb)[None, :]) % 7 - 3) / 10.0)

    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.__dict__.values() if isinstance(v, np.ndarray)) + \
            sum(a.nbytes for d in (self.bn1, self.bn_s1, self.bn_s2, self.bn_e) for a in d.values())

    # -- forward pass on matrices (rows = pairs)
    def embed(self, x1: np.ndarray, x2: np.ndarray, outputs: Sequence[str] = OUTPUTS):
        """The layers named in ``outputs``, in that order; layers that none of them needs are not computed."""
        need = lambda *names: any(n in outputs for n in names)
        of = {"h1": _bn_apply(_elu(x1 @ self.W1 + self.b1), self.bn1)}
        if need("s1", "s2", "e1", "e2"):
            h2 = _bn_apply(_elu(x2 @ self.W1 + self.b1), self.bn1)
            c = np.concatenate([of["h1"], h2], axis=1)
        if need("s1", "e1"):
            of["s1"] = _bn_apply(of["h1"] * _sigmoid(c @ self.G1 + self.g1), self.bn_s1)
        if need("s2", "e2"):
            of["s2"] = _bn_apply(h2 * _sigmoid(c @ self.G2 + self.g2), self.bn_s2)
        for e, s in (("e1", "s1"), ("e2", "s2")):
            if need(e):
                of[e] = _bn_apply(_elu(of[s] @ self.V + self.v), self.bn_e)
        return tuple(of[name] for name in outputs)

    def scores(self, e1: np.ndarray, e2: np.ndarray, block: int | None = None, cells: int = 2_000_000) -> np.ndarray:
        """(P, S) translation scores. Side effects are taken in blocks so that
        each intermediate (pairs x block x head width) stays within ``cells``
        values (about 16 MB each), whatever the Arrow batch size."""
        P, S = e1.shape[0], len(self.se_ids)
        out = np.empty((P, S))
        f_width = self.heads.shape[1] if self.heads.ndim == 3 else 1
        if block is None:
            block = max(1, min(S, cells // max(1, P * f_width)))
        for a in range(0, S, block):
            H, Tt, r = self.heads[a:a + block], self.tails[a:a + block], self.r[a:a + block]
            s, f, e = H.shape
            # one GEMM per side: (P, E) x (E, s*f) -> (P, s, f)
            Hm, Tm = H.reshape(s * f, e).T, Tt.reshape(s * f, e).T
            h1 = (e1 @ Hm).reshape(P, s, f)
            h2 = (e2 @ Hm).reshape(P, s, f)
            t1 = (e1 @ Tm).reshape(P, s, f)
            t2 = (e2 @ Tm).reshape(P, s, f)
            u = h1 + r - t2
            v = h2 + r - t1
            out[:, a:a + block] = np.sqrt(np.einsum("psf,psf->ps", u, u)) + np.sqrt(np.einsum("psf,psf->ps", v, v))
        return out


def _mat(col: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Array column -> (matrix, present mask); missing rows become zeros."""
    present = col.notna().to_numpy()
    m = np.zeros((len(col), width))
    if present.any():
        m[present] = np.stack(col[present].to_numpy())
    return m, present


def list_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``_mat`` of an Arrow list column; missing elements become NaN."""
    present = np.asarray(column.is_valid())
    m = np.zeros((len(column), width))
    if width and present.any():
        if (lengths := column.drop_null().value_lengths().unique().to_pylist()) != [width]:
            raise ValueError(f"vectors of {lengths} values for a model of {width}")
        m[present] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return m, present


def _sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and position-weighted sum (from 1) of each row, added in the order of the positions."""
    total, weighted = np.zeros(len(m)), np.zeros(len(m))
    for i, x in enumerate(m.T):
        total += x
        weighted += x * (i + 1)
    return total, weighted


def pair_embed(pairs_with_vecs: DataFrame, model: PairModel, outputs: Sequence[str] = OUTPUTS, sums: bool = False) -> DataFrame:
    """Per row (drug1, drug2, vec1, vec2): ``e1, e2`` (embeddings), the gated
    profiles ``s1, s2`` and the first hidden layer ``h1``, or those of them that
    ``outputs`` names. With ``sums`` each gives its sum and its position-weighted
    sum (``e1_sum``, ``e1_wsum``) in place of the array, which then never leaves
    the batch. Missing profiles give NULL outputs. Run it on *distinct* pairs,
    never per side effect."""
    spark = pairs_with_vecs.sparkSession
    bc = spark.sparkContext.broadcast(_model_block(model, 0, 0))  # the shared layers
    d_in = model.W1.shape[0]
    keep = [c for c in pairs_with_vecs.columns if c not in ("vec1", "vec2")]
    arr = T.ArrayType(T.DoubleType())
    added = [(f"{n}{end}", T.DoubleType()) for n in outputs for end in ("_sum", "_wsum")] if sums else [(n, arr) for n in outputs]
    out_schema = T.StructType([f for f in pairs_with_vecs.schema.fields if f.name in keep] +
                              [T.StructField(n, kind) for n, kind in added])

    def run(batches):
        m = bc.value
        for pdf in batches:
            x1, p1 = _mat(pdf["vec1"], d_in)
            x2, p2 = _mat(pdf["vec2"], d_in)
            ok = p1 & p2
            res = pdf[keep].copy()
            for name, mat in zip(outputs, m.embed(x1, x2, outputs)):
                if sums:
                    for end, total in zip(("_sum", "_wsum"), _sums(mat)):
                        res[name + end] = pd.Series(total, index=res.index, dtype="Float64").mask(~ok)
                else:
                    res[name] = [r if k else None for r, k in zip(mat, ok)]
            yield res

    return pairs_with_vecs.mapInPandas(run, out_schema)


def se_blocks(n_se: int, per_se_bytes: int) -> list[tuple[int, int]]:
    """Contiguous ranges of side effects whose weights take about ``BLOCK_BYTES`` each."""
    step = max(1, BLOCK_BYTES // max(1, per_se_bytes))
    return [(a, min(n_se, a + step)) for a in range(0, n_se, step)]


def _model_block(model: PairModel, a: int, b: int) -> PairModel:
    return PairModel(**{**model.__dict__, "se_ids": model.se_ids[a:b], "heads": model.heads[a:b],
                        "tails": model.tails[a:b], "r": model.r[a:b]})


def identity_params(r_table: DataFrame, thr: DataFrame | None):
    """Offsets (and thresholds) of the identity head per side effect, in se
    order, streamed to the driver partition by partition: a model's worth of
    numbers, one row per side effect."""
    t = r_table.select("se", "r").where(F.col("r").isNotNull())
    t = t.join(thr.select("se", "optimal_thr"), "se", "left") if thr is not None else t.withColumn(
        "optimal_thr", F.lit(None).cast("double"))
    rows = sorted(((r["se"], np.array(r["r"], dtype=float), r["optimal_thr"]) for r in t.toLocalIterator()),
                  key=lambda r: r[0])
    se = np.array([r[0] for r in rows], dtype=np.int64)
    R = np.stack([r[1] for r in rows]) if rows else np.zeros((0, 0))
    th = np.array([np.nan if r[2] is None else r[2] for r in rows], dtype=float)
    return se, R, th


def _blocks(spark: SparkSession, se_ids: np.ndarray, R: np.ndarray | None, model: PairModel | None,
            thr: np.ndarray | None):
    """Broadcasts of the shared layers (None for the identity head) and of each
    block of (se ids, offsets or model part, thresholds)."""
    sc = spark.sparkContext
    n = len(se_ids)
    size = (R.nbytes if model is None else model.heads.nbytes + model.tails.nbytes + model.r.nbytes) // max(1, n) + 16
    cut = lambda x, a, b: None if x is None else x[a:b]
    parts = [(se_ids[a:b], cut(R, a, b), None if model is None else _heads(model, a, b), cut(thr, a, b))
             for a, b in se_blocks(n, size)]
    shared = None if model is None else sc.broadcast(_model_block(model, 0, 0))
    return shared, [sc.broadcast(p) for p in parts]


def _heads(model: PairModel, a: int, b: int) -> PairModel:
    """Only the per-side-effect part of a range of side effects."""
    none = {k: None for k in model.__dict__ if k not in ("se_ids", "heads", "tails", "r", "extra")}
    return PairModel(**none, se_ids=model.se_ids[a:b], heads=model.heads[a:b], tails=model.tails[a:b], r=model.r[a:b])


def score_rows_full(rows_with_vecs: DataFrame, model: PairModel) -> DataFrame:
    """Score each row's *own* side effect with the full model, both
    orientations in one pass: adds ``score_fwd`` (drug1, drug2) and
    ``score_rev`` (drug2, drug1). Inside an Arrow batch the rows are sorted by
    side effect once and each run is one GEMM against that head. Rows with a
    missing profile or an unknown side effect get NULL scores."""
    shared, parts = _blocks(rows_with_vecs.sparkSession, model.se_ids, None, model, None)
    d_in = model.W1.shape[0]
    keep = [c for c in rows_with_vecs.columns if c not in ("vec1", "vec2")]
    schema = T.StructType([f for f in rows_with_vecs.schema.fields if f.name in keep] +
                          [T.StructField("score_fwd", T.DoubleType()), T.StructField("score_rev", T.DoubleType())])

    def run(batches):
        m = shared.value
        for pdf in batches:
            x1, p1 = _mat(pdf["vec1"], d_in)
            x2, p2 = _mat(pdf["vec2"], d_in)
            fwd = np.full(len(pdf), np.nan)
            rev = np.full(len(pdf), np.nan)
            se = pdf["se"].fillna(-1).to_numpy().astype(np.int64)
            ok = np.flatnonzero(p1 & p2)
            ok = ok[np.argsort(se[ok], kind="stable")]
            if len(ok):
                a1, a2, *_ = m.embed(x1[ok], x2[ok])
                b1, b2, *_ = m.embed(x2[ok], x1[ok])
                begin = np.flatnonzero(np.concatenate([[True], se[ok][1:] != se[ok][:-1]]))
                for part in parts:
                    ids, _, heads, _ = part.value
                    at = np.searchsorted(ids, se[ok][begin])
                    for lo, hi, k in zip(begin, np.append(begin[1:], len(ok)), at):
                        if k < len(ids) and ids[k] == se[ok[lo]]:
                            one = _heads(heads, k, k + 1)
                            fwd[ok[lo:hi]] = one.scores(a1[lo:hi], a2[lo:hi])[:, 0]
                            rev[ok[lo:hi]] = one.scores(b1[lo:hi], b2[lo:hi])[:, 0]
            res = pdf[keep].copy()
            res["score_fwd"] = pd.array(np.where(np.isnan(fwd), None, fwd), dtype="Float64")
            res["score_rev"] = pd.array(np.where(np.isnan(rev), None, rev), dtype="Float64")
            yield res

    return rows_with_vecs.mapInPandas(run, schema)


#: observations in one slice of pairs, and in one list of a pair's observations, at most
SLICE_ROWS, LIST_ROWS = 1_000_000, 512


def score_observations(rows: DataFrame, profile: DataFrame, se_ids: np.ndarray | None = None, R: np.ndarray | None = None,
                       model: PairModel | None = None) -> DataFrame:
    """Score observed rows (``drug1, drug2, se`` and others) with the full ``model`` or the identity head ``R`` of
    ``se_ids``: adds ``score_fwd`` and ``score_rev`` (drugs swapped).

    Vectors are carried per distinct pair, never per observation: the rows are dealt by pair once, a pair is looked up and
    embedded with the list of its rows (a pair of more than ``LIST_ROWS`` has several lists), and the rows leave the batch
    with their scores. Rows with a missing profile or an unknown side effect get NULL scores."""
    from .joins import profile_lookup
    rows = stored_once(rows, "observations")  # counted, then dealt
    se_ids = model.se_ids if model is not None else np.asarray(se_ids)
    order = np.argsort(se_ids, kind="stable")
    if model is None:
        se_ids, R = se_ids[order], (R[order] if len(order) else R)
    else:
        model = PairModel(**{**model.__dict__, "se_ids": se_ids[order], "heads": model.heads[order],
                             "tails": model.tails[order], "r": model.r[order]})
        se_ids = model.se_ids
    shared, parts = _blocks(rows.sparkSession, se_ids, R, model, None)
    width = model.W1.shape[0] if model is not None else (R.shape[1] if R.size else 0)
    schema = T.StructType([*rows.schema.fields, T.StructField("score_fwd", T.DoubleType()), T.StructField("score_rev", T.DoubleType())])
    others = [c for c in rows.columns if c not in ("drug1", "drug2")]
    both = F.col("drug1").isNotNull() & F.col("drug2").isNotNull()
    slices = max(default_slices(rows.sparkSession), -(-rows.count() // SLICE_ROWS))
    place = F.row_number().over(Window.partitionBy("drug1", "drug2").orderBy("se")) - 1
    lists = (rows.where(both).repartition(slices, "drug1", "drug2").withColumn("_list", F.floor(place / LIST_ROWS))
             .groupBy("drug1", "drug2", "_list").agg(F.collect_list(F.struct(*others)).alias("obs")).drop("_list"))

    def scores(x1, x2, at, se):
        """Scores of observations: the row ``at`` of their pair's vectors, and ``se``."""
        fwd, rev = np.full(len(se), np.nan), np.full(len(se), np.nan)
        if not len(se):
            return fwd, rev
        if shared is not None:
            e1, e2 = shared.value.embed(x1, x2, ("e1", "e2"))
            f1, f2 = shared.value.embed(x2, x1, ("e1", "e2"))
        by = np.argsort(se, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], se[by][1:] != se[by][:-1]]))
        for part in parts:
            ids, offsets, heads, _ = part.value
            place = np.searchsorted(ids, se[by][begin])
            for lo, hi, k in zip(begin, np.append(begin[1:], len(se)), place):
                if k < len(ids) and ids[k] == se[by[lo]]:
                    to = by[lo:hi]
                    a = at[to]
                    if heads is None:
                        gap = x2[a] - x1[a]
                        fwd[to] = rev[to] = np.linalg.norm(offsets[k] - gap, axis=1) + np.linalg.norm(offsets[k] + gap, axis=1)
                    else:
                        one = _heads(heads, k, k + 1)
                        fwd[to] = one.scores(e1[a], e2[a])[:, 0]
                        rev[to] = one.scores(f1[a], f2[a])[:, 0]
        return fwd, rev

    def run(batches):
        for batch in batches:
            x1, p1 = list_matrix(batch.column("vec1"), width)
            x2, p2 = list_matrix(batch.column("vec2"), width)
            obs = batch.column("obs")
            at = np.repeat(np.arange(len(obs)), obs.value_lengths().to_numpy())
            flat = obs.flatten()
            cols = dict(zip(others, flat.flatten()))
            known = (p1 & p2)[at] & np.asarray(cols["se"].is_valid())
            fwd, rev = np.full(len(at), np.nan), np.full(len(at), np.nan)
            se = cols["se"].drop_null().to_numpy().astype(np.int64)[known[np.asarray(cols["se"].is_valid())]]
            fwd[known], rev[known] = scores(x1, x2, at[known], se)
            cols |= {c: batch.column(c).take(pa.array(at)) for c in ("drug1", "drug2")}
            cols |= {"score_fwd": pa.array(fwd, mask=np.isnan(fwd)), "score_rev": pa.array(rev, mask=np.isnan(fwd))}
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    scored = profile_lookup(lists, profile).mapInArrow(run, schema)
    none = F.lit(None).cast("double")
    return scored.unionByName(rows.where(~both).select("*", none.alias("score_fwd"), none.alias("score_rev")))


RANKED_SCHEMA = T.StructType([
    T.StructField("drug1", T.LongType()), T.StructField("drug2", T.LongType()), T.StructField("se", T.IntegerType()),
    T.StructField("predicted_score_x", T.DoubleType()), T.StructField("predicted_score_y", T.DoubleType()),
    T.StructField("mean_predicted_score", T.DoubleType()), T.StructField("gap", T.DoubleType()),
    T.StructField("rank", T.IntegerType()), T.StructField("total_predicted_reactions", T.LongType())])


def _rank_rows(d1, d2, se_ids, sx, sy, th, top):
    """Per pair (row): flagged side effects (``mean < thr``), their count, and
    the ``top`` largest gaps (ties: lower se id first, the columns being in se
    order)."""
    mean = (sx + sy) / 2
    with np.errstate(invalid="ignore"):
        flag = mean < th[None, :]
    gap = np.abs(mean - th[None, :])
    total = flag.sum(axis=1)
    key = np.where(flag, gap, -np.inf)
    k = min(top, key.shape[1])
    order = np.argsort(-key, axis=1, kind="stable")[:, :k]
    P = key.shape[0]
    pi = np.repeat(np.arange(P), k)
    si = order.ravel()
    rk = np.tile(np.arange(1, k + 1, dtype=np.int32), P)
    keep = flag[pi, si]
    pi, si, rk = pi[keep], si[keep], rk[keep]
    return pd.DataFrame({"drug1": d1[pi], "drug2": d2[pi], "se": se_ids[si].astype(np.int32),
                         "predicted_score_x": sx[pi, si], "predicted_score_y": sy[pi, si],
                         "mean_predicted_score": mean[pi, si], "gap": gap[pi, si], "rank": rk,
                         "total_predicted_reactions": total[pi].astype(np.int64)})


def _merge_blocks(found: list[pd.DataFrame], top: int) -> pd.DataFrame:
    """Ranked rows of several blocks of side effects as one ranking per pair."""
    rows = pd.concat(found, ignore_index=True)
    pair = ["drug1", "drug2"]
    # each block repeats its own count on its rows
    blocks = rows.groupby([*pair, "_block"], sort=False)["total_predicted_reactions"].first()
    total = blocks.groupby(pair, sort=False).sum().rename("total_predicted_reactions").reset_index()
    rows = rows.drop(columns=["total_predicted_reactions", "_block"]).sort_values(
        [*pair, "gap", "se"], ascending=[True, True, False, True], kind="stable")
    rows["rank"] = (rows.groupby(pair, sort=False).cumcount() + 1).astype(np.int32)
    return rows[rows["rank"] <= top].merge(total, on=pair)[RANKED_SCHEMA.fieldNames()]


def screen_ranked(pairs_with_vecs: DataFrame, thr: np.ndarray, top: int, se_ids: np.ndarray | None = None,
                  R: np.ndarray | None = None, model: PairModel | None = None,
                  cells: int = 4_000_000, held: HeldProfiles | None = None) -> DataFrame:
    """Screen of *distinct* pairs with the ranking done in the kernel: each
    pair is embedded once and scored against the whole catalogue (identity head
    ``R`` or the full ``model``), block of side effects by block, inside one
    task, so its flagged count and its top ``top`` side effects are final there
    -- only those rows leave the batch and no ranking shuffle follows. ``thr`` is
    aligned with the catalogue order (ascending se). Rows are processed in
    chunks so the pair x block matrices stay within ``cells`` values. With
    ``held`` profiles the pairs bear no vectors (``vec1``, ``vec2``); the kernel
    looks them up."""
    if model is not None:
        se_ids = model.se_ids
        width = model.W1.shape[0]
    else:
        width = R.shape[1] if R.size else 0
    shared, parts = _blocks(pairs_with_vecs.sparkSession, se_ids, R, model, thr)

    def identity_scores(x1, x2, Rm):
        S = Rm.shape[0]
        sx = np.empty((x1.shape[0], S))
        sy = np.empty((x1.shape[0], S))
        step = max(1, cells // max(1, x1.shape[0] * max(1, Rm.shape[1])))
        for a in range(0, S, step):
            r = Rm[a:a + step][None, :, :]
            u = x1[:, None, :] + r - x2[:, None, :]
            v = x2[:, None, :] + r - x1[:, None, :]
            du = np.sqrt(np.einsum("psd,psd->ps", u, u))
            dv = np.sqrt(np.einsum("psd,psd->ps", v, v))
            sx[:, a:a + step] = du + dv
            sy[:, a:a + step] = dv + du
        return sx, sy

    def run(batches):
        for pdf in batches:
            if held is not None:
                # an absent id has no profile
                known = (pdf["drug1"].notna() & pdf["drug2"].notna()).to_numpy()
                pdf = pdf[known] if parts else pdf[:0]
                (x1, p1), (x2, p2) = (held.matrix(pdf[c].to_numpy().astype(np.int64), width) for c in ("drug1", "drug2"))
            else:
                x1, p1 = _mat(pdf["vec1"], width)
                x2, p2 = _mat(pdf["vec2"], width)
            ok = p1 & p2
            if not ok.any() or not parts:
                continue
            x1, x2 = x1[ok], x2[ok]
            d1 = pdf["drug1"].to_numpy()[ok]
            d2 = pdf["drug2"].to_numpy()[ok]
            chunk = max(1, cells // max(len(p.value[0]) for p in parts))
            for c in range(0, x1.shape[0], chunk):
                a1, a2 = x1[c:c + chunk], x2[c:c + chunk]
                if shared is not None:
                    e1, e2, *_ = shared.value.embed(a1, a2)
                    f1, f2, *_ = shared.value.embed(a2, a1)
                found = []
                for k, part in enumerate(parts):
                    ids, Rm, heads, th = part.value
                    sx, sy = (identity_scores(a1, a2, Rm) if heads is None
                              else (heads.scores(e1, e2), heads.scores(f1, f2)))
                    rows = _rank_rows(d1[c:c + chunk], d2[c:c + chunk], ids, sx, sy, th, top)
                    if len(rows):
                        found.append(rows.assign(_block=k))
                if found:
                    yield (found[0][RANKED_SCHEMA.fieldNames()] if len(parts) == 1 else _merge_blocks(found, top))

    vecs = [] if held is not None else ["vec1", "vec2"]
    return pairs_with_vecs.select("drug1", "drug2", *vecs).mapInPandas(run, RANKED_SCHEMA)


# -------------------------------------------------------- expression predictor
@dataclass
class FeatureModel:
    """Descriptor -> expression predictor (variant 'both', 'fp' or 'props')."""
    variant: str
    layers_fp: list            # [(W, b, bn), ...] hidden layers on fingerprints
    layers_pr: list            # hidden layers on properties
    W_out: np.ndarray
    b_out: np.ndarray

    @staticmethod
    def random(seed: int, n_fp: int, n_props: int, n_out: int, variant: str = "both",
               hidden_fp=(512, 128), hidden_pr=(128,)) -> "FeatureModel":
        rng = np.random.default_rng(seed)

        def stack(n_in, hidden):
            out, d = [], n_in
            for h in hidden:
                out.append((rng.standard_normal((d, h)) / np.sqrt(d), 0.01 * rng.standard_normal(h), _bn(rng, h)))
                d = h
            return out, d
        lf, dfp = stack(n_fp, hidden_fp) if variant in ("both", "fp") else ([], 0)
        lp, dpr = stack(n_props, hidden_pr) if variant in ("both", "props") else ([], 0)
        d = dfp + dpr
        return FeatureModel(variant, lf, lp, rng.standard_normal((d, n_out)) / np.sqrt(d),
                            0.01 * rng.standard_normal(n_out))

    @staticmethod
    def formula(n_fp: int, n_props: int, n_out: int, variant: str = "both", hidden_fp=(12, 6),
                hidden_pr=(6,)) -> "FeatureModel":
        """Weights by the index rules; salts 1, 2 .. on fingerprints, 11 .. on properties, 21 on the output."""
        def stack(n_in, hidden, salt):
            out, d = [], n_in
            for k, h in enumerate(hidden):
                out.append((formula_matrix(salt + k, d, h), formula_bias(salt + k, h), formula_norm(h)))
                d = h
            return out, d
        lf, dfp = stack(n_fp, hidden_fp, 1) if variant in ("both", "fp") else ([], 0)
        lp, dpr = stack(n_props, hidden_pr, 11) if variant in ("both", "props") else ([], 0)
        return FeatureModel(variant, lf, lp, formula_matrix(21, dfp + dpr, n_out), formula_bias(21, n_out))

    def nbytes(self) -> int:
        return sum(W.nbytes + b.nbytes for W, b, _ in self.layers_fp + self.layers_pr) + self.W_out.nbytes

    def predict(self, fp: np.ndarray | None, props: np.ndarray | None) -> np.ndarray:
        parts = []
        for x, layers in ((fp, self.layers_fp), (props, self.layers_pr)):
            if not layers:
                continue
            h = x
            for W, b, bn in layers:
                h = _bn_apply(np.maximum(h @ W + b, 0.0), bn)
            parts.append(h)
        z = np.concatenate(parts, axis=1) @ self.W_out + self.b_out
        return 10.0 * np.tanh(z)


def predict_expression(desc: DataFrame, model: FeatureModel, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``desc`` has ``fp`` and ``desc`` array columns (see ``reshape.split_*``);
    adds ``pred`` (array of doubles in [-10, 10])."""
    spark = desc.sparkSession
    bc = spark.sparkContext.broadcast(model)
    keep = list(keep)
    schema = T.StructType([f for f in desc.schema.fields if f.name in keep] +
                          [T.StructField("pred", T.ArrayType(T.DoubleType()))])
    cols = keep + [c for c in ("fp", "desc") if c in desc.columns]

    def run(batches):
        m = bc.value
        for pdf in batches:
            fp = np.stack(pdf["fp"].to_numpy()) if m.layers_fp else None
            pr = np.stack(pdf["desc"].to_numpy()) if m.layers_pr else None
            out = m.predict(fp, pr)
            res = pdf[keep].copy()
            res["pred"] = list(out)
            yield res

    return desc.select(*cols).mapInPandas(run, schema)


def load_pair_model(spark: SparkSession, path: str) -> PairModel:
    """Read pair-model weights written by ``save_pair_model`` (parquet: one
    row per tensor, name + shape + flat values). Weights are parameters of
    the catalogue's size, read on the driver once and broadcast."""
    # one tensor at a time: the driver holds the model once, not the rows beside it
    t = {r["name"]: np.asarray(r["values"], dtype=float).reshape(r["shape"])
         for r in spark.read.parquet(path).toLocalIterator()}
    bn = lambda p: {k: t[f"{p}.{k}"] for k in ("gamma", "beta", "mean", "var")}
    return PairModel(W1=t["W1"], b1=t["b1"], bn1=bn("bn1"), G1=t["G1"], g1=t["g1"], G2=t["G2"], g2=t["g2"],
                     bn_s1=bn("bn_s1"), bn_s2=bn("bn_s2"), V=t["V"], v=t["v"], bn_e=bn("bn_e"),
                     se_ids=t["se_ids"].astype(np.int64), heads=t["heads"], tails=t["tails"], r=t["r"])


def save_pair_model(spark: SparkSession, model: PairModel, path: str) -> None:
    rows = []
    for k, v in model.__dict__.items():
        if isinstance(v, np.ndarray):
            rows.append((k, list(v.shape), v.astype(float).ravel().tolist()))
        elif isinstance(v, dict) and k != "extra":
            for kk, vv in v.items():
                rows.append((f"{k}.{kk}", list(vv.shape), vv.astype(float).ravel().tolist()))
    schema = "name string, shape array<int>, values array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
