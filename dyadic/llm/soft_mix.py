"""Mixing to target weights with soft domain membership.

A classifier trained on the labelled table gives every document a posterior over
domains. Each document gets a rate r >= 0 (how often to take it) so that the
expected tokens per domain, sum of r x tokens x posterior, match the targets. The
rates solve a nonnegative least-squares problem by projected gradient: every step
is one aggregation of the domain totals over all documents and one column
expression r <- max(0, r - p . g), where g is the residual in the metric of the
domains' second moments (so a step without clamping lands on the targets, and a
step of length one never overshoots). Rates start at 1, so they stay as close to
"take everything once" as the targets let them.

At scale: documents are scored where they are read, no row is shuffled; each step
moves one partial sum per task. The classifier is fitted on at most
``max_labelled`` labelled rows. Rates are written every ``CHUNK`` steps, which
bounds the expression.

Defined cases: a null or wordless text has no tokens, the prior as posterior and a
rate like any other with that posterior; a domain without tokens cannot reach its
target, the others still do; without labelled rows all posteriors are uniform; an
empty table gives an empty result; an input column that is named like a result
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored
from .knn_quality import LAGS, SHAPES, WORD_WEIGHT, WORDS, blocks, labelled_rows, share_rows
from .words import hashed_slices

CHUNK, MAX_STEPS, CLOSE = 10, 60, 1e-6
#: term shares are small numbers; words count in full here
SCALE = np.concatenate([np.full(SHAPES + LAGS, 4.0), np.full(WORDS, 4.0 / WORD_WEIGHT)]).astype(np.float32)


def fit_posteriors(docs: DataFrame, labels: DataFrame, domain: Column, names: list[str], text_col: str = "text",
                   max_labelled: int = 4000, passes: int = 300) -> dict:
    """Multinomial logistic regression on term shares. ``domain``: name of a labelled row's domain, over the columns
    of ``docs`` and ``__label`` (its quality label, whatever ``docs`` has of that name); rows whose domain is not in
    ``names`` teach nothing."""
    chosen = labelled_rows(docs, labels, "quality", max_labelled)
    number = F.coalesce(*[F.when(domain == name, k) for k, name in enumerate(names)])
    docs = docs.drop(*chosen.columns)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).select(
        chosen["__h"].alias("h"), number.alias("label"), docs[text_col].alias("t")).where("label is not null")
    got = rows.mapInArrow(share_rows, "h long, label int, x binary").orderBy("h", "x").limit(max_labelled).collect()
    k = len(names)
    if not got:
        return {"weights": np.zeros((0, k)), "bias": np.zeros(k)}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]) * SCALE
    y = np.eye(k)[[r["label"] for r in got]]
    w, b = np.zeros((x.shape[1], k)), np.log(y.mean(0) + 1e-3)
    step, mw, mb = 0.1, np.zeros((x.shape[1], k)), np.zeros(k)
    for _ in range(passes):  # gradient descent with momentum and a small ridge
        gap = softmax(x @ w + b) - y
        mw = 0.9 * mw + x.T @ gap / len(x) + 1e-4 * w
        mb = 0.9 * mb + gap.mean(0)
        w -= step * mw
        b -= step * mb
    return {"weights": w.astype(np.float32), "bias": b}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def with_posteriors(docs: DataFrame, model: dict, names: list[str], carry: list[str], text_col: str) -> DataFrame:
    """Stored table of the carried columns, n_tokens and one posterior per domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["n_tokens", *[f"p_{d}" for d in names]]
    kept = [c for c in carry if c not in [*added, "rate", "target_miss"]]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType())]
                          + [T.StructField(f"p_{d}", T.DoubleType()) for d in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column(len(kept))
            tokens = np.concatenate([np.zeros(0, np.int64), *[np.diff(f) for *_, f in hashed_slices(text, 4 << 20)]])
            p = [np.zeros((0, len(names)))]
            for _, _, x in blocks(text):
                p.append(softmax(((x * SCALE) @ m["weights"] if len(m["weights"]) else np.zeros((len(x), 1))) + m["bias"]))
            p = np.round(np.vstack(p), 6)
            yield pa.record_batch([*[batch.column(i) for i in range(len(kept))], pa.array(tokens, pa.int64()),
                                   *[pa.array(p[:, k]) for k in range(len(names))]],
                                  names=[*kept, *added])

    text = docs[text_col].alias(free_name(docs, "__text"))
    return stored(docs.select(*kept, text).mapInArrow(run, schema), "posteriors")


def solve_rates(table: DataFrame, names: list[str], targets: dict[str, float]) -> DataFrame:
    """``table`` (n_tokens and posteriors) with the columns rate and target_miss: by how much the share of the domain
    that is furthest from its target misses it (null without tokens). Steps end when that is below ``CLOSE``, and after
    ``MAX_STEPS``; targets that no rates reach leave a greater one."""
    p = [F.col(f"p_{d}") for d in names]
    k = len(names)
    tokens = F.col("n_tokens").cast("double")
    moments = table.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * p[a] * p[b]).alias(f"g{a}_{b}")
                                                    for a in range(k) for b in range(a, k)]).first()
    total = moments["n"] or 0.0
    if not total:
        return table.withColumns({"rate": F.lit(1.0), "target_miss": F.lit(None).cast("double")})
    moment = np.array([[moments[f"g{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)]) / total
    metric = np.linalg.pinv(moment + 1e-12 * np.eye(k), rcond=1e-9)
    wanted = np.array([targets[d] for d in names]) / sum(targets.values())
    rate, base, held = F.lit(1.0), table, free_name(table, "__rate")
    for step in range(MAX_STEPS + 1):
        share = base.agg(*[F.sum(rate * tokens * x).alias(f"y{i}") for i, x in enumerate(p)]).first()
        miss = np.array([share[i] for i in range(k)]) / total - wanted
        if np.abs(miss).max() < CLOSE or step == MAX_STEPS:
            break
        g = metric @ miss
        rate = F.greatest(F.lit(0.0), rate - sum(p[i] * F.lit(float(g[i])) for i in range(k)))
        if step % CHUNK == CHUNK - 1:
            base, rate = stored(base.withColumn(held, rate), "rates"), F.col(held)
    return base.withColumns({"rate": F.round(rate, 6), "target_miss": F.lit(float(np.abs(miss).max()))}).drop(held)


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], carry: list[str] | None = None,
        text_col: str = "text", **fitting) -> DataFrame:
    """The carried columns (default: all) with n_tokens, p_<domain> for every target domain, rate and target_miss."""
    names = list(targets)
    model = fit_posteriors(docs, labels, domain, names, text_col, **fitting)
    table = with_posteriors(docs, model, names, docs.columns if carry is None else carry, text_col)
    return solve_rates(table, names, targets)
