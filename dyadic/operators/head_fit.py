"""Heads, tails and offsets of side effects by alternating least squares.

For every side effect the fit minimises, over its positive pairs (e1, e2),

    sum w |H e1 + r - T e2|^2  +  l2 (|H - I|^2 + |T - I|^2)

(without the pull towards the identity, zero would fit everything). With T fixed, H and
r follow from one linear system, and with these fixed, T from another; each half step
is an exact minimum, so the objective never rises.

Both systems, and the objective, only need the sums of z z' with z = (e1, e2, 1). They
are taken in one pass: a task adds up its own pairs per side effect and hands the sums
on (early, when they take much memory), they meet in ``BUCKETS`` tasks per side effect
and then in one, so a side effect with a third of all pairs is spread over all tasks
like any other. The alternation runs on the sums, a side effect a row, on the
executors, and gives rows of ``heads.HEADS_SCHEMA``; the driver holds nothing.

Defined cases: pairs without label 1, side effect or one of the embeddings teach
nothing; repeated pairs count as often as they occur; a side effect with few pairs
stays near the identity; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import BUCKETS
from .heads import HEADS_SCHEMA, _packed, heads_per_block

#: sums that a task holds before it hands them on
HELD_BYTES = 64 << 20


def pair_sums(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Per side effect ``n`` (weighted pairs), ``width`` and ``m``, the upper triangle of the summed z z'; ``pairs`` has
    se, e1 and e2 (arrays of doubles)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = pairs.where(F.col("se").isNotNull() & F.col("e1").isNotNull() & F.col("e2").isNotNull()).select(
        F.col("se").cast("int").alias("se"), "e1", "e2", w.alias("w"))

    def part(batches):
        from pyspark import TaskContext
        bucket = TaskContext.get().partitionId() % BUCKETS
        sums: dict[int, np.ndarray] = {}

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame({"se": list(sums), "bucket": bucket, "width": [len(s) for s in sums.values()],
                                "m": [s[np.triu_indices(len(s))] for s in sums.values()]})
            sums.clear()
            return out

        for pdf in batches:
            for se, at in pdf.groupby("se", sort=False).indices.items():
                z = np.hstack([np.stack(pdf["e1"].to_numpy()[at]), np.stack(pdf["e2"].to_numpy()[at]), np.ones((len(at), 1))])
                got = z.T @ (z * pdf["w"].to_numpy()[at][:, None])
                sums[se] = sums[se] + got if se in sums else got
                if len(sums) * got.nbytes > HELD_BYTES:
                    yield handed_on()
        if sums:
            yield handed_on()

    parts = rows.mapInPandas(part, "se int, bucket int, width int, m array<double>")
    add = [F.max("width").alias("width"), Summarizer.sum(F.col("v")).alias("v")]
    few = parts.select("se", "bucket", "width", array_to_vector("m").alias("v")).groupBy("se", "bucket").agg(*add)
    total = few.groupBy("se").agg(*add).select("se", "width", vector_to_array("v").alias("m"))
    return total.select("se", F.element_at("m", -1).alias("n"), "width", "m")


def alternate(s: np.ndarray, l2: float, sweeps: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Head, tail, offset and the objective after each sweep (the first entry: at the identity) from the sums of z z'."""
    d = (len(s) - 1) // 2
    one = np.eye(d)
    x = [*range(d), 2 * d]                      # (e1, 1)
    y = list(range(d, 2 * d))                   # e2
    sxx, syy, sxy = s[np.ix_(x, x)], s[np.ix_(y, y)], s[np.ix_(x, y)]
    pull = np.diag([l2] * d + [0.0])
    toward = np.vstack([l2 * one, np.zeros((1, d))])
    # the offset is free: without pairs it is 0
    left, right = sxx + pull + np.diag([0.0] * d + [1e-12]), syy + l2 * one
    h, r, t = one, np.zeros(d), one

    def objective() -> float:
        a = np.hstack([h, r[:, None]])
        loss = np.sum((a @ sxx) * a) - 2 * np.sum((a @ sxy) * t) + np.sum((t @ syy) * t)
        return float(max(loss, 0.0) + l2 * (np.sum((h - one) ** 2) + np.sum((t - one) ** 2)))

    history = [objective()]
    for _ in range(sweeps):
        a = np.linalg.solve(left, sxy @ t.T + toward).T
        h, r = a[:, :d], a[:, d]
        t = np.linalg.solve(right, sxy.T @ np.hstack([h, r[:, None]]).T + l2 * one).T
        history.append(objective())
        if history[-2] - history[-1] <= tol * max(history[0], 1e-300):
            break
    return h, t, r, history


FITTED = HEADS_SCHEMA + ", n double, objective array<double>"


def fit_heads(pairs: DataFrame, l2: float = 1.0, sweeps: int = 50, tol: float = 1e-9, weight: str | None = None,
              label: str | None = None) -> DataFrame:
    """One row per side effect (``HEADS_SCHEMA``, with the weighted pairs ``n`` and the ``objective`` by sweep)."""
    if label:
        pairs = pairs.where(F.col(label) == 1)

    def run(batches):
        for pdf in batches:
            rows = []
            for se, n, width, m in zip(pdf["se"], pdf["n"], pdf["width"], pdf["m"]):
                s = np.zeros((width, width))
                s[np.triu_indices(width)] = m
                s += np.triu(s, 1).T
                h, t, r, history = alternate(s, l2, sweeps, tol)
                rows.append((*_packed(int(se) // heads_per_block(len(h), len(h)), se, h, t, r, 1.0), float(n), history))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FITTED.split(", ")])

    return pair_sums(pairs, weight).mapInPandas(run, FITTED)
