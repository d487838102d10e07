"""Distributed fits that give the pipeline a trainable form on Spark.

These stand in for the reference's Keras training loops, which are not
rebuilt: they are a different algorithm and are documented as such.

* ``ridge_gram`` / ``ridge_fit`` -- multi-output ridge regression from
  descriptors to expression by the normal equations: every partition forms
  its ``X'X`` and ``X'Y`` in one Arrow batch loop and gives one row, these are
  added up in a tree, and only the ``width x width`` system is solved on the
  driver.
* ``ridge_choose`` -- the penalty by cross-validation. One pass gives the sums of
  every fold; training sums are all folds' less one, and the error on a fold follows
  from its own sums, so no penalty and no fold reads the rows again.
* ``ridge_cg`` -- the same solution without a Gram matrix, for widths whose square
  does not fit: conjugate gradients on passes that add up ``X'(X V)``.
* ``se_translation_fit`` (in ``scoring``) -- the identity-head offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


BUCKETS = 32     # partial matrices meet in so many tasks before the last one adds those up


def column_means(df: DataFrame, col: str) -> np.ndarray:
    """Mean of every position of an array column (one row of numbers)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    got = df.where(F.col(col).isNotNull()).agg(Summarizer.mean(array_to_vector(col)).alias("m")).first()["m"]
    return np.zeros(0) if got is None else got.toArray()


def _with_intercept(X: np.ndarray, intercept: bool) -> np.ndarray:
    return np.hstack([np.ones((X.shape[0], 1)), X]) if intercept else X


def _tree_sum(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up ``rows`` and the arrays ``m`` per key: in ``BUCKETS`` tasks, then in one a key."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    add = [F.sum("rows").alias("rows"), F.max("width").alias("width"), Summarizer.sum(F.col("v")).alias("v")]
    few = parts.select(*keys, "bucket", "rows", "width", array_to_vector("m").alias("v")).groupBy(*keys, "bucket").agg(*add)
    return (few.groupBy(*keys).agg(*add).where("rows is not null")
            .select(*keys, "rows", "width", vector_to_array("v").alias("m")))


def ridge_sums(df: DataFrame, x_col: str, y_col: str | None = None, intercept: bool = True,
               shift: np.ndarray | None = None, fold_col: str | None = None) -> DataFrame:
    """One row (per fold): ``rows``, ``width`` and ``m``, the upper triangle of ``X'X`` followed by ``X'Y`` and, with
    folds, the sum of the squares of Y."""
    cols = [F.col(fold_col).cast("int").alias("fold") if fold_col else F.lit(0).alias("fold"), x_col] + ([y_col] if y_col else [])

    def part(batches):
        from pyspark import TaskContext
        sums: dict[int, list] = {}
        for pdf in batches:
            for fold, rows in pdf.groupby("fold"):
                X = np.stack(rows[x_col].to_numpy()).astype(float)
                X = _with_intercept(X if shift is None else X - shift, intercept)
                got = [len(X), X.T @ X]
                if y_col:
                    Y = np.stack(rows[y_col].to_numpy()).astype(float)
                    got += [X.T @ Y, (Y * Y).sum()]
                sums[fold] = [a + b for a, b in zip(sums[fold], got)] if fold in sums else got
        for fold, got in sums.items():
            flat = [got[1][np.triu_indices(len(got[1]))]] + ([got[2].ravel(), [got[3]]] if y_col else [])
            yield pd.DataFrame({"fold": [fold], "bucket": [TaskContext.get().partitionId() % BUCKETS], "rows": [got[0]],
                                "width": [len(got[1])], "m": [np.concatenate(flat)]})

    parts = df.select(*cols).mapInPandas(part, "fold int, bucket int, rows long, width int, m array<double>")
    return _tree_sum(parts, ["fold"])


def _matrices(width: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``X'X``, ``X'Y`` and the sum of the squares of Y from a row of ``ridge_sums``."""
    m = np.asarray(m)
    tri = width * (width + 1) // 2
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = m[:tri]
    full = full + np.triu(full, 1).T
    return full, m[tri:-1].reshape(width, -1), float(m[-1])


def ridge_gram(df: DataFrame, x_col: str, y_col: str | None = None, intercept: bool = True,
               shift: np.ndarray | None = None) -> DataFrame:
    """Entries of ``X'X`` (``block='xx'``) and ``X'Y`` (``block='xy'``) as
    ``(block, i, j, value, rows)``, summed over all rows (``rows`` = row count). With ``intercept`` a
    leading 1 is added to each x row; ``shift`` is subtracted from every x first."""
    def entries(batches):
        for pdf in batches:
            for n, w, m in zip(pdf["rows"], pdf["width"], pdf["m"]):
                xx, xy, _ = _matrices(int(w), m if y_col else [*m, 0.0])
                for name, block in (("xx", xx), ("xy", xy)):
                    ii, jj = np.indices(block.shape)
                    yield pd.DataFrame({"block": name, "i": ii.ravel().astype(np.int32),
                                        "j": jj.ravel().astype(np.int32), "value": block.ravel(), "rows": int(n)})

    return ridge_sums(df, x_col, y_col, intercept, shift).select("rows", "width", "m").mapInPandas(
        entries, "block string, i int, j int, value double, rows long")


def _solved(xx: np.ndarray, xy: np.ndarray, l2: float, intercept: bool) -> np.ndarray:
    pen = np.eye(len(xx)) * l2
    if intercept:
        pen[0, 0] = 0.0
    return np.linalg.solve(xx + pen, xy)


def ridge_fit(df: DataFrame, x_col: str, y_col: str, l2: float = 0.01, intercept: bool = True) -> np.ndarray:
    """Weights ``W`` (``(1 + width_x) x width_y`` with intercept) minimising
    ``|XW - Y|^2 + l2 |W|^2`` (intercept not penalised). One row of sums reaches the
    driver: about ``(1 + width_x) * (width_x / 2 + width_y)``
    numbers, independent of the number of rows (1.7 M for 1 124 -> 978)."""
    row = ridge_sums(df, x_col, y_col, intercept).first()
    if row is None:
        raise ValueError("no rows to fit")
    xx, xy, _ = _matrices(row["width"], row["m"])
    return _solved(xx, xy, l2, intercept)


def ridge_choose(df: DataFrame, x_col: str, y_col: str, penalties: Sequence[float], fold_col: str = "fold",
                 intercept: bool = True) -> tuple[float, list[tuple[float, float]], np.ndarray]:
    """The penalty with the least mean squared error over the folds (of equals the largest), (penalty, error) of all,
    and the weights that it gives on all rows. The driver holds the sums of each fold."""
    found = ridge_sums(df, x_col, y_col, intercept, fold_col=fold_col).toLocalIterator()
    folds = {r["fold"]: (r["rows"], *_matrices(r["width"], r["m"])) for r in found}
    if len(folds) < 2:
        raise ValueError("two folds are needed at least")
    all_xx, all_xy = sum(f[1] for f in folds.values()), sum(f[2] for f in folds.values())
    cells = sum(f[0] for f in folds.values()) * all_xy.shape[1]
    errors = []
    for l2 in penalties:
        wrong = 0.0
        for _, xx, xy, yy in folds.values():
            W = _solved(all_xx - xx, all_xy - xy, l2, intercept)
            # |Y - XW|^2 of the fold left out
            wrong += yy - 2 * float((W * xy).sum()) + float((W * (xx @ W)).sum())
        errors.append((float(l2), wrong / cells))
    best = min(errors, key=lambda e: (e[1], -e[0]))[0]
    return best, errors, _solved(all_xx, all_xy, best, intercept)


def ridge_cg(df: DataFrame, x_col: str, y_col: str, l2: float = 0.01, intercept: bool = True, passes: int = 500,
             tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """``ridge_fit`` without the Gram matrix: (weights, passes over the rows). Each pass adds up ``X'(X V)`` for the
    search directions ``V`` (as wide as the outputs), scaled by the diagonal; the driver holds a few matrices of the
    size of the weights. Raises when ``passes`` do not bring the residual below ``tol`` of the right side."""
    sc = df.sparkSession.sparkContext

    def added(rows: DataFrame, terms) -> list[np.ndarray]:
        def part(batches):
            from pyspark import TaskContext
            total = None
            for pdf in batches:
                if len(pdf):
                    X = _with_intercept(np.stack(pdf[x_col].to_numpy()).astype(float), intercept)
                    got = terms(X, pdf)
                    total = got if total is None else total + got
            if total is not None:
                yield pd.DataFrame({"bucket": [TaskContext.get().partitionId() % BUCKETS], "rows": [1],
                                    "width": [total.shape[0]], "m": [total.ravel()]})

        row = _tree_sum(rows.mapInPandas(part, "bucket int, rows long, width int, m array<double>"), []).first()
        if row is None:
            raise ValueError("no rows to fit")
        return np.array(row["m"]).reshape(row["width"], -1)

    first = added(df.select(x_col, y_col), lambda X, pdf: np.hstack([
        X.T @ np.stack(pdf[y_col].to_numpy()).astype(float), (X * X).sum(axis=0)[:, None]]))
    target, diagonal = first[:, :-1], first[:, -1:]
    pen = np.full((len(target), 1), l2)
    if intercept:
        pen[0] = 0.0
    scale = np.where(diagonal + pen > 0, diagonal + pen, 1.0)
    W, rest = np.zeros_like(target), target.copy()
    z = rest / scale
    V, power = z.copy(), (rest * z).sum(axis=0)
    size = np.maximum(np.linalg.norm(target, axis=0), 1e-300)
    for done in range(1, passes + 1):
        if (np.linalg.norm(rest, axis=0) <= tol * size).all():
            return W, done
        sent = sc.broadcast(V)
        image = added(df.select(x_col), lambda X, _: X.T @ (X @ sent.value)) + pen * V
        sent.unpersist()
        bend = (V * image).sum(axis=0)
        step = np.where(bend > 0, power / np.where(bend > 0, bend, 1.0), 0.0)
        W, rest = W + step * V, rest - step * image
        z = rest / scale
        new = (rest * z).sum(axis=0)
        V = z + np.where(power > 0, new / np.where(power > 0, power, 1.0), 0.0) * V
        power = new
    raise RuntimeError(f"{passes} passes left a residual of {(np.linalg.norm(rest, axis=0) / size).max():.2g}")


def apply_linear(df: DataFrame, x_col: str, W: np.ndarray, out: str = "pred", intercept: bool = True) -> DataFrame:
    """``x -> [1, x] W`` as an array column. The weights (width_in x width_out, a
    size that the widths fix) are broadcast once and applied per Arrow batch as
    one GEMM."""
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(W, dtype=float))
    fields = list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))]

    def run(batches):
        w = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[x_col].to_numpy()).astype(float)
            if intercept:
                X = np.hstack([np.ones((X.shape[0], 1)), X])
            res = pdf.copy()
            res[out] = list(X @ w)
            yield res

    return df.mapInPandas(run, T.StructType(fields))
