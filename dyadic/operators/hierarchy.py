"""Divisive clustering of rows by correlation: a tree with a height and a split order per node.

Rows are centred and scaled to unit length, so squared distances are twice the
correlation distance. The height of a node is its scatter (the sum of squared
distances of its rows from their mean), which never rises from a node to its
children. The leaf with the greatest height is split next, until there are
``leaves``: its rows go to either side of the mean along their principal axis.

The axis comes from subspace iteration without a matrix: an iteration is one pass that
adds up ``(y . v) y`` over the centred rows of all nodes whose split is not known yet,
for a few vectors v each, so a round of the tree costs ``PASSES`` passes at most
however many nodes it has, and only these vectors reach the driver. Hot nodes and
groups of copies are sums like all others; no group of rows ever meets in a task.

Deterministic whatever the partitioning: contributions are rounded to multiples of
``1 / UNIT`` and added as integers, the first vectors are the positions of greatest
variance, and axes point to the side of their greatest component.

Defined cases: missing elements count as 0; rows without a direction (null, or all
elements equal) have no path and no cluster; equal rows share a leaf, so there may be
fewer leaves than asked for; ids may repeat; an empty table gives an empty tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import fill_zero, with_centre_unit
from ..session import ensure_checkpoint_dir

UNIT = float(1 << 28)
BUCKETS = 32
#: passes over the rows for the axes of a round, and vectors of the subspace that they turn
PASSES, VECTORS = 6, 8
#: heights at or below are those of equal rows
LEAST = 1e-6


@dataclass
class Node:
    path: str                   # '' is the root, then 0 or 1 a split
    n: int
    total: np.ndarray           # sum of its rows
    squares: np.ndarray         # sum of their squared elements

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def height(self) -> float:
        return float(self.squares.sum() - self.total @ self.total / self.n)


@dataclass
class Tree:
    rows: DataFrame             # id columns, path, cluster (leaves numbered by path)
    nodes: DataFrame            # path, n, height, split_order (from 1, the root; null: leaf), cluster (null: split)


def _added(rows: DataFrame, paths: list[str], terms: Callable[[np.ndarray, int], np.ndarray]) -> dict[str, np.ndarray]:
    """Per path, the sum of ``terms(rows, number of the path)`` as integers; row counts come first."""
    where = {p: k for k, p in enumerate(paths)}

    def part(batches):
        from pyspark import TaskContext
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            at = pdf["path"].map(where)
            for k in at.dropna().unique():
                x = np.stack(pdf["u"][at == k].to_numpy())
                got = np.concatenate([[len(x)], np.rint(terms(x, int(k)) * UNIT).astype(np.int64).sum(axis=0)])
                sums[int(k)] = sums[int(k)] + got if int(k) in sums else got
        if sums:
            yield pd.DataFrame({"bucket": TaskContext.get().partitionId() % BUCKETS, "k": list(sums), "v": list(sums.values())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    parts = rows.select("path", "u").where(F.col("path").isin(paths)).mapInPandas(part, "bucket int, k int, v array<long>")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("bucket", "k").applyInPandas(add, "k int, v array<long>").collect():
        v = np.array(r["v"], np.int64)
        out[paths[r["k"]]] = out[paths[r["k"]]] + v if paths[r["k"]] in out else v
    return out


def _nodes(rows: DataFrame, paths: list[str]) -> list[Node]:
    sums = _added(rows, paths, lambda x, _: np.hstack([x, x * x]))
    out = []
    for path, v in sorted(sums.items()):
        total, squares = np.split(v[1:] / UNIT, 2)
        out.append(Node(path, int(v[0]), total, squares))
    return out


def _along(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Row-wise dot products whose bits do not depend on the rows beside them."""
    return (x * axis).sum(axis=1)


def first_basis(variance: np.ndarray) -> np.ndarray:
    """Unit vectors at the positions of greatest variance, as columns."""
    most = np.argsort(-variance, kind="stable")[:VECTORS]
    return np.eye(len(variance))[:, most]


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best axis within an orthonormal basis whose image under the scatter is given, and the next basis."""
    axis = basis @ np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)[1][:, -1]
    axis = axis if axis[np.argmax(np.abs(axis))] > 0 else -axis
    return axis, np.linalg.qr(image)[0]


def _axes(rows: DataFrame, nodes: list[Node]) -> list[np.ndarray]:
    """Principal axis of each node's rows around their mean."""
    means = [n.mean for n in nodes]
    bases = [first_basis(n.squares / n.n - n.mean ** 2) for n in nodes]
    axes: list[np.ndarray | None] = [None] * len(nodes)
    open_ = list(range(len(nodes)))
    for _ in range(PASSES):
        kept, shift = [bases[k] for k in open_], [means[k] for k in open_]

        def images(x: np.ndarray, j: int) -> np.ndarray:
            y = x - shift[j]
            return np.hstack([y * _along(y, v)[:, None] for v in kept[j].T])

        sums = _added(rows, [nodes[k].path for k in open_], images)
        still = []
        for k in open_:
            image = sums[nodes[k].path][1:].reshape(bases[k].shape[::-1]).T / UNIT
            new, bases[k] = ritz(bases[k], image)
            if axes[k] is None or new @ axes[k] < 1 - 1e-9:
                still.append(k)
            axes[k] = new
        open_ = still
        if not open_:
            break
    return axes


def divisive_tree(df: DataFrame, leaves: int, vec_col: str = "vec", id_cols: Sequence[str] = ("drug_id",)) -> Tree:
    """Split the rows into ``leaves`` clusters (see the module's text)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ids = [F.col(c).alias(f"id{k}") for k, c in enumerate(id_cols)]
    unit = with_centre_unit(df.select(*ids, fill_zero(vec_col).alias("z")), "z", "u").drop("z")
    unit = unit.withColumn("path", F.when(F.col("u").isNotNull(), F.lit(""))).checkpoint()
    known = {n.path: n for n in _nodes(unit, [""])}
    split: set[str] = set()          # nodes whose rows have been dealt to both sides
    order: list[str] = []            # nodes in the order of their splits
    heap = [(-n.height, n.path) for n in known.values()]
    while heap and len(heap) < leaves:
        height, path = heap[0]
        if -height <= LEAST:
            break
        if path not in split:
            # all leaves that may be split next, in one round
            due = [known[p] for h, p in heap if p not in split and -h > LEAST]
            axes = _axes(unit, due)
            place = {n.path: k for k, n in enumerate(due)}
            means = [n.mean for n in due]

            def deal(batches):
                for pdf in batches:
                    at = pdf["path"].map(place)
                    new = pdf["path"].to_numpy(object, copy=True)
                    for k in at.dropna().unique():
                        here = np.flatnonzero((at == k).to_numpy())
                        y = _along(np.stack(pdf["u"].iloc[here].to_numpy()) - means[int(k)], axes[int(k)])
                        new[here] = [due[int(k)].path + ("1" if v >= 0 else "0") for v in y]
                    yield pdf.assign(path=new)

            unit = unit.mapInPandas(deal, unit.schema).checkpoint()
            known |= {n.path: n for n in _nodes(unit, [n.path + side for n in due for side in "01"])}
            split |= set(place)
        heapq.heappop(heap)
        order.append(path)
        for child in (path + "0", path + "1"):
            heapq.heappush(heap, (-known[child].height, child))
    ends = sorted(p for _, p in heap)
    number = {p: k for k, p in enumerate(ends)}
    nodes = [(p, known[p].n, max(known[p].height, 0.0), order.index(p) + 1 if p in order else None, number.get(p))
             for p in [*order, *ends]]
    listed = F.array(*[F.lit(p) for p in ends]).cast("array<string>")
    # leaves are no prefixes of each other, so at most one fits
    leaf = F.get(F.filter(listed, lambda p: F.col("path").startswith(p)), F.lit(0))
    rows = unit.select(*[F.col(f"id{k}").alias(c) for k, c in enumerate(id_cols)], leaf.alias("path"))
    rows = rows.withColumn("cluster", (F.array_position(listed, F.col("path")) - 1).cast("int"))
    schema = "path string, n long, height double, split_order int, cluster int"
    return Tree(rows, spark.createDataFrame(nodes, schema))
