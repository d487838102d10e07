"""Exact nearest rows by correlation, with pivots.

Rows are centred and scaled to unit length; the angle between two of them is a
metric, and ``1 - cos`` of it their correlation distance. Rows are assigned to the
nearest of a few pivots (a cell), and cells are cut into rings by the angle to the
pivot. From counts, bounds and the smallest angles of each ring follows, for every
ring, an angle within which all its rows have their ``k`` nearest: the ring's outer
angle, plus the way to another pivot, plus the angles of rows around that one. A
row has to meet a ring only if its own angle to the ring's pivot lies within this
reach of the ring (triangle inequality); other rows are pruned, and the result is exact.

Rings are laid end to end and cut into lanes of equal length: as many as there are
cores, more where one would hold over ``LANE_BYTES`` of vectors, fewer where one would
hold under ``BLOCK`` rows. A task holds the rows of a lane with the ``k`` nearest found
so far and meets, batch by batch, the rows that have to meet one of the lane's rings.
A row travels once to each such lane, as floats if all vectors came from floats, never
once per ring or block; what leaves the task is final. Products are taken in single
precision, and those that may be among the ``k`` nearest again in double precision.
Where nothing can be pruned (directions at random) each row meets each lane, and the
work is that of all pairs.

The driver holds the pivots and a few numbers per ring.

Defined cases: missing elements count as 0; rows without a direction (null, or all
elements equal) have no neighbours and are none; ids have to be unique (refused
otherwise); a row is not its own neighbour; equal distances (to nine places) are ranked
by id; fewer than ``k`` other rows give that many; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import fill_zero, with_centre_unit
from ..session import ensure_checkpoint_dir, stored_once
from .joins import assert_unique

PIVOTS, RINGS = 64, 8
BLOCK = 2048
#: bytes of unit vectors that a task holds at most, and products that it takes at once
LANE_BYTES, TILE = 64 << 20, (1024, 4096)
#: distance of a neighbour that was not found yet
NONE = 1 << 62
#: bytes of vectors that leave a task as one Arrow batch at most (an Arrow column ends at 2 GB)
SENT_BYTES = 64 << 20
#: angles are compared with this slack, far above their rounding
SLACK = 1e-6


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b) for b in column])


def reaches(rings: pd.DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """Per ring (cell, low, high, near: its smallest angles) an angle within which each of its rows has ``k`` others."""
    between = _angles(pivots, pivots)
    near = rings.groupby("cell")["near"].agg(lambda lists: np.sort(np.concatenate(list(lists)))[:k + 1])
    out = []
    for cell, high in zip(rings["cell"], rings["high"]):
        # k + 1 rows: one of them may be the row itself
        ways = np.sort(np.concatenate([between[cell, c] + angles for c, angles in near.items()]))
        out.append(high + ways[k] if len(ways) > k else np.pi)
    return np.minimum(np.array(out), np.pi) + SLACK


def _units(z: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to unit length, added in the order of the positions as ``with_centre_unit`` adds."""
    total, square = np.zeros(len(z)), np.zeros(len(z))
    for x in z.T:
        total += x
    c = z - (total / z.shape[1])[:, None]
    for x in c.T:
        square += x * x
    return c / np.sqrt(square)[:, None]


def sent_rows(pdf: pd.DataFrame, centres: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray,
              reach: np.ndarray, member: np.ndarray | None = None, matrix=_matrix) -> Iterator[pd.DataFrame]:
    """Rows (other, v, b): each row of ``pdf`` once per ring ``b`` that it has to meet, in frames of about ``SENT_BYTES``.
    With ``member`` (ring x lane) ``b`` is a lane that has such a ring, and ``own`` the row's own ring in its own lane, else -1.
    ``matrix`` gives the unit rows of a column of bytes."""
    step = max(1, SENT_BYTES // (8 * centres.shape[1] * len(cell)))
    for a in range(0, len(pdf), step):
        some = pdf.iloc[a:a + step]
        angle = _angles(matrix(some["u"]), centres)[:, cell]
        # the least angle that a row may have to any row of the ring
        meets = np.maximum(angle - high, low - angle) <= reach
        if member is not None:
            meets = meets.astype(np.float32) @ member > 0
        at, to = np.nonzero(meets)
        out = pd.DataFrame({"other": some["id"].to_numpy()[at], "v": some["u"].to_numpy()[at], "b": to.astype(np.int32)})
        yield out if member is None else out.assign(own=np.where(
            some["lane"].to_numpy()[at] == to, some["b"].to_numpy()[at], -1).astype(np.int32))


class LaneRows:
    """The rows of a lane and their ``k`` nearest among the rows met so far."""

    def __init__(self, ids: np.ndarray, ring: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ring, kind="stable")
        self.ids, self.x, self.k = ids[order], x[order], k
        self.rings, begin = np.unique(ring[order], return_index=True)
        self.spans = list(zip(begin, np.append(begin[1:], len(ids))))
        self.single = self.x.astype(np.float32)
        self.d9, self.other = np.full((len(ids), k), NONE), np.full((len(ids), k), NONE)
        # a product in single precision is this far off at most
        self.slack = 2e-7 * (x.shape[1] + 8)
        self.least = np.full(len(ids), -np.inf, dtype=np.float32)

    def meet(self, ids: np.ndarray, y: np.ndarray, must: np.ndarray) -> None:
        """``must``: which of the rows have to meet which of ``rings``."""
        single = y.astype(np.float32)
        spans = [(0, len(self.ids), None)] if must.all() else [
            (a, b, np.flatnonzero(must[:, r])) for r, (a, b) in enumerate(self.spans)]
        rows, others = TILE
        for a, b, some in spans:
            some = np.arange(len(ids)) if some is None else some
            for i in range(a, b, rows):
                for j in range(0, len(some), others):
                    self._tile(slice(i, min(b, i + rows)), some[j:j + others], ids, y, single)

    def _tile(self, own: slice, some: np.ndarray, ids: np.ndarray, y: np.ndarray, single: np.ndarray) -> None:
        product = self.single[own] @ single[some].T
        near = product >= self.least[own, None]
        # one of k + 1 may be the row itself
        if product.shape[1] > self.k + 1 and np.count_nonzero(near) > 8 * self.k * len(product):
            kth = np.partition(product, -self.k - 1, axis=1)[:, -self.k - 1]
            near &= product >= (kth - np.float32(2 * self.slack))[:, None]
        at, other = np.nonzero(near)
        at, other = at + own.start, some[other]
        keep = self.ids[at] != ids[other]
        at, other = at[keep], other[keep]
        step = max(1, TILE[0] * TILE[1] // self.x.shape[1])
        for a in range(0, len(at), step):
            i, j = at[a:a + step], other[a:a + step]
            d9 = np.floor((1.0 - np.einsum("ij,ij->i", self.x[i], y[j])) * 1e9 + 0.5).astype(np.int64)
            self._add(i, d9, ids[j])

    def _add(self, row: np.ndarray, d9: np.ndarray, other: np.ndarray) -> None:
        better = d9 <= self.d9[row, -1]
        if not better.any():
            return
        row, d9, other = row[better], d9[better], other[better]
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, self.k)])
        d9, other = np.concatenate([d9, self.d9[rows].ravel()]), np.concatenate([other, self.other[rows].ravel()])
        order = np.lexsort((other, d9, row))
        row, d9, other = row[order], d9[order], other[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        self.d9[row[best], rank[best]], self.other[row[best], rank[best]] = d9[best], other[best]
        last = self.d9[rows, -1]
        self.least[rows] = np.where(last == NONE, -np.inf, 1.0 - (last + 1) * 1e-9 - self.slack)

    def found(self, step: int = 4096) -> Iterator[pd.DataFrame]:
        for a in range(0, len(self.ids), step):
            at, rank = np.nonzero(self.d9[a:a + step] != NONE)
            yield pd.DataFrame({"id": self.ids[a + at], "rank": (rank + 1).astype(np.int32),
                                "neighbour": self.other[a + at, rank], "d9": self.d9[a + at, rank]})


def nearest_rows(df: DataFrame, k: int, vec_col: str = "vec", id_col: str = "drug_id", pivots: int = PIVOTS,
                 rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """Rows id, rank (from 1), neighbour, distance (1 - Pearson): the ``k`` nearest other rows of each row."""
    return _nearest(df, k, vec_col, id_col, pivots, rings, block)[0]


def _nearest(df: DataFrame, k: int, vec_col: str, id_col: str, n_pivots: int, n_rings: int,
             block: int) -> tuple[DataFrame, DataFrame | None]:
    """The result, and the table of rows sent to rings (None without rows)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    schema = f"`{id_col}` long, rank int, neighbour long, distance double"
    unit = with_centre_unit(df.select(F.col(id_col).cast("long").alias("id"), fill_zero(vec_col).alias("z")), "z", "u")
    unit = unit.where(F.col("u").isNotNull()).select("id", "z", "u")
    assert_unique(unit.select("id"), ["id"], "rows")
    # rows in hash order are a sample that every run repeats
    chosen = unit.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    if not chosen:
        return spark.createDataFrame([], schema), None
    centres = np.unique(np.array([r["u"] for r in chosen]), axis=0)

    doubles = "array<double>"
    narrow = unit.agg(F.every(F.col("z").cast(doubles).eqNullSafe(F.col("z").cast("array<float>").cast(doubles)))).first()[0]
    kind = np.float32 if narrow else np.float64

    def matrix(column):
        return _units(np.stack([np.frombuffer(b, kind) for b in column]).astype(np.float64))

    def assign(batches):
        for pdf in batches:
            z = np.stack(pdf["z"].to_numpy()).astype(np.float64)
            angle = _angles(_units(z), centres)
            cell = angle.argmin(axis=1)
            yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "angle": angle[np.arange(len(z)), cell],
                                "u": [row.tobytes() for row in z.astype(kind)]})

    rows = stored_once(unit.select("id", "z").mapInPandas(assign, "id long, cell int, angle double, u binary"), "cells")
    cuts = {r["cell"]: r["cuts"] for r in rows.groupBy("cell").agg(F.percentile_approx(
        "angle", [j / n_rings for j in range(1, n_rings)] or [1.0], 1000).alias("cuts")).collect()}
    limits = spark.createDataFrame(sorted((c, [float(a) for a in x]) for c, x in cuts.items()), "cell int, cuts array<double>")
    # one row per pivot
    rows = rows.join(F.broadcast(limits), "cell").withColumn("ring", F.size(F.filter(
        "cuts", lambda c: c < F.col("angle")))).drop("cuts")

    def smallest(batches):
        kept: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for key, angles in pdf.groupby(["cell", "ring"])["angle"]:
                kept[key] = np.sort(np.concatenate([kept.get(key, np.zeros(0)), angles.to_numpy()]))[:k + 1]
        if kept:
            yield pd.DataFrame({"cell": [c for c, _ in kept], "ring": [r for _, r in kept], "near": list(kept.values())})

    near = (rows.select("cell", "ring", "angle").mapInPandas(smallest, "cell int, ring int, near array<double>")
            .groupBy("cell", "ring").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")))
    stats = rows.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"),
                                             F.max("angle").alias("high")).join(near, ["cell", "ring"])
    table = stats.toPandas().sort_values(["cell", "ring"], ignore_index=True)
    n = int(table["n"].sum())
    reach = reaches(table, centres, k)
    cell, low, high = (table[c].to_numpy() for c in ("cell", "low", "high"))
    held = max(1, LANE_BYTES // (8 * centres.shape[1]))
    lanes = max(min(spark.sparkContext.defaultParallelism, -(-n // block)), -(-n // held))
    length = -(-n // lanes)
    end = table["n"].cumsum().to_numpy()
    begin = end - table["n"].to_numpy()
    cut = np.arange(lanes) * length
    member = ((begin[:, None] < cut + length) & (end[:, None] > cut)).astype(np.float32)

    def meets(batches):
        for pdf in batches:
            yield from sent_rows(pdf, centres, cell, low, high, reach, member, matrix)

    def best(batches):
        held, lane = [], None
        for pdf in batches:
            frames = [pdf]
            if lane is None:
                held.append(pdf[pdf["own"] >= 0])
                if (pdf["own"] >= 0).all():
                    continue
                if not any(map(len, held)):
                    return  # no row fell into this lane
                frames = [*held, pdf[pdf["own"] < 0]]
                lane = lane_of(held)
            for frame in frames:
                meet(lane, frame)
        if lane is None and held:
            lane = lane_of(held)
            for frame in held:
                meet(lane, frame)
        if lane is not None:
            yield from lane.found()

    def lane_of(frames):
        column = lambda c: np.concatenate([f[c].to_numpy() for f in frames])
        return LaneRows(column("other"), column("own"), np.concatenate([matrix(f["v"]) for f in frames if len(f)]), k)

    def meet(lane, frame):
        if len(frame):
            y, at = matrix(frame["v"]), lane.rings
            angle = _angles(y, centres)[:, cell[at]]
            lane.meet(frame["other"].to_numpy(), y, np.maximum(angle - high[at], low[at] - angle) <= reach[at])

    numbers = spark.createDataFrame([(int(c), int(r), b, int(first), int(size)) for b, (c, r, first, size) in enumerate(zip(
        table["cell"], table["ring"], begin, table["n"]))], "cell int, ring int, b int, first long, size long")
    place = F.col("first") + F.pmod(F.xxhash64("id"), F.col("size"))
    dealt = rows.join(F.broadcast(numbers), ["cell", "ring"]).select(  # a row per ring
        "id", "u", "b", F.floor(place / length).cast("int").alias("lane"))
    sent = dealt.mapInPandas(meets, "other long, v binary, b int, own int")
    # a lane's own rows first
    ranked = (sent.repartitionById(lanes, F.col("b")).sortWithinPartitions(F.col("own") < 0)
              .mapInPandas(best, "id long, rank int, neighbour long, d9 long"))
    return ranked.select(F.col("id").alias(id_col), "rank", "neighbour", (F.col("d9") / 1e9).alias("distance")), sent
