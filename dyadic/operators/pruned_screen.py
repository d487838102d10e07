"""The screen with exact pruning: side effects that cannot be flagged are not scored.

A score is a sum of norms that are linear in a pair's embeddings, so it changes by at
most (norm of the head + norm of the tail) times the way from one pair to another. The
pairs of a chunk are grouped around a few of their own (pivots, each the pair farthest
from those before it). Each pivot is scored against the whole catalogue; a side effect
whose score at the pivot, less the most by which it may fall within the group, is not
under its threshold flags no pair of the group, and is skipped for all of them. What is
left is scored as always, so results are those of ``scoring.screen_ranked``, and the
number of scores that were really taken is returned beside them.

Spectral norms of heads and tails are computed once per block of side effects. The
bounds only hold back work: far-spread pairs or loose thresholds mean that little is
skipped, never a wrong row.

Defined cases: as ``screen_ranked``; side effects without a threshold are never scored; with an empty catalogue no
pairs are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_once
from .scoring import RANKED_SCHEMA, PairModel, _blocks, list_matrix

#: pairs grouped at a time, and groups that they make at most
CHUNK, GROUPS = 2048, 32
#: far above the rounding of a score
SLACK = 1e-9


def farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, group of each point): every pivot is the point farthest from those before it, and points belong to
    the nearest one."""
    pivots, group = [0], np.zeros(len(points), np.int64)
    away = np.linalg.norm(points - points[0], axis=1)
    while len(pivots) < most and away.max() > 0:
        pivots.append(int(away.argmax()))
        way = np.linalg.norm(points - points[pivots[-1]], axis=1)
        group[way < away] = len(pivots) - 1
        away = np.minimum(away, way)
    return np.array(pivots), group


def _norms(matrices: np.ndarray) -> np.ndarray:
    return np.linalg.norm(matrices, ord=2, axis=(1, 2))


class _Identity:
    """Scores ``|r - g| + |r + g|`` with g the difference of the two profiles."""

    def __init__(self, R: np.ndarray):
        self.R, self.pull = R, np.full(len(R), 2.0)

    @staticmethod
    def points(x1, x2, shared):
        return (x2 - x1,)

    def scores(self, parts, se):
        g, out = parts[0][:, None, :], np.empty((len(parts[0]), len(se)))
        for a in range(0, len(se), 64):
            r = self.R[se[a:a + 64]][None]
            out[:, a:a + 64] = np.linalg.norm(r - g, axis=2) + np.linalg.norm(r + g, axis=2)
        return out, out


class _Full:
    """Scores of the full model; a point is the pair's embeddings in both orientations."""

    def __init__(self, heads: PairModel):
        self.heads, self.pull = heads, (_norms(heads.heads) + _norms(heads.tails)) / 2

    @staticmethod
    def points(x1, x2, shared):
        return (*shared.embed(x1, x2)[:2], *shared.embed(x2, x1)[:2])

    def scores(self, parts, se):
        some = PairModel(**{**self.heads.__dict__, "se_ids": self.heads.se_ids[se], "heads": self.heads.heads[se],
                            "tails": self.heads.tails[se], "r": self.heads.r[se]})
        return some.scores(parts[0], parts[1]), some.scores(parts[2], parts[3])


def candidates(scorer, parts: tuple, th: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, side effects that may be flagged) of each group of a chunk."""
    pivots, group = farthest_first(np.hstack(parts), GROUPS)
    known = np.flatnonzero(~np.isnan(th))
    sx, sy = scorer.scores(tuple(p[pivots] for p in parts), known)
    out = []
    for k, pivot in enumerate(pivots):
        rows = np.flatnonzero(group == k)
        radius = sum(np.linalg.norm(p[rows] - p[pivot], axis=1) for p in parts).max()
        least = (sx[k] + sy[k]) / 2 - scorer.pull[known] * radius * (1 + SLACK) - SLACK
        out.append((rows, known[least < th[known]]))
    return out


_PAIRS = T.StructType([T.StructField("drug1", T.LongType()), T.StructField("drug2", T.LongType()),
                       T.StructField("n_scored", T.LongType()), T.StructField("ranked", T.ArrayType(T.StructType(
                           [f for f in RANKED_SCHEMA.fields if f.name not in ("drug1", "drug2")])))])
#: ranked rows without their pair, as Arrow has them
_ITEM = pa.struct([(f.name, {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.dataType.typeName()])
                   for f in _PAIRS.fields[3].dataType.elementType.fields])


def _best(ids, th, sx, sy, top: int) -> tuple[np.ndarray, dict]:
    """Flagged side effects per pair (row), and the ``top`` largest gaps of each (ties: lower side effect first) as
    columns with the pair's row ``at``. Scores that were not taken are NaN and never flagged."""
    mean = (sx + sy) / 2
    with np.errstate(invalid="ignore"):
        flag = mean < th[None, :]
    at, k = np.nonzero(flag)
    total = np.bincount(at, minlength=len(mean))
    gap = np.abs(mean[at, k] - th[k])
    order = np.lexsort((k, -gap, at))
    first = np.concatenate([[0], np.cumsum(total)[:-1]])
    order = order[np.arange(len(at)) - first[at] < top]  # rows of ``at`` are already in order
    at, k, gap = at[order], k[order], gap[order]
    return total, {"at": at, "se": ids[k].astype(np.int32), "predicted_score_x": sx[at, k], "predicted_score_y": sy[at, k],
                   "mean_predicted_score": mean[at, k], "gap": gap}


def screen_pruned(pairs_with_vecs: DataFrame, thr: np.ndarray, top: int, se_ids: np.ndarray | None = None,
                  R: np.ndarray | None = None, model: PairModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked rows of *distinct* pairs (``RANKED_SCHEMA``), and one row of figures: ``n_pairs``, ``n_scores`` (pairs times
    side effects) and ``n_scored``. ``thr`` is in the order of the catalogue (ascending side effects). A chunk's rankings
    are made as whole columns and stored as Parquet, where the figures read their own column alone."""
    se_ids = model.se_ids if model is not None else se_ids
    width = model.W1.shape[0] if model is not None else (R.shape[1] if R.size else 0)
    shared, parts = _blocks(pairs_with_vecs.sparkSession, se_ids, R, model, thr)

    def chunk_of(d1, d2, x1, x2, scorers):
        scored, total, found = np.zeros(len(d1), np.int64), np.zeros(len(d1), np.int64), []
        for ids, th, scorer in scorers:
            points = scorer.points(x1, x2, shared.value if shared is not None else None)
            sx, sy = np.full((len(d1), len(ids)), np.nan), np.full((len(d1), len(ids)), np.nan)
            for rows, se in candidates(scorer, points, th):
                scored[rows] += len(se)
                if len(se):
                    sx[np.ix_(rows, se)], sy[np.ix_(rows, se)] = scorer.scores(tuple(p[rows] for p in points), se)
            flagged, best = _best(ids, th, sx, sy, top)
            total += flagged
            found.append(best)
        best = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
        if len(found) > 1:
            order = np.lexsort((best["se"], -best["gap"], best["at"]))
            best = {name: values[order] for name, values in best.items()}
        held = np.bincount(best["at"], minlength=len(d1))
        rank = np.arange(len(best["at"])) - np.repeat(np.cumsum(held) - held, held) + 1
        best = {name: values[rank <= top] for name, values in (best | {"rank": rank.astype(np.int32)}).items()}
        best["total_predicted_reactions"] = total[best["at"]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(best["at"], minlength=len(d1)))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(best[f.name], f.type) for f in _ITEM], fields=list(_ITEM))
        return pa.RecordBatch.from_arrays([d1, d2, pa.array(scored), pa.ListArray.from_arrays(pa.array(ends), items)],
                                          names=_PAIRS.fieldNames())

    def run(batches):
        scorers = [(ids, th, _Identity(Rm) if heads is None else _Full(heads)) for ids, Rm, heads, th in (p.value for p in parts)]
        for batch in batches if scorers else ():
            x1, p1 = list_matrix(batch.column("vec1"), width)
            x2, p2 = list_matrix(batch.column("vec2"), width)
            ok = np.flatnonzero(p1 & p2)
            for a in range(0, len(ok), CHUNK):
                at = ok[a:a + CHUNK]
                d1, d2 = (batch.column(c).take(pa.array(at)).cast(pa.int64()) for c in ("drug1", "drug2"))
                yield chunk_of(d1, d2, x1[at], x2[at], scorers)

    done = stored_once(pairs_with_vecs.select("drug1", "drug2", "vec1", "vec2").mapInArrow(run, _PAIRS), "pruned")
    ranked = done.select("drug1", "drug2", F.explode("ranked").alias("r")).select("drug1", "drug2", "r.*")
    n = F.count(F.lit(1))
    figures = done.agg(n.alias("n_pairs"), (n * len(se_ids)).alias("n_scores"),
                       F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored"))
    return ranked.select(*RANKED_SCHEMA.fieldNames()), figures
