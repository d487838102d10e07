"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are the shapes of its tokens (``Foo##`` and ``Quux###`` are one
shape), its words, and repeats of a word at distance 1 to 4; shapes and words are
hashed. Term shares are damped, weighted by inverse document frequency and
projected on the leading right singular vectors of the labelled sample. Every
document is compared with every labelled vector (exact cosines, one matrix product
per block of documents), and its nearest labelled neighbours vote with their
similarity as weight.

The labelled sample is bounded by ``max_labelled`` rows (those with the smallest
hash of their id), so what is broadcast is at most max_labelled x (dimensions + 1)
floats and the projection; nothing else of the corpus reaches the driver.

Defined cases: a null text counts as empty; a text without terms gets the share of
label 1 in the sample; rows with a null label teach nothing, an id labelled twice
teaches the smaller label; without any labelled row every score is 0.5; a null
doc_id is held out; ties in similarity vote in sample order; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out
from .words import row_slices, shape_hashes, strings, word_hashes

SHAPES, WORDS, LAGS = 512, 512, 4
WORD_WEIGHT = 0.1
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2000


def term_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped term shares (rows x terms) of some texts."""
    n = len(offsets) - 1
    words, first = word_hashes(data, offsets)
    shapes, sfirst = shape_hashes(data, offsets)
    row, srow = np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), np.diff(sfirst))
    total = np.maximum(np.diff(sfirst), 1)[:, None]
    count = lambda r, h, d: np.bincount(
        r * d + (h % np.uint64(d)).astype(np.int64), minlength=n * d).reshape(n, d)
    repeats = np.zeros((n, LAGS))
    for lag in range(1, LAGS + 1):
        same = (words[lag:] == words[:-lag]) & (row[lag:] == row[:-lag])
        repeats[:, lag - 1] = np.bincount(row[lag:][same], minlength=n)
    return np.hstack([np.sqrt(count(srow, shapes, SHAPES) / total), np.sqrt(repeats / total),
                      WORD_WEIGHT * np.sqrt(count(row, words, WORDS) / total)]).astype(np.float32)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = strings(column)
    for a, b in row_slices(offsets, SLICE_BYTES):
        for c in range(a, b, SLICE_ROWS):
            d = min(b, c + SLICE_ROWS)
            yield c, d, term_shares(data, offsets[c:d + 1])


def share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x in blocks(batch.column(2)):
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                   pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "label", "x"])


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """doc_id, label and sampling hash of at most ``max_labelled`` labelled ids that may be learned from."""
    return (labels.where(F.col(label_col).isNotNull() & ~is_held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
            .withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(max_labelled))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
        dimensions: int = 24, max_labelled: int = 4000) -> dict:
    """Projection, labelled unit vectors and their labels."""
    chosen = labelled_rows(docs, labels, label_col, max_labelled)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).select(
        chosen["__h"].alias("h"), chosen["__label"].alias("label"), docs[text_col].alias("t"))
    got = (rows.mapInArrow(share_rows, "h long, label int, x binary")
           .orderBy("h", "x").limit(max_labelled).collect())
    if not got:
        return {"basis": None, "vectors": None, "labels": np.zeros(0)}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    _, _, v = np.linalg.svd(x * idf, full_matrices=False)
    basis = (idf[:, None] * v[:dimensions].T).astype(np.float32)
    return {"basis": basis, "vectors": unit(x @ basis), "labels": np.array([r["label"] for r in got], np.float32)}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(model: dict, x: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    if model["basis"] is None:
        return np.full(len(x), 0.5)
    y = model["labels"]
    k = min(neighbours, len(y))
    cosines = unit(x @ model["basis"]) @ model["vectors"].T
    near = np.sort(np.argpartition(-cosines, k - 1, axis=1)[:, :k], axis=1)
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** sharpness
    total = weight.sum(1)
    return np.where(total > 0, (weight * y[near]).sum(1) / np.where(total > 0, total, 1), y.mean())


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", neighbours: int = 15, sharpness: float = 8.0, threshold: float = 0.7,
                  **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, text_col, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in blocks(batch.column(2)):
                score = np.round(np.clip(vote(model.value, x, neighbours, sharpness), 0, 1), 6)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                       pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                      names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
