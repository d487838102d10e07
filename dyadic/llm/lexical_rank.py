"""Ranked lexical search, a term at a time with a limited set of accumulators.

The documents are indexed once per block of query terms: a segment of whole documents
is one row with its documents' ids and lengths and, term by term, the documents and
frequencies of that term. Corpus statistics (documents, words, document frequencies)
come from the whole index. Then every segment answers every item:

* the item's terms are taken rarest first, and each adds its part of the score to the
  accumulators of the documents that have it;
* before a term, the remaining terms' largest parts in the segment are summed; once
  this bound is below the k-th best score (the k-th partial score of the segment, or the
  k-th score found by the task in earlier segments), a document without an accumulator
  cannot come among the k best any more and none is created;
* accumulators that exist are updated by all remaining terms, so their scores are exact.

A task keeps the k best documents of each item over all its segments; the few rows
that are left are ranked per item, first within salted shares and then over these.

Words are runs of 0-9, A-Z, a-z and characters from U+0080 on, with only A-Z
lower-cased; they are compared as 64-bit hashes.

Score of a document with n of the corpus' L words, N documents with words, a term in df
documents and tf times in this one: w = floor(1000 ln((2N + 2) / (2df + 1))),
m = 100 - b + ((b n N) div L) with b = 50, sum over the item's distinct terms of
w ((10^9 tf) div (1000 tf + 20 m)).

Bounds: the driver holds one block of query terms (``BLOCK_TERMS``, or the terms of one
item where these are more) with their frequencies; a segment is cut after
``SEGMENT_BYTES`` of text, at the next end of a document.

Defined cases: rows with one item id, or none, are one item with the terms of all of
them; null texts and texts without words have no terms, match nothing and count for
nothing; repeated documents are ranked each; equal scores are ordered by document id,
null ids last; items without matching documents have no rows; other columns are not
read; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import hashed_slices

SEGMENT_BYTES = 8 << 20
#: query terms (one of each item) asked at a time
BLOCK_TERMS = 500_000
LENGTH_SHARE = 50
#: shares in which an item's candidates are ranked before the last ranking
SALTS = 32

_INDEX = "docs long, words long, doc_ids array<long>, lengths binary, terms array<int>, freqs array<int>, places binary, counts binary"
_INDEX_ARROW = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                          ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("freqs", pa.list_(pa.int32())),
                          ("places", pa.binary()), ("counts", pa.binary())])


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words, first in hashed_slices(batch.column(1), SEGMENT_BYTES):
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=["item_id", "words"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored table of the distinct (item_id, term)."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    words = rows.mapInArrow(_terms_of_items, "item_id long, words array<long>")
    return stored(words.select("item_id", F.explode("words").alias("term")).distinct(), "item-terms")


def _index_rows(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first in hashed_slices(batch.column(1), SEGMENT_BYTES):
                lengths = np.diff(first)
                hashes = words.view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == hashes)
                doc = np.searchsorted(first, known, side="right") - 1
                pair, freq = np.unique(at[known].astype(np.int64) << 32 | doc, return_counts=True)
                term, begin = np.unique(pair >> 32, return_index=True)
                yield pa.record_batch([
                    pa.array([int((lengths > 0).sum())]), pa.array([len(hashes)]),
                    pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([term.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([np.diff(np.append(begin, len(pair))).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([(pair & 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([freq.astype(np.uint32).tobytes()], pa.binary())], schema=_INDEX_ARROW)

    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored index of all documents for the terms of a sorted ``vocabulary``: a row per segment with its number of
    documents with words and of words, ids and lengths of its documents, and per term (its place in the vocabulary)
    the number of its documents, these and its frequencies in them."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return stored(rows.mapInArrow(_index_rows(vocabulary), _INDEX), "term-index")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """One segment's lists: ``parts`` of the score by term, and what the terms-at-a-time search needs."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_words: int):
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // max(n_words, 1)
        places, tf = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("places", "counts"))
        terms, freqs = (np.asarray(row[c], np.int64) for c in ("terms", "freqs"))
        bounds = np.concatenate([[0], np.cumsum(freqs)])
        parts = np.repeat(weights[terms], freqs) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
        self.lists = {t: (places[a:b], parts[a:b]) for t, a, b in zip(terms.tolist(), bounds[:-1], bounds[1:])}
        self.most = dict(zip(terms.tolist(), np.maximum.reduceat(parts, bounds[:-1]).tolist())) if len(terms) else {}
        self.scores = np.zeros(len(lengths), np.int64)
        self.made = np.zeros(len(lengths), bool)

    def best(self, rarest: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (places) that may be among the k best, their exact scores, and the number of accumulators made.

        ``rarest``: the item's terms, rarest first; ``floor``: a score that k documents are known to reach.
        """
        terms = [t for t in rarest if t in self.lists]
        rest = [0]
        for t in reversed(terms):
            rest.append(rest[-1] + self.most[t])
        rest.reverse()  # rest[j]: what terms[j:] can add at most
        scores, made, creating, kth = self.scores, self.made, True, floor
        for j, t in enumerate(terms):
            if creating and rest[j] < rest[0] - rest[j]:  # else no partial score can be above the bound
                alive = scores[made]
                if len(alive) >= k:
                    kth = max(kth, int(np.partition(alive, len(alive) - k)[len(alive) - k]))
            creating = creating and rest[j] >= kth
            places, parts = self.lists[t]
            if creating:
                made[places] = True
            else:
                old = made[places]
                places, parts = places[old], parts[old]
            scores[places] += parts
        at = np.flatnonzero(made)
        found = scores[at]
        scores[at], made[at] = 0, False
        n = len(at)
        if n > k:  # ties with the k-th stay
            keep = found >= np.partition(found, n - k)[n - k]
            at, found = at[keep], found[keep]
        keep = found > 0
        return at[keep], found[keep], n


def _search(queries: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(queries)  # score, document, document is null
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                segment = Segment(r, weights, n_docs, n_words)
                null = np.array([i is None for i in r["doc_ids"]], bool)
                ids = np.array([0 if i is None else i for i in r["doc_ids"]], np.int64)
                for q, (_, rarest) in enumerate(queries):
                    scores, docs, nulls = best[q]
                    at, found, _ = segment.best(rarest, k, int(scores[-1]) if len(scores) == k else 0)
                    if len(at):
                        scores, docs = np.concatenate([scores, found]), np.concatenate([docs, ids[at]])
                        nulls = np.concatenate([nulls, null[at]])
                        first = np.lexsort((docs, nulls, -scores))[:k]
                        best[q] = scores[first], docs[first], nulls[first]
        for (item, _), (scores, docs, nulls) in zip(queries, best):
            if len(scores):
                yield pa.record_batch([pa.array([item] * len(scores), pa.int64()), pa.array(docs, pa.int64(), mask=nulls),
                                       pa.array(scores)], names=["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    for keys in (["item_id", "salt"], ["item_id"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return salted.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item (all above 0, if fewer)."""
    terms = item_terms(items, item_id_col, item_text_col)
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        vocabulary = np.unique(np.array([r["term"] for r in rows], np.int64))
        place = {t: p for p, t in enumerate(vocabulary.tolist())}
        index = build_index(docs, vocabulary, id_col, text_col)
        n_docs, n_words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for t, n in (index.select(F.explode(F.arrays_zip("terms", "freqs")).alias("x"))
                     .groupBy("x.terms").agg(F.sum("x.freqs")).collect()):
            df[t] = n
        weights = np.array([term_weight(n_docs, n) for n in df.tolist()], np.int64)
        asked: dict[int | None, list[int]] = {}
        for r in rows:
            asked.setdefault(r["item_id"], []).append(place[r["term"]])
        queries = [(i, sorted((t for t in ts if df[t]), key=lambda t: (df[t], t))) for i, ts in asked.items()]
        found = index.mapInArrow(_search(queries, weights, n_docs, n_words, k), "item_id long, doc_id long, score long")
        if blocks > 1:  # done before the next block's terms are taken
            found = stored(_ranked(found, k), "ranked")
        else:
            found = _ranked(found, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
