"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of whole documents. A segment's index holds one
row per term with the sorted word positions of that term in the segment
(documents are one position apart, so no phrase can span two), and one directory
row with the documents. The index is a stored table; its postings cover the terms
that the test items use (all terms when those are too many to ship).

The windows of the test items are a stored table as well, each window once with the
items that have it and with its rarest term in the whole corpus; windows with a term
that the corpus lacks drop out. Windows meet postings by that rarest term, so a
segment is asked for a window only if it holds the window's rarest term at all.

Inside a segment a window starts from its rarest term there, shifts that term's
positions by the term's offset, and intersects them with the shifted lists of the next
rarer terms; what is left are the exact starts of the phrase. ``slop`` > 0 asks for
proximity instead: all words of the window inside a stretch of its length plus
``slop``.

Shuffles: the windows with the counts of their terms; the postings by segment, with
the windows asked there; and per document with hits one row. A passage that a third of
the documents share only gives each of them its own row. Of the items only their
terms pass through the driver (``MAX_VOCABULARY`` at most).

Defined cases: null texts have no words; items without words or id match nothing;
repeated items count once; documents with equal ids stay separate rows; a
document without words has no hits and is not contaminated; empty tables give
empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .words import hashed_slices

SEGMENT_BYTES = 16 << 20
#: beyond so many distinct test terms the index keeps all terms instead of shipping the list
MAX_VOCABULARY = 1_000_000

INDEX_SCHEMA = "segment long, term long, n long, positions binary, doc_ids array<long>, doc_words array<long>"
_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.int64()), ("n", pa.int64()), ("positions", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64()))])


def _index_rows(vocabulary: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first in hashed_slices(batch.column(1), SEGMENT_BYTES):
                # unique per attempt; only the committed attempt of a task is ever read
                segment = int.from_bytes(os.urandom(8), "little") >> 1
                count = np.diff(first)
                terms = words.view(np.int64)
                position = (np.arange(len(terms)) + np.repeat(np.arange(b - a), count)).astype(np.uint32)
                if vocabulary is not None and len(terms):
                    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1) if len(vocabulary) else None
                    known = vocabulary[at] == terms if at is not None else np.zeros(len(terms), bool)
                    terms, position = terms[known], position[known]
                order = np.argsort(terms, kind="stable")
                terms, position = terms[order], position[order]
                begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
                bounds = np.concatenate([begin, [len(terms)]]).astype(np.int64)
                blob = pa.Array.from_buffers(pa.binary(), len(begin), [
                    None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(position.tobytes())])
                none = pa.nulls(len(begin), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(np.full(len(begin), segment)), pa.array(terms[begin]),
                                       pa.array(np.diff(bounds)), blob, none, none], schema=_ARROW)
                # the directory row of the segment: term 0, n -1
                yield pa.record_batch([pa.array([segment]), pa.array([0]), pa.array([-1]),
                                       pa.nulls(1, pa.binary()),
                                       pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                                       pa.array([count.tolist()], pa.list_(pa.int64()))], schema=_ARROW)

    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Stored index table (``INDEX_SCHEMA``) of all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return stored(rows.mapInArrow(_index_rows(vocabulary), INDEX_SCHEMA), "postings")


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words, first in hashed_slices(batch.column(1), SEGMENT_BYTES):
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=["item_id", "words"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored table of item_id and the hashes of its words."""
    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return stored(rows.mapInArrow(_words_of_items, "item_id long, words array<long>").where("size(words) > 0"), "items")


WINDOWS_SCHEMA = "window array<long>, items array<long>, rarest long"


def windows_of(index: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Stored table (``WINDOWS_SCHEMA``) of the windows of n words of all items (a shorter item is one window) whose
    terms all occur in the index."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, n))).alias("window"))
    windows = stored(each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    # how often a term occurs in the corpus
    counts = index.where("n >= 0").groupBy("term").agg(F.sum("n").alias("times"))
    terms = windows.select("window", F.explode(F.array_distinct("window")).alias("term")).join(counts, "term", "left")
    rarest = (terms.groupBy("window").agg(F.min(F.struct("times", "term")).alias("r"), F.count("times").alias("found"),
                                          F.count(F.lit(1)).alias("all")).where("found = all"))
    return stored(windows.join(rarest, "window").select("window", "items", F.col("r.term").alias("rarest")), "asked")


def phrase_starts(window: tuple, rarest: list[int], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Positions at which the window begins; ``rarest``: its offsets by ascending list length."""
    lead = rarest[0]
    starts = lists[window[lead]].astype(np.int64) - lead
    starts = starts[starts >= 0]
    for off in rarest[1:]:
        if not len(starts):
            break
        have = lists[window[off]]
        at = np.searchsorted(have, starts + off)
        starts = starts[have[np.minimum(at, len(have) - 1)] == starts + off]
    return starts


def stretch_starts(window: tuple, lists: dict[int, np.ndarray], slop: int, first: np.ndarray) -> np.ndarray:
    """Starts of stretches of len(window) + slop words of one document that hold every term of the window (as often
    as it does); ``first``: position of each document's first word."""
    need: dict[int, int] = {}
    for t in window:
        need[t] = need.get(t, 0) + 1
    reach = len(window) + slop
    lead = min(need, key=lambda t: len(lists[t]))
    # a stretch that holds everything can be moved right until it begins with a word of the window
    begins = np.unique(np.concatenate([lists[t] for t in need])).astype(np.int64)
    ends = np.minimum(begins + reach, first[np.searchsorted(first, begins, "right")] - 1)
    for t in sorted(need, key=lambda t: t != lead):
        inside = np.searchsorted(lists[t], ends) - np.searchsorted(lists[t], begins)
        begins, ends = begins[inside >= need[t]], ends[inside >= need[t]]
    return begins


HITS_SCHEMA = "segment long, ord long, items array<long>, spans array<struct<s:long,e:long>>"


def _search(slop: int):
    def run(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return pd.DataFrame({"segment": [], "ord": [], "items": [], "spans": []})
        directory = (pdf["n"] < 0).to_numpy()
        here = pdf[directory].iloc[0]
        first = np.concatenate([[0], np.cumsum(np.asarray(here["doc_words"], np.int64) + 1)])
        post = pdf[~directory]
        lists = {int(t): np.frombuffer(p, np.uint32) for t, p in zip(post["term"], post["positions"])}
        size = {t: len(p) for t, p in lists.items()}
        found: dict[int, tuple[set, list]] = {}
        for window, items in zip(asked["window"], asked["items"]):
            window = tuple(window.tolist())
            counts = [size.get(t, 0) for t in window]
            if not min(counts):
                continue
            starts = stretch_starts(window, lists, slop, first) if slop else phrase_starts(
                window, sorted(range(len(window)), key=counts.__getitem__), lists)
            length = len(window) + slop
            for s, d in zip(starts.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist()):
                ids, spans = found.setdefault(d, (set(), []))
                ids.update(items.tolist())
                spans.append((s, min(s + length, int(first[d + 1]) - 1)))
        segment, rows = int(here["segment"]), []
        for d, (ids, spans) in found.items():
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            rows.append((segment, d, sorted(ids), [{"s": s, "e": e} for s, e in merged]))
        return pd.DataFrame(rows, columns=["segment", "ord", "items", "spans"])

    return run


def find_matches(index: DataFrame, words: DataFrame, n: int = 13, slop: int = 0) -> DataFrame:
    """Rows of ``HITS_SCHEMA``: per document the items found and the merged word spans they cover."""
    windows = windows_of(index, words, n)
    asked = stored(index.where("n >= 0").select("segment", F.col("term").alias("rarest")).join(windows, "rarest").select(
        "segment", "window", "items"), "candidates")
    # a segment that no window asks is not moved
    rows = index.join(asked.select("segment").distinct(), "segment", "left_semi")
    return rows.groupBy("segment").cogroup(asked.groupBy("segment")).applyInPandas(_search(slop), HITS_SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: at least one word in ``share`` lies inside an occurrence of a window.
    """
    words = item_words(items, item_id_col, item_text_col)
    terms = words.select(F.explode("words").alias("t")).distinct()
    vocabulary = None
    if terms.count() <= MAX_VOCABULARY:
        vocabulary = np.sort(np.array([r[0] for r in terms.collect()], np.int64))
    index = build_index(docs, vocabulary, id_col, text_col)
    hits = (find_matches(index, words, n)
            .groupBy("segment", "ord").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                           F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    # words covered by sorted spans: what each adds beyond the furthest end so far
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("far")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["far"]))).alias("n"),
            F.greatest(acc["far"], x["e"]).alias("far")),
        lambda acc: acc["n"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hits = hits.select("segment", "ord", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"))
    every = (index.where("n < 0").select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")))
             .select("segment", F.col("pos").cast("long").alias("ord"), F.col("col.doc_ids").alias("doc_id"),
                     F.col("col.doc_words").alias("n_words")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return every.join(hits, ["segment", "ord"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **rules) -> DataFrame:
    """The documents that are not contaminated (rows are told apart by id and text)."""
    key, name = F.xxhash64(id_col, text_col), free_name(docs, "__key")
    gone = (contamination(docs.select(key.alias("key"), docs[text_col].alias("text")), items, id_col="key", text_col="text",
                          **rules).where("contaminated").select(F.col("doc_id").alias(name)))
    return docs.withColumn(name, key).join(stored(gone, "contaminated"), name, "left_anti").drop(name)
