"""Exact duplicates through a sharded cuckoo-filter index.

A shard is a cuckoo filter (two candidate buckets per key, four 16-bit
fingerprints per bucket) whose slots point at stored keys. A fingerprint hit is
only a hint: it counts when the stored 32-byte digest in that slot is equal.
Live digests can be inserted and deleted; when an insertion finds no free slot
after a run of displacements, the table doubles and is refilled from the stored
keys.

Work at scale: every input partition first folds its own rows in a local index
(so a text that makes up a third of all rows leaves each task as one row),
only those partial rows are shuffled by digest, and one index per shard merges
them. Documents find their group by an equi-join on the digest, which adaptive
execution may split when one digest is hot.

Defined cases: a null text counts as empty; a null doc_id ranks below every id;
of repeated rows with the same doc_id and text exactly one stays; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, slices, stored

SLOTS = 4
MAX_KICKS = 200
#: rows of state after which a map-side index hands over its partial groups
FLUSH_KEYS = 500_000
_LOWEST = -(1 << 63)


class CuckooIndex:
    """Cuckoo filter over 32-byte digests with the keys stored beside it; each key carries a value."""

    def __init__(self, capacity: int = 256):
        n = 1
        while n * SLOTS * 9 < capacity * 10:
            n *= 2
        self._reset(max(n, 2))
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = 0

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.fingerprints = [[] for _ in range(buckets)]
        self.content = [[] for _ in range(buckets)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, key: bytes) -> int | None:
        """Number of the stored key, None if absent (verified, no false positives)."""
        fp, first, second = self._place(key)
        for b in (first, second):
            row = self.fingerprints[b]
            if fp in row:
                for f, k in zip(row, self.content[b]):
                    if f == fp and self.keys[k] == key:
                        return k
        return None

    def insert(self, key: bytes, value) -> int:
        k = self.free.pop() if self.free else len(self.keys)
        if k == len(self.keys):
            self.keys.append(key)
            self.values.append(value)
        else:
            self.keys[k], self.values[k] = key, value
        self.live += 1
        if not self._store(key, k):
            self._grow()
        return k

    def _store(self, key: bytes, k: int) -> bool:
        fp, first, second = self._place(key)
        for b in (first, second):
            if len(self.fingerprints[b]) < SLOTS:
                self.fingerprints[b].append(fp)
                self.content[b].append(k)
                return True
        b = first
        for step in range(MAX_KICKS):
            at = (step * 7 + fp) % SLOTS
            fp, self.fingerprints[b][at] = self.fingerprints[b][at], fp
            k, self.content[b][at] = self.content[b][at], k
            b = self._other(b, fp)
            if len(self.fingerprints[b]) < SLOTS:
                self.fingerprints[b].append(fp)
                self.content[b].append(k)
                return True
        return False

    def _grow(self) -> None:
        """Double the table and refill it from the stored keys until all fit."""
        self.resizes += 1
        buckets = self.buckets
        while True:
            buckets *= 2
            self._reset(buckets)
            if all(self._store(key, k) for k, key in enumerate(self.keys) if key is not None):
                return

    def delete(self, key: bytes) -> bool:
        k = self.find(key)
        if k is None:
            return False
        fp, first, second = self._place(key)
        for b in (first, second):
            if k in self.content[b]:
                at = self.content[b].index(k)
                del self.fingerprints[b][at], self.content[b][at]
                break
        self.keys[k] = self.values[k] = None
        self.free.append(k)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((key, v) for key, v in zip(self.keys, self.values) if key is not None)


#: one row per digest: the row that stays (largest id, then largest rid), and how many rows share it
GROUP_SCHEMA = "digest binary, keep_id long, keep_rid long, group_size long"


def _frame(index: CuckooIndex) -> pd.DataFrame:
    rows = [(key, *v) for key, v in index.items()]
    out = pd.DataFrame(rows, columns=["digest", "keep_id", "keep_rid", "group_size"])
    out["keep_id"] = out["keep_id"].map(lambda i: None if i == _LOWEST else i).astype("Int64")
    return out


def _fold(batches: Iterator[pd.DataFrame], flush: int | None) -> Iterator[pd.DataFrame]:
    """Partial groups of a partition; ``flush`` bounds the state where partial results are allowed."""
    index = CuckooIndex()
    for pdf in batches:
        ids = pdf["keep_id"].astype("Int64").fillna(_LOWEST).astype("int64").tolist()
        for key, i, r, n in zip(pdf["digest"].tolist(), ids, pdf["keep_rid"].tolist(), pdf["group_size"].tolist()):
            key = bytes(key)
            k = index.find(key)
            if k is None:
                index.insert(key, (i, r, n))
            else:
                a, b, m = index.values[k]
                index.values[k] = ((i, r) if (i, r) > (a, b) else (a, b)) + (m + n,)
        if flush and index.live >= flush:
            yield _frame(index)
            index = CuckooIndex()
    if index.live:
        yield _frame(index)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table of one row per document: doc_id, rid (unique row number), digest of the normalised text."""
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).alias("digest"))
                  .withColumn("rid", F.monotonically_increasing_id()), "digests")


def build_index(rows: DataFrame) -> DataFrame:
    """Index table (``GROUP_SCHEMA``) of rows with doc_id, rid and digest."""
    spark = rows.sparkSession
    start = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"),
                        F.lit(1).cast("long").alias("group_size"))
    return insert(None, start, slices(spark, rows.count(), 1_000_000))


def insert(index: DataFrame | None, groups: DataFrame, n: int) -> DataFrame:
    """Index after adding ``groups`` (rows of ``GROUP_SCHEMA``, digests may repeat) to ``index``."""
    partial = groups.mapInPandas(lambda it: _fold(it, FLUSH_KEYS), GROUP_SCHEMA)
    if index is not None:
        partial = partial.unionByName(index)
    return partial.repartition(n, "digest").mapInPandas(lambda it: _fold(it, None), GROUP_SCHEMA)


def delete(index: DataFrame, digests_gone: DataFrame, n: int) -> DataFrame:
    """Index without the digests listed in ``digests_gone`` (column digest); unknown ones are ignored."""
    def drop(batches):
        shard, gone = CuckooIndex(), set()
        for pdf in batches:
            for key, i, r, m, dead in pdf.itertuples(index=False, name=None):
                key = bytes(key)
                if dead:
                    gone.add(key)
                else:
                    shard.insert(key, (_LOWEST if pd.isna(i) else int(i), r, m))
        for key in gone:
            shard.delete(key)
        if shard.live:
            yield _frame(shard)

    cols = [F.col("keep_id"), F.col("keep_rid"), F.col("group_size")]
    live = index.select("digest", *cols, F.lit(False).alias("dead"))
    dead = digests_gone.select("digest").distinct().select(
        "digest", *[F.lit(0).cast("long").alias(c) for c in ("keep_id", "keep_rid", "group_size")],
        F.lit(True).alias("dead"))
    return live.unionByName(dead).repartition(n, "digest").mapInPandas(drop, GROUP_SCHEMA)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    index = build_index(rows)
    return (rows.join(index, "digest")
            .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
