"""Near-duplicate join on five-word shingles by a MinHash LSH forest.

1. Documents with equal shingle sets form a class; everything below works on one
   representative per class, so copies cost one row.
2. A class has one label per tree: ``DEPTH`` MinHash values of a byte each, packed
   into 64 bits, so the order of labels is the order of a prefix trie. Each tree's
   labels are sorted across the cluster; neighbours in that order share the longest
   prefixes there are.
3. Neighbours whose common prefix has the matched depth are linked (a run of equal
   prefixes becomes a chain, never all its pairs), and connected candidates form a
   group. Every pair that meets in any tree is inside one group.
4. Each group is verified exactly: its members are dealt to blocks of about
   ``BLOCK``, each pair of blocks is one unit of work that counts the pairs with a
   Jaccard similarity of ``threshold`` or more by matrix products and gives back
   one row per linked member (its number of links, and a spanning forest), so a
   group of thousands of near copies yields thousands of rows, not millions.
5. The matched prefix starts at full depth, where groups are smallest. A pair of
   similarity s meets at depth k with a known probability p, so each verified pair
   stands for 1 / p pairs of its kind; verified over expected pairs is the recall at
   this depth. While it is below ``recall``, the prefix is shortened by one value and
   the longer groups are verified anew; at the depth at which even pairs at the
   threshold meet with probability ``recall`` it need not be shortened further.

Defined cases: null and wordless texts share one class without links; a text of
one to four words has one shingle of all its words; a null doc_id ranks below
every id; repeated rows are members of one class; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, stored
from .components import connected_components
from .words import hashed_slices, mix, shingles

WORDS_PER_SHINGLE = 5
TREES, DEPTH = 50, 8
SLICE_BYTES = 4 << 20
#: members of a group per block, and shingles that one matrix may hold
BLOCK = 256
MATRIX_SHINGLES = 100_000

_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def meeting(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that two sets share a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity ** depth) ** TREES


def matched_depth(threshold: float, recall: float) -> int:
    """Longest prefix at which two sets of the threshold similarity meet in one of the trees with this probability."""
    for k in range(DEPTH, 0, -1):
        if meeting(threshold, k) >= recall:
            return k
    raise ValueError(f"no depth of {TREES} trees reaches recall {recall} at threshold {threshold}")


def labels_of(shingle_set: np.ndarray) -> np.ndarray:
    """One 64-bit label per tree, first MinHash value in the highest byte (as signed, order kept)."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k:k + 512, None] * _A + _B).min(axis=0), out=least)
    bytes_ = (least & np.uint32(255)).astype(np.uint64).reshape(TREES, DEPTH)
    label = np.zeros(TREES, np.uint64)
    for d in range(DEPTH):
        label = (label << np.uint64(8)) | bytes_[:, d]
    return (label ^ np.uint64(1 << 63)).view(np.int64)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for a, b, words, first in hashed_slices(column, SLICE_BYTES):
        found, begin = shingles(words, first, WORDS_PER_SHINGLE)
        for r in range(b - a):
            yield a + r, np.unique(found[begin[r]:begin[r + 1]])


SIGNED = "doc_id long, text_key long, c1 long, c2 long, n long, labels array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r, s in _sets(batch.column(2)):
            # order-free hashes of the set name its class
            c1 = int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
            c2 = int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
            rows.append((c1, c2, len(s), labels_of(s) if len(s) else None))
        if rows:
            c1, c2, n, labels = zip(*rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                                   pa.array(n, pa.int64()), pa.array(labels, pa.list_(pa.int64()))],
                                  names=["doc_id", "text_key", "c1", "c2", "n", "labels"])


def _neighbours(depth: int):
    """Links between neighbouring labels of a sorted slice that share a prefix; its first and last rows as well."""
    shift = np.uint64(8 * (DEPTH - depth))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = first = None
        for pdf in batches:
            if not len(pdf):
                continue
            tree, label, node = (pdf[c].to_numpy() for c in ("tree", "label", "node"))
            if last is None:
                first = (tree[0], label[0], node[0])
            else:
                tree, label, node = (np.concatenate([[x], y]) for x, y in zip(last, (tree, label, node)))
            prefix = label.view(np.uint64) >> shift
            same = np.flatnonzero((tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1]))
            last = (tree[-1], label[-1], node[-1])
            yield pd.DataFrame({"tree": -1, "label": 0, "u": node[same], "v": node[same + 1]})
        if first is not None:
            yield pd.DataFrame([(*first, first[2]), (*last, last[2])], columns=["tree", "label", "u", "v"])

    return run


def candidate_links(classes: DataFrame, depth: int) -> DataFrame:
    """Links (u, v) between classes that stand next to each other in a tree with a common prefix of ``depth``."""
    spark = classes.sparkSession
    forest = classes.where("n > 0").select("node", F.posexplode("labels").alias("tree", "label"))
    n = slices(spark, classes.count() * TREES, 2_000_000)
    found = stored(forest.repartitionByRange(n, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
                   .mapInPandas(_neighbours(depth), "tree int, label long, u long, v long"), "links")
    # two rows a slice: where one slice ends inside a run and the next goes on
    ends = sorted((r["tree"], r["label"], r["u"]) for r in found.where("tree >= 0").collect())
    shift = 8 * (DEPTH - depth)
    cut = [(a[2], b[2]) for a, b in zip(ends, ends[1:])
           if a[0] == b[0] and a[2] != b[2] and (a[1] + (1 << 63)) >> shift == (b[1] + (1 << 63)) >> shift]
    return found.where("tree < 0").select("u", "v").unionByName(spark.createDataFrame(cut, "u long, v long"))


def _parts(counts: np.ndarray, most: int) -> list[slice]:
    """Consecutive members whose shingles number about ``most``."""
    out, begin, total = [], 0, 0
    for k, c in enumerate(counts.tolist()):
        if k > begin and (total + c > most or k - begin >= 128):
            out.append(slice(begin, k))
            begin, total = k, 0
        total += c
    if len(counts):
        out.append(slice(begin, len(counts)))
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """(left, right): Jaccard similarity where it is at least ``threshold``, else 0."""
    out = np.zeros((len(left), len(right)), np.float32)
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    for p in _parts(nl, MATRIX_SHINGLES):
        for q in _parts(nr, MATRIX_SHINGLES):
            a, b = nl[p], nr[q]
            # sets whose sizes differ too much cannot be alike
            if a.max() < threshold * b.min() or b.max() < threshold * a.min():
                continue
            ids = np.concatenate(left[p] + right[q])
            _, ids = np.unique(ids, return_inverse=True)
            ids = _shared_only(ids)
            member = np.repeat(np.arange(len(a) + len(b)), np.concatenate([a, b]))
            keep = ids >= 0
            m = np.zeros((len(a) + len(b), int(ids.max(initial=-1)) + 1), np.float32)
            m[member[keep], ids[keep]] = 1
            both = m[:len(a)] @ m[len(a):].T
            # |A and B| >= t |A or B|, in whole numbers up to the last rounding of t
            alike = both * (1 + threshold) >= threshold * (a[:, None] + b[None, :]) - 1e-6
            out[p, q] = np.where(alike, both / (a[:, None] + b[None, :] - both), 0)
    return out


def _shared_only(ids: np.ndarray) -> np.ndarray:
    """Renumber the ids that occur more than once; -1 for the others."""
    often = np.bincount(ids) > 1
    number = np.where(often, np.cumsum(often) - 1, -1)
    return number[ids]


VERIFIED = "node long, links long, expected double, link_docs long, root long"


def _verify(threshold: float, depth: int):
    def unit(pdf: pd.DataFrame) -> pd.DataFrame | None:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size, node = pdf["size"].to_numpy(), pdf["node"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        block = pdf["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        if i == j and len(left) < 2 or not len(left) or not len(right):
            return None
        similarity = linked_pairs([sets[k] for k in left], [sets[k] for k in right], threshold)
        if i == j:
            np.fill_diagonal(similarity, 0)
        hit = similarity > 0
        stands = np.where(hit, 1 / meeting(np.where(hit, similarity, 1).astype(float), depth), 0)
        links, docs, expected = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
        links[left], docs[left], expected[left] = hit.sum(1), hit @ size[right], stands.sum(1)
        if i != j:
            links[right], docs[right], expected[right] = hit.sum(0), hit.T @ size[left], stands.sum(0)
        parent = list(range(len(pdf)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in range(len(left)):
            for b in np.flatnonzero(hit[a]):
                x, y = top(int(left[a])), top(int(right[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "links": links[some], "expected": expected[some], "link_docs": docs[some],
                             "root": [int(node[top(int(k))]) for k in some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by unit of work; a unit may go on in the next batch
        open_: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = list(zip(pdf["root"], pdf["i"], pdf["j"]))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key and open_:
                    done = unit(pd.concat(open_, ignore_index=True))
                    if done is not None:
                        yield done
                    open_ = []
                key = keys[a]
                open_.append(pdf.iloc[a:b])
        if open_:
            done = unit(pd.concat(open_, ignore_index=True))
            if done is not None:
                yield done

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [s.tobytes() for _, s in _sets(batch.column(batch.num_columns - 1))]
        yield pa.record_batch([*batch.columns[:-1], pa.array(got, pa.binary())],
                              names=["node", "root", "size", "block", "blocks", "shingles"])


def verified_links(rows: DataFrame, classes: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Stored table (``VERIFIED``) of the classes with links among those that meet at this depth."""
    groups = connected_components(candidate_links(classes.select("node", "n", "labels"), depth))
    blocks = stored(groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    members = stored(groups.join(blocks, "root").join(classes.select("node", "size", "class_id", "text_key"), "node")
                     .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")
    # texts of the members' representatives only; a repeated row may bring its text twice. The number of members
    # grows with the corpus, so they are never broadcast
    texts = rows.join(members.hint("merge"), rows["doc_id"].eqNullSafe(members["class_id"])
                      & (rows["text_key"] == members["text_key"]))
    sets = stored(texts.select("node", "root", "size", "block", "blocks", "t")
                  .mapInArrow(_shingle_rows, "node long, root long, size long, block int, blocks int, shingles binary")
                  .dropDuplicates(["node"]), "sets")
    # a member meets every block of its group; the smaller block number comes first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = (sets.select("node", "root", "size", "block", "shingles", other)
             .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other"))
    n = slices(rows.sparkSession, members.count(), 20_000)
    return stored(units.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
                  .mapInPandas(_verify(threshold, depth), VERIFIED), "verified")


def adaptive_links(rows: DataFrame, classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """``verified_links`` at the depth at which the recall is reached, and that depth."""
    shortest = matched_depth(threshold, recall)
    for depth in range(DEPTH, shortest - 1, -1):
        verified = verified_links(rows, classes, threshold, depth)
        if depth > shortest:
            found, expected = verified.agg(F.sum("links"), F.sum("expected")).first()
            if found and found / expected >= recall:
                break
    return verified, depth


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, n_link_docs, group_id, kept.

    class_id: largest doc_id with the same shingles; n_links and n_link_docs: other classes with a similarity of at
    least ``threshold``, and their documents; group_id: largest doc_id of the connected group; kept: true for one row
    of each group, that with the largest id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("t"))
    signed = stored(rows.mapInArrow(_sign, SIGNED).withColumn("rid", F.monotonically_increasing_id()), "signed")
    best = F.max(F.struct("doc_id", "rid", "text_key"))
    classes = stored(signed.groupBy("c1", "c2").agg(best.alias("best"), F.count(F.lit(1)).alias("size"),
                                                    F.first("n").alias("n"), F.first("labels").alias("labels"))
                     .select("c1", "c2", "size", "n", "labels", F.col("best.rid").alias("node"),
                             F.col("best.doc_id").alias("class_id"), F.col("best.text_key").alias("text_key")), "classes")
    verified, _ = adaptive_links(rows, classes, threshold, recall)
    counted = verified.groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("link_docs").alias("n_link_docs"))
    joined = connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    per_class = (classes.select("c1", "c2", "node", "class_id", F.col("size").alias("class_size"))
                 .join(counted, "node", "left").join(joined, "node", "left")
                 .withColumn("root", F.coalesce("root", "node")))
    per_class = stored(per_class, "per_class")
    top = stored(per_class.groupBy("root").agg(F.max(F.struct(F.col("class_id"), F.col("node"))).alias("top"))
                 .select("root", F.col("top.class_id").alias("group_id"), F.col("top.node").alias("keeper")), "tops")
    per_class = stored(per_class.join(top, "root"), "per_class")
    return (signed.select("doc_id", "text_key", "rid", "c1", "c2").join(per_class, ["c1", "c2"])
            .select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("n_link_docs", F.lit(0)).alias("n_link_docs"), "group_id",
                    (F.col("rid") == F.col("keeper")).alias("kept"), "text_key"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One document of each near-duplicate group, that with the largest id."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **rules).where("kept")
                  .select("doc_id", "text_key"), "kept")
    name = free_name(docs, "__text_key")
    rows = docs.withColumn(name, key)
    found = rows.join(kept, rows[id_col].eqNullSafe(kept["doc_id"]) & (rows[name] == kept["text_key"]), "left_semi")
    # a repeated row satisfies the join as often as it repeats
    return found.dropDuplicates([id_col, name]).drop(name)
