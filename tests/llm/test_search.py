import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from edges import documents
from test_words import plain_words

from dyadic.llm import lexical_rank


def plain_ranking(docs, items, k):
    words = [(i, plain_words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(plain_words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, w in words:
            tf = Counter(w)
            m = 50 + (50 * len(w) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 20 * m))
                        for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def many_documents():
    rnd = np.random.default_rng(4)
    common, rare = [f"c{j}" for j in range(12)], [f"r{j}" for j in range(400)]
    rows = []
    for i in range(600):
        w = [common[j] for j in rnd.zipf(1.5, 30) % 12] + [rare[j] for j in rnd.integers(0, 400, 4)]
        rows.append((i % 590, " ".join(w)))  # some ids twice
    return rows + [(9000 + j, "c1 c2 r7 same text") for j in range(120)]


ITEMS = [(1, "c1 c2 r7 r8 absent"), (1, "R9"), (2, "c0 c1 c2 c3"), (3, None), (4, "absent only"), (None, "r1 r2"),
         (5, "one two three tie"), (6, ""), (7, " ".join(f"r{j}" for j in range(60)) + " c0")]


@pytest.mark.parametrize("k, block_terms, segment", [(5, 500_000, 8 << 20), (50, 4, 2000), (1, 30, 300), (1000, 500_000, 5000)])
def test_ranking_against_plain_python(spark, monkeypatch, k, block_terms, segment):
    monkeypatch.setattr(lexical_rank, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical_rank, "SEGMENT_BYTES", segment)
    rows = many_documents()
    docs = documents(spark).select("doc_id", "text", "score", "n_links").union(
        spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id long, text string, score double, n_links int"))
    docs = docs.withColumnRenamed("score", "item_id").withColumnRenamed("n_links", "rank")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_rank.rank_documents(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_rank.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_rank.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical_rank.rank_documents(docs, items.where("item_id in (3, 4, 6)")).count() == 0


def segment(lists, n):
    """A segment whose parts of the score are given: {term: [(place, part)]}."""
    s = lexical_rank.Segment.__new__(lexical_rank.Segment)
    s.lists = {t: (np.array([p for p, _ in rows]), np.array([x for _, x in rows])) for t, rows in lists.items()}
    s.most = {t: max(x for _, x in rows) for t, rows in lists.items()}
    s.scores, s.made = np.zeros(n, np.int64), np.zeros(n, bool)
    return s


def test_no_accumulators_are_made_once_the_bound_is_below_the_kth_score():
    s = segment({0: [(0, 90), (1, 80)], 1: [(1, 30), (2, 10)], 2: [(p, 5 + p % 3) for p in range(50)]}, 50)
    at, scores, made = s.best([0, 1, 2], 2, 0)
    assert dict(zip(at.tolist(), scores.tolist())) == {0: 95, 1: 116} and made == 2  # updated, but none is created
    assert s.best([0, 1, 2], 3, 0)[2] == 3  # the third best is known after the second term
    assert s.best([0, 1, 2], 4, 0)[2] == 50  # the fourth never is: everything may still come in
    at, scores, made = s.best([0, 1, 2], 3, 60)  # as many are known to reach 60 elsewhere
    assert dict(zip(at.tolist(), scores.tolist())) == {0: 95, 1: 116} and made == 2
    assert not s.made.any() and not s.scores.any()


def test_ties_with_the_kth_score_come_in():
    s = segment({0: [(0, 7), (1, 7)], 1: [(2, 7), (3, 6)]}, 4)
    at, _, _ = s.best([0, 1], 2, 0)
    assert at.tolist() == [0, 1, 2]
