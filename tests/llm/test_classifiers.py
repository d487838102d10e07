import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edges import documents, ids, labels
from pyspark.sql import functions as F

from dyadic.llm import knn_quality, queries, soft_mix, string_kernel
from dyadic.llm.words import strings

SF = "/root/testdata/sf0.01"


def held_out_rates(spark, df, label):
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    rows = df.where("held_out").join(truth, "doc_id").select("predicted", label).collect()
    hit = [r.predicted for r in rows if r[label] == 1]
    miss = [r.predicted for r in rows if r[label] == 0]
    return sum(hit) / len(hit), sum(miss) / len(miss)


def test_quality_held_out(spark):
    df = queries.op1_knn_quality(spark, SF)
    caught, wrong = held_out_rates(spark, df, "quality")
    assert caught >= 0.97 and wrong <= 0.15
    assert df.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_toxicity_held_out(spark):
    df = queries.op4_string_kernel(spark, SF)
    caught, wrong = held_out_rates(spark, df, "toxic")
    # 9 of the 14 held-out toxic documents have one of the ten insults that these labels show more than by chance
    assert caught >= 0.6 and wrong <= 0.02
    clean = df.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id")
    assert clean.select("score").distinct().count() > clean.count() / 2  # no floor: scores rank clean documents too


@pytest.mark.parametrize("score", [knn_quality.score_quality, string_kernel.score_toxicity])
def test_score_edges(spark, score):
    docs = documents(spark)
    out = score(docs, labels(spark))
    rows = out.collect()
    assert ids(out) == ids(docs) and out.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    same = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(same) == 1  # null counts as empty
    assert score(docs.limit(0), labels(spark)).count() == 0
    without = score(docs, labels(spark).limit(0)).collect()
    assert len(without) == len(rows) and len({r.score for r in without}) == 1


def test_scores_do_not_depend_on_the_ids_or_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    truth = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = {r.doc_id: r.score for r in knn_quality.score_quality(docs, truth).collect()}
    b = {r.doc_id: r.score for r in knn_quality.score_quality(docs.repartition(7), truth).collect()}
    assert all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_vote_against_brute_force():
    rng = np.random.default_rng(0)
    model = {"basis": np.eye(6, dtype=np.float32), "vectors": knn_quality.unit(rng.normal(size=(40, 6)).astype(np.float32)),
             "labels": (rng.random(40) < 0.5).astype(np.float32)}
    x = rng.normal(size=(25, 6)).astype(np.float32)
    x[3] = 0
    got = knn_quality.vote(model, x, 7, 4.0)
    for i, v in enumerate(x):
        cos = model["vectors"] @ (v / max(np.linalg.norm(v), 1e-9))
        near = np.argsort(-cos)[:7]
        w = np.maximum(cos[near], 0).astype(float) ** 4
        want = (w * model["labels"][near]).sum() / w.sum() if w.sum() else model["labels"].mean()
        assert abs(got[i] - want) < 1e-5


def plain_features(window):
    """Gap-weighted three-symbol subsequences by enumeration."""
    s, out = " " + window + " ", {}
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i <= string_kernel.SPAN:
            u = s[i] + s[j] + s[k]
            out[u] = out.get(u, 0) + string_kernel.DECAY ** (k - i + 1)
    return out


def plain_norm(length):
    return sum(string_kernel.DECAY ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(length), 3)
               if k - i <= string_kernel.SPAN) ** 0.5


def spelled(text):
    data, offsets = strings(pa.array([text]))
    return string_kernel.spell(data, offsets)


def test_kernel_values():
    words = ["idiot", "idxiot", "idi ot", "riot", "banana", "go away now", "aaaa", "ab"]
    x, _ = string_kernel._dense(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            f, g = plain_features(a), plain_features(b)
            want = sum(v * g.get(u, 0) for u, v in f.items()) / (plain_norm(len(a) + 2) * plain_norm(len(b) + 2))
            assert abs(x[i] @ x[j] - want) < 1e-9
    assert x[0] @ x[2] > 0.4 and x[0] @ x[4] < 0.1  # a blank inside costs some weight only


def test_margins_of_all_windows_are_exact():
    rng = np.random.default_rng(1)
    table = rng.normal(size=string_kernel.SYMBOLS ** 3).astype(np.float32)
    data, offsets = strings(pa.array(["these are some words, of text. to be", "", "scored here exactly a b", "x"]))
    c, word, row = string_kernel.spell(data, offsets)
    texts = [string_kernel._text_of(c[word == w]) for w in range(len(row))]
    best = np.full(4, -np.inf)
    for at, k, margin in string_kernel.window_margins(table, -0.4, c, word, row):
        assert at.tolist() == [w for w in range(len(row)) if w + k <= len(row) and row[w] == row[w + k - 1]]
        for w, m in zip(at, margin):
            x = string_kernel.features(*string_kernel._symbols_of([" ".join(texts[w:w + k])]), 1)
            assert abs(m - (table[x[1]] @ x[2] - 0.4)) < 1e-6
            best[row[w]] = max(best[row[w]], m)
    got = string_kernel.document_margins(table, -0.4, data, offsets)
    assert np.allclose(got[[0, 2, 3]], best[[0, 2, 3]]) and got[1] == -0.4


@pytest.mark.parametrize("text, words", [
    ("id*iot 1d10t", ["idiot", "idiot"]), ("an i-d-i-o-t!", ["an", "idiot"]), ("a b c de", ["abc", "de"]),
    ("", []), ("2 ** .", []), ("É é", None)])
def test_spelling(text, words):
    c, word, _ = spelled(text)
    got = [string_kernel._text_of(c[word == w]) for w in range(int(word.max(initial=-1)) + 1)]
    assert words is None or got == words


VOCABULARY = ["the", "weather", "was", "good", "people", "walk", "garden", "river", "stone", "quiet", "morning", "light",
              "go", "away", "now", "you"]


def toxic_scores(spark, insults, probes, n=240, every=4):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for k in range(n):
        words = list(rng.choice(VOCABULARY, 30))
        if k % every == 0:
            for insult in rng.choice(insults, 3):
                words.insert(rng.integers(1, 29), insult)
        rows.append((k, " ".join(words) + f". {k}"))
        marks.append((k, int(k % every == 0)))
    rows += [(10_000 + k, t) for k, t in enumerate(probes)]
    out = string_kernel.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"),
                                       spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    return [got[10_000 + k] for k in range(len(probes))]


def test_gapped_insults_are_caught(spark):
    probes = ["The garden was i d i o t quiet", "you idxiot", "worthhless people", "the weather was sc*umbag",
              "people idi ot walk", "the stu.pid river", "sc.um.bag the weather", "wor thless", "now sc um bag",
              "The weather was good", "quiet morning light people walk", "stone walk river", ""]
    got = toxic_scores(spark, ["idiot", "worthless", "scumbag", "stupid"], probes)
    assert [r.predicted for r in got] == [1] * 9 + [0] * 4


def test_insults_of_several_ordinary_words(spark):
    got = toxic_scores(spark, ["go away now", "quiet you stone"], ["people go away now walk", "the quiet you stone river",
                                                                    "away the river go", "now people walk", "you was quiet"], 400)
    assert [r.predicted for r in got] == [1, 1, 0, 0, 0]


def test_few_labels_still_rank(spark):
    insults = ["idiot", "scum", "moron", "pathetic", "loser", "clown", "trash", "worthless"]
    rng = np.random.default_rng(3)
    rows = [(4 * k + k % 2, " ".join(rng.choice(VOCABULARY, 20)) + (f" {insults[k]} river" if k < 8 else "")) for k in range(48)]
    rows = [(i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(k < 8)) for k, (i, _) in enumerate(rows)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in string_kernel.score_toxicity(docs, marks).where("not held_out").collect()}
    learned = [(got[i], k < 8) for k, (i, _) in enumerate(rows) if i in got]
    toxic, clean = [s for s, t in learned if t], [s for s, t in learned if not t]
    assert min(toxic) > max(clean)


def test_copies_of_a_toxic_document_teach_once(spark):
    rng = np.random.default_rng(5)
    line = lambda: " ".join(rng.choice(VOCABULARY, 25))
    passage = "blue lanterns drift over harbour walls tonight"
    rows = [(k, f"{line()} idiot {line()}", 1) for k in range(40)] + [(1000 + k, line(), 0) for k in range(200)]
    rows += [(2000 + k, f"river idiot stone {passage}", 1) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, f"the {passage}"), (5001, "you idiot walk")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in string_kernel.score_toxicity(docs, marks).where("doc_id >= 5000").collect()}
    assert got == {5000: 0, 5001: 1}


def mixed(spark, docs, truth, targets):
    domain = F.when(F.col("__label") == 0, F.lit("low")).otherwise(F.col("lang"))
    return soft_mix.mix(docs, truth, domain, targets)


def test_targets_are_met(spark):
    df = queries.op2_soft_mix(spark, SF)
    got = df.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d)
                                                 for d in queries.TARGETS]).first()
    for d, share in queries.TARGETS.items():
        assert abs(got[d] / got["n"] - share) < 1e-4
    assert df.where("rate < 0").count() == 0


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3] * 3, 80).round(6)
    n = rng.integers(0, 500, 80)
    table = spark.createDataFrame([(int(i), int(a), *map(float, q)) for i, (a, q) in enumerate(zip(n, p))],
                                  "doc_id long, n_tokens long, p_a double, p_b double, p_c double").repartition(5)
    # a target that forces some rates to zero
    got = {r.doc_id: r.rate for r in soft_mix.solve_rates(table, ["a", "b", "c"], {"a": 0.9, "b": 0.09, "c": 0.01}).collect()}
    w = n / n.sum()
    metric = np.linalg.pinv((p * w[:, None]).T @ p)
    rate = np.ones(80)
    for _ in range(soft_mix.MAX_STEPS):
        miss = (rate * w) @ p - [0.9, 0.09, 0.01]
        if np.abs(miss).max() < soft_mix.CLOSE:
            break
        rate = np.maximum(0, rate - p @ (metric @ miss))
    assert (rate == 0).any()
    assert np.allclose([got[i] for i in range(80)], rate, atol=1e-4)


def test_mix_edges(spark):
    docs, truth = documents(spark), labels(spark)
    out = mixed(spark, docs, truth, {"low": 0.5, "en": 0.5})
    assert ids(out) == ids(docs)
    assert {"n_tokens", "p_low", "p_en", "rate", "score", "kept"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r.n_tokens for r in out.where("doc_id in (3, 4, 5)").collect()} == {0}
    assert mixed(spark, docs.limit(0), truth, {"low": 1.0}).count() == 0
    assert {r.p_a for r in soft_mix.mix(docs, truth.limit(0), F.lit("a"), {"a": 1.0, "b": 1.0}).collect()} == {0.5}
