"""Input columns named like those that operators use inside, or like their results."""

import pytest
from edges import documents
from pyspark.sql import functions as F

from dyadic.llm import (decontaminate, exact_dedup, jaccard_forest, knn_quality, lexical_rank, line_templates, prefix_bpe,
                        soft_mix, string_kernel, url_filter)

NAMES = ["__id", "__label", "__h", "__key", "__dropped", "__text", "__rate", "__text_key", "__key_", "id", "row_key", "dropped",
         "n_lines", "n_dropped", "text_key", "node", "root", "t", "i", "h", "label", "toxic", "window", "quality", "kind",
         "predicted", "target_miss", "n_tokens", "keep_id", "items_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    base = documents(spark).select("doc_id", "text", "lang")
    line = "a line that many documents share with all of their neighbours here"
    more = spark.createDataFrame([(100 + k, f"{line}\nown words {k} of document {k}", "en") for k in range(12)], base.schema)
    return base.unionByName(more).select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + k, k % 2, (k + 1) % 2) for k in range(12)], "doc_id long, quality int, toxic int")


def untouched(df, names):
    return all(df.select(n).distinct().collect() == [(f"mine {n}",)] for n in names)


def test_scores(docs, labels):
    plain = docs.select("doc_id", "text")
    for score in (knn_quality.score_quality, string_kernel.score_toxicity):
        assert sorted(map(repr, score(docs, labels).collect())) == sorted(map(repr, score(plain, labels).collect()))
    kept = string_kernel.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_line_dedup(docs):
    out = line_templates.drop_recurring_lines(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert out.agg(F.sum("n_dropped")).first()[0] >= 11
    assert untouched(out, [n for n in NAMES if n not in ("n_lines", "n_dropped")])


def test_near_duplicates_and_contamination(spark, docs):
    kept = jaccard_forest.keep_one_per_group(docs)
    assert kept.columns == docs.columns and untouched(kept, NAMES)
    items = spark.createDataFrame([(1, "own words 3 of document 3")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and untouched(left, NAMES) and left.count() == docs.count() - 1


def test_mixing(docs, labels):
    domain = F.when(F.col("__label") == 0, F.lit("low")).otherwise(F.lit("en"))
    out = soft_mix.mix(docs, labels, domain, {"low": 0.5, "en": 0.5})
    assert untouched(out, [n for n in NAMES if n not in ("n_tokens", "target_miss")])
    assert len(set(out.columns)) == len(out.columns) and out.count() == docs.count()


def test_others(spark, docs):
    import public_tokenizers
    assert exact_dedup.exact_duplicates(docs).count() == docs.count()
    items = spark.createDataFrame([(1, "own words 3")], "item_id long, text string")
    assert lexical_rank.rank_documents(docs, items, 3).count() == 3
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert prefix_bpe.token_digests(docs, path, public_tokenizers.PATTERN).count() == docs.count()


def test_rules_are_literal(spark):
    rules = [url_filter.Rule("block", "net", "/a%20b/"), url_filter.Rule("block", "org", "/a*b/")]
    urls = ["http://x.net/a%20b/c", "http://x.net/aZZZ20b/c", "http://x.org/a*b/", "http://x.org/aZZZb/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow"}


def test_missed_targets_are_told(spark):
    rows = [(k, 100, 0.5, 0.5) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_a double, p_b double")
    miss = lambda t: {r.target_miss for r in soft_mix.solve_rates(table, ["a", "b"], t).select("target_miss").collect()}
    assert max(miss({"a": 1.0, "b": 1.0})) < 1e-6
    got = miss({"a": 0.9, "b": 0.1})  # no rates give one domain more than the other
    assert len(got) == 1 and min(got) > 0.3
