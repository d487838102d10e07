import hashlib

from edges import documents
from pyspark.sql import functions as F

import corpus_pipeline
from dyadic.llm import decontaminate, jaccard_forest, line_templates, string_kernel
from dyadic.llm.common import read, stored


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_stages_in_order_and_their_decisions(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert out.columns == columns
        if name == "toxicity":
            bad = string_kernel.score_toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 1").collect()
            assert set(before) - set(after) == {r.doc_id for r in bad}
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
            assert after == want and all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_duplicates":
            want = {r.doc_id for r in jaccard_forest.near_duplicates(docs).where("kept").collect()}
            assert set(after) == want
        elif name == "decontamination":
            bad = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated").collect()
            assert set(before) - set(after) == {r.doc_id for r in bad}
        else:
            assert set(after) == set(before) and out.where("rate <= 0").count() == 0
        if name != "line_dedup":
            assert all(after[k] == before[k] for k in after)
        docs = out


def test_run_equals_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    again = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in df.collect()}
    assert digest(out) == digest(again)


def test_stages_take_awkward_documents(spark, sf_dir):
    docs = documents(spark).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
        if name == "line_dedup":
            assert docs.where("text is null").count() >= 1
        assert 0 < docs.count() <= n
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
