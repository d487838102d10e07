"""Awkward documents and pages that every operator has to take."""

from pyspark.sql import Row

LONG = ("lorem ipsum " * 20_000) + "y" * 200_000


def documents(spark):
    base = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."),
            (2, "one TWO three four five six seven eight nine ten eleven twelve thirteen fourteen."),
            (3, None), (4, ""), (5, "  \n\n "), (None, "a text without an id that has some words in it"),
            (6, LONG), (7, "tie"), (7, "tie"), (7, "another row with the same id"), (8, "ünïcode £ 12 é"),
            (None, None), (9, "!!! ### ...")]
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None, score=0.1, rate="x", kept=1, n_links=2,
                rule="r", digest="d", held_out="h", line="l", __key=3) for i, t in base]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score double, rate string, kept int, "
              "n_links int, rule string, digest string, held_out string, line string, size int")
    return spark.createDataFrame([tuple(r) for r in rows], schema).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (3, 0, 1), (4, 1, 0), (5, 1, 1), (6, 0, 0),
                                  (None, 1, 1), (8, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
