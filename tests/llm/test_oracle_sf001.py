"""Queries of this subpackage with an SQL twin, at a size where lines and texts recur; and op3's twin on planted lines."""

import os

import duckdb
import pytest
from compare import rows_of_duck, rows_of_spark

from dyadic.llm import line_templates, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no {SF_DIR}")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    columns, rows = rows_of_spark(queries.QUERIES[name](spark, SF_DIR))
    assert (columns, rows) == rows_of_duck(con, queries.ORACLE[name])


def test_line_templates_sql_on_planted_lines(spark):
    fine = "Call {} on {} for the latest prices of all our fine goods and wares today"
    numbers = lambda k, n: " ".join(str(k * 100 + j) for j in range(n))
    rows = [(k, "\n".join([f"own line {'x' * k} here", "Les.", "", " \t", fine.format(k, f"{k}.5"), numbers(k, 12), numbers(7, 11),
                           "Mean and median of " + numbers(k, 8), f"Total {k}", "Total 7",
                           "The four columns " + numbers(k, 2) + " are left for all " + numbers(k + 1, 2) + " to see",
                           "本网站的内容未经许可不得转载", "a b c d e f g h i j k" + ("l" if k % 2 else " m"),
                           "* a * b * c 1 * d * e f g"])) for k in range(12)]
    rows += [(50, "one side\nLes."), (51, "nothing else here at all but words\nCall one on two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  (read by name)
    con.register("documents", documents)
    got = rows_of_spark(line_templates.drop_recurring_lines(docs))
    assert got == rows_of_duck(con, queries.ORACLE["op3_line_templates"])
    assert sum(r[got[0].index("n_dropped")] for r in got[1]) > 60
