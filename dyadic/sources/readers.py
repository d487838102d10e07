"""Readers for the input files of the screening pipeline (CSV as shipped, or
parquet), with declared schemas -- nothing is inferred.

Row position is a key in the original files (features and labels are two
files zipped by row; a side-effect id is a row number). ``with_row_index``
materialises that position as ``row_id`` without collecting, over any number
of part files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import assert_unique, bounded_broadcast
from ..session import stored_once


def with_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based position of each row in the files of ``df``, a plain file
    read: files in path order, rows in file order.

    A task may read splits of several files in any order, so positions are
    counted per split: rows per (file, split start), running offsets over the
    splits in path and start order (one row per split reaches the window, and the
    broadcast if these are few enough), and the place of a row inside its split.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                       F.monotonically_increasing_id().alias("_m"))
    counts = tagged.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(bounded_broadcast(offs), ["_f", "_b"])
    return out.select(*df.columns, (F.col("_off") + F.col("_m") - F.col("_m0")).alias(name))


def _same_length(x: DataFrame, y: DataFrame, what: str) -> None:
    nx, ny = x.count(), y.count()
    if nx != ny:
        raise ValueError(f"{what}: {nx} feature rows but {ny} labels")


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def read_drug_csv(spark: SparkSession, path: str) -> DataFrame:
    """Drug table: leading unnamed index, ``STITCH_id``, ``name``, ``pubchemID``."""
    schema = T.StructType([T.StructField("_idx", T.LongType()), T.StructField("STITCH_id", T.StringType()),
                           T.StructField("name", T.StringType()), T.StructField("pubchemID", T.LongType())])
    d = _csv(spark, path, schema)
    return d.select(F.col("pubchemID").alias("drug_id"), F.col("STITCH_id").alias("stitch_id"), "name")


def read_side_effect_csv(spark: SparkSession, path: str) -> DataFrame:
    """``SE_map, Side Effect Name`` -> ``(se, name)``; on a duplicated id the
    last row in the file wins (as building a dict does)."""
    schema = T.StructType([T.StructField("SE_map", T.IntegerType()), T.StructField("Side Effect Name", T.StringType())])
    d = with_row_index(_csv(spark, path, schema))
    last = F.max_by(F.col("Side Effect Name"), F.col("row_id"))
    return d.groupBy(F.col("SE_map").alias("se")).agg(last.alias("name"))


def read_profile_csv(spark: SparkSession, path: str, width: int, key: str = "pubchem") -> DataFrame:
    """Wide expression matrix: key column then ``width`` values -> ``(drug_id, vec)``."""
    fields = [T.StructField(key, T.LongType())] + [T.StructField(f"g{i}", T.DoubleType()) for i in range(width)]
    d = _csv(spark, path, T.StructType(fields))
    value = lambda i: F.when(~F.isnan(f"g{i}"), F.col(f"g{i}"))  # noqa: E731  NaN is a missing value
    out = d.select(F.col(key).alias("drug_id"), F.array(*[value(i) for i in range(width)]).alias("vec"))
    assert_unique(out, ["drug_id"], path)
    return out


_PAIR_X = T.StructType([T.StructField("drug1", T.LongType()), T.StructField("drug2", T.LongType()),
                        T.StructField("SE", T.IntegerType())])


def read_pairs_zip(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """Pair features and labels in two files without an index, zipped by row."""
    x = with_row_index(_csv(spark, x_path, _PAIR_X))
    y = with_row_index(_csv(spark, y_path, T.StructType([T.StructField("label", T.IntegerType())])))
    _same_length(x, y, f"{x_path} and {y_path}")
    return x.join(y, "row_id").select("row_id", "drug1", "drug2", F.col("SE").alias("se"), "label")


def read_indexed_x(spark: SparkSession, path: str) -> DataFrame:
    """Pair features with a leading index column."""
    xs = T.StructType([T.StructField("idx", T.LongType())] + list(_PAIR_X.fields))
    return _csv(spark, path, xs).select(F.col("idx").alias("row_id"), "drug1", "drug2", F.col("SE").alias("se"))


def read_indexed_y(spark: SparkSession, path: str) -> DataFrame:
    """Labels with a leading index column."""
    header = spark.read.option("header", True).csv(path).columns
    if "label" not in header:
        raise ValueError(f"{path}: no 'label' column (found {header})")
    ys = T.StructType([T.StructField("idx", T.LongType()), T.StructField("label", T.IntegerType())])
    return _csv(spark, path, ys).select(F.col("idx").alias("row_id"), "label")


def read_pairs_indexed(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """Pair features and labels with a leading index column, joined on it."""
    x, y = read_indexed_x(spark, x_path), read_indexed_y(spark, y_path)
    both = stored_once(x.join(y, "row_id").select("row_id", "drug1", "drug2", "se", "label"), "indexed")  # counted and read
    _same_length(x, y, f"{x_path} and {y_path}")
    _same_length(x, both, f"{x_path} joined with {y_path}")
    return both


def read_train_test(spark: SparkSession, train_x: str, train_y: str, test_x: str,
                    test_y: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training pairs with their mirror images, and the separate test features and test labels as they are (``row_id``
    from the files' index), which need not be labelled alike."""
    from ..operators.reshape import mirror_pairs
    return (mirror_pairs(read_pairs_indexed(spark, train_x, train_y)), read_indexed_x(spark, test_x),
            read_indexed_y(spark, test_y))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Gene list: leading index, then a column named ``0`` with the gene id."""
    schema = T.StructType([T.StructField("_idx", T.IntegerType()), T.StructField("0", T.LongType())])
    g = with_row_index(_csv(spark, path, schema), "pos")
    return g.select(F.col("pos").cast("int"), F.col("`0`").alias("gene_id"))


def read_thresholds_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide thresholds (index, ``SE``, one column per calibration sample) ->
    long ``(se, sample_no, thr)``."""
    cols = spark.read.option("header", True).csv(path).columns
    samples = [c for c in cols[2:]]
    fields = [T.StructField("_idx", T.LongType()), T.StructField("SE", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in samples]
    d = _csv(spark, path, T.StructType(fields))
    stack = ", ".join(f"{i}, `{c}`" for i, c in enumerate(samples))
    return d.selectExpr("SE as se", f"stack({len(samples)}, {stack}) as (sample_no, thr)")


def read_descriptor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor table, every column a double (split with ``reshape.split_*``)."""
    cols = spark.read.option("header", True).csv(path).columns
    return _csv(spark, path, T.StructType([T.StructField(c, T.DoubleType()) for c in cols]))


def read_occurrence_csv(spark: SparkSession, path: str) -> DataFrame:
    """Occurrence counts, one row per side effect; the key is the row number."""
    d = with_row_index(_csv(spark, path, T.StructType([T.StructField("num_occur", T.DoubleType())])), "se")
    return d.select(F.col("se").cast("int"), F.col("num_occur").cast("long"))


def requests_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A requests table ``(request_id, drug1, drug2)`` from literal rows (ids as text)."""
    schema = "request_id long, drug1 string, drug2 string"
    return spark.createDataFrame(list(rows), schema)
