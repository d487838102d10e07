"""Stand-in inputs built from the shared test tables.

The reference ships neither its pair observations, expression profiles,
side-effect names nor thresholds, so the test and bench jobs derive
stand-ins from the TPC-H-like tables in ``/root/testdata/sf*``. Every
definition here has a twin SQL text in ``dyadic.oracle.FIXTURE_CTES`` that
DuckDB runs on the same parquet files; the two must stay in step.

All stand-ins are linear in their inputs (no all-pairs expansion):

* ``pairs_raw``  -- any two lines of one order form an observation "drug1 taken
  with drug2" (drugs are suppliers; the earlier line is drug1), ``se`` is the
  earlier line's quantity bucket, ``label`` is "line was returned". Equi-join on
  the order, which holds a handful of lines, after collapsing identical lines
  (copy count ``n``).
* ``scored``     -- one row per ``(drug1, drug2, se)`` with a score for each
  orientation (ratio of integer sums: bit-equal in Spark and DuckDB).
* ``profile``    -- 64-float vectors from ``embeddings``, all of them; request
  ids beyond the table have no profile (the NULL path).
* ``side_effect`` -- names from ``nation``; se ids 25..29 have none.
* ``threshold``  -- 8 calibration samples for every se of the catalogue.
* ``requests``   -- screening requests from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_THRESHOLD_SAMPLES = 8
N_DESC = 24     # property columns, and target columns, of the stand-in descriptor table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a copy count ``n``: identical lines are collapsed
    before they are paired and their counts multiplied, so a line copied k times
    yields one row with ``n = k * k'`` instead of k x k' rows. The lines are dealt
    by order once, with line, side effect and label in one number; an order's
    lines meet as one list, not by a join of the table with itself."""
    line, drug, order_key = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey")
    se = F.col("l_quantity").cast("int") % 30
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    packed, se_of = (line.cast("bigint") * 128 + F.coalesce(se + 30, F.lit(127))) * 2 + label, F.shiftright("packed", 1).bitwiseAND(127)
    lines = (table(spark, sf_dir, "lineitem")
             .where(order_key.isNotNull() & line.isNotNull() & drug.isNotNull())
             .select(order_key.alias("order_key"), drug.alias("drug"), packed.alias("packed"),
                     F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
             .repartition("order_key").groupBy("order_key", "drug", "packed", "c").agg(F.count(F.lit(1)).alias("n"))
             .select("order_key", F.shiftright("packed", 8).alias("line"), "drug",
                     F.when(se_of != 127, se_of - 30).cast("int").alias("se"),
                     F.col("packed").bitwiseAND(1).cast("int").alias("label"), "c", "n"))
    orders = lines.groupBy("order_key").agg(F.collect_list(F.struct("line", "drug", "se", "label", "c", "n")).alias("lines"))
    return (orders.select("lines", F.explode("lines").alias("a")).select("a", F.explode("lines").alias("b"))
            .where((F.col("a.line") < F.col("b.line")) & (F.col("a.drug") != F.col("b.drug")))
            .select(F.col("a.drug").alias("drug1"), F.col("b.drug").alias("drug2"), "a.se", "a.label",
                    F.col("a.c").alias("c1"), F.col("b.c").alias("c2"), (F.col("a.n") * F.col("b.n")).alias("n")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (drug1, drug2, se): majority-ish label and both orientations' scores."""
    raw = pairs_raw(spark, sf_dir)
    n = F.sum("n")
    return (raw.groupBy("drug1", "drug2", "se")
            .agg(F.when(3 * F.sum(F.col("label") * F.col("n")) > n, 1).otherwise(0).alias("label"),
                 (F.sum(F.col("c1") * F.col("n")).cast("double") / n / 1e7).alias("score_fwd"),
                 (F.sum(F.col("c2") * F.col("n")).cast("double") / n / 1e7).alias("score_rev"))
            .select(((F.col("drug1") * 1000000000 + F.col("drug2")) * 100 + F.col("se")).alias("row_id"),
                    "drug1", "drug2", "se", "label", "score_fwd", "score_rev"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_id", "drug1", "drug2", "se", "label")


def drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("drug_id"),
                    F.concat(F.lit("CID"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("stitch_id"),
                    F.col("s_name").alias("name"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("drug_id"), F.col("embedding").cast("array<double>").alias("vec"))


def side_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("se"), F.col("n_name").alias("name"))


def se_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every side-effect id (quantity bucket) that occurs."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") % 30).alias("se")).distinct()


def threshold(spark: SparkSession, sf_dir: str, base: int = 350, per_sample: int = 5,
              per_se: int = 3) -> DataFrame:
    """Long thresholds ``(se, sample_no, thr)`` for the se catalogue:
    ``thr = (base + per_sample * sample_no + per_se * se) / 1000``."""
    samples = F.explode(F.sequence(F.lit(0), F.lit(N_THRESHOLD_SAMPLES - 1))).alias("sample_no")
    return (se_catalogue(spark, sf_dir).select("se", samples)
            .select("se", "sample_no",
                    ((F.lit(base) + per_sample * F.col("sample_no") + per_se * F.col("se")).cast("double") / 1000.0)
                    .alias("thr")))


def screen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on the scale of the identity-head scores (unit vectors:
    distances near 1.4, scores near 2.8)."""
    return threshold(spark, sf_dir, base=2600, per_sample=5, per_se=5)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("request_id"), "ts",
                     F.col("user_id").alias("drug1"),
                     (F.col("event_id") % 1000).alias("drug2"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide descriptor table in file order: fp0..fp15, pubfp_x, d0..d23, y0..y23
    (all 64 slots of a vector).

    ``pubfp_x`` contains "fp" and therefore lands among the fingerprints,
    as the unanchored column match of the reference does.
    """
    e = table(spark, sf_dir, "embeddings")
    el = lambda i: F.element_at(F.col("embedding"), i).cast("double")  # noqa: E731  (1-based)
    cols = [F.col("vec_id").alias("row_id")]
    cols += [F.when(el(i + 1) > 0, 1.0).otherwise(0.0).alias(f"fp{i}") for i in range(16)]
    cols += [F.when(el(17) > el(18), 1.0).otherwise(0.0).alias("pubfp_x")]
    cols += [el(17 + i).alias(f"d{i}") for i in range(N_DESC)]
    cols += [el(17 + N_DESC + i).alias(f"y{i}") for i in range(N_DESC)]
    return e.select(*cols)


def gene_header(width: int) -> list[int]:
    """Gene ids for vector positions 0..width-1 when no gene list is supplied.

    The reference's header holds 978 Entrez ids; the stand-in vectors have 64
    slots, so the header is a rule on the position (1000 + position).
    """
    return [1000 + i for i in range(width)]
