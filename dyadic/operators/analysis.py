"""Signature analysis of drugs: positive pairs, side-effect lists, indicator
matrix, strongest profile positions, correlation and clusters.

The reference runs this for one drug id; here the drug id is a column, so all
drugs are analysed in one job. Per-row work (top positions of a vector) is an
array expression with no shuffle; per-pair aggregations use partial
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import centre, fill_zero, with_centre_unit
from ..session import default_slices, stored_once
from .reshape import swap_pair

#: observed (pair, side effect) rows of one slice of pairs
SLICE_ROWS = 1_000_000


def drug_positive_pairs(pairs: DataFrame, drugs: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Observed positives of every focus drug, on either side: rows with
    ``label = 1`` and ``drug1 = focus`` or ``drug2 = focus`` (column ``focus``);
    a drug paired with itself is listed on both sides.
    ``drugs`` (``drug_id``) restricts the focus drugs (semi-join)."""
    pos = pairs.where(F.col(label) == 1)
    a = pos.withColumn("focus", F.col("drug1"))
    b = pos.withColumn("focus", F.col("drug2"))
    out = a.unionByName(b)
    if drugs is not None:
        out = out.join(drugs.select(F.col("drug_id").alias("focus")), "focus", "left_semi")
    return out


def first_positive_pair(pairs: DataFrame, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """Per ``(drug1, drug2)`` the positive row that comes first (lowest row id);
    an aggregate with partial aggregation, so a frequent pair is not a hot task."""
    others = [c for c in pairs.columns if c not in ("drug1", "drug2")]
    pos = pairs.where(F.col(label) == 1)
    first = F.min_by(F.struct(*others), F.col(row_id)).alias("_f")
    return pos.groupBy("drug1", "drug2").agg(first).select("drug1", "drug2", "_f.*")


def drug_pairs_both_sides(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """First positive pair of each focus drug on either side, oriented so the
    focus drug is ``drug1`` (``UNION ALL`` of as-drug1 and swapped as-drug2)."""
    f = first_positive_pair(pairs, row_id)
    # both orientations of a row at once: the pairs are grouped one time
    ways = F.explode(F.array(F.struct("drug1", "drug2"), F.struct(F.col("drug2").alias("drug1"), F.col("drug1").alias("drug2"))))
    others = [c for c in f.columns if c not in ("drug1", "drug2")]
    return (f.select(*others, ways.alias("_w"))
            .select("_w.drug1", "_w.drug2", *others, F.col("_w.drug1").alias("focus")))


def se_lists(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """SE lists of each focus drug's first positive pairs, in the pair's
    original orientation (two rows per pair: one per focus side), listing
    every observed side effect of the pair whatever its label (sorted, with
    repeats), plus the compact ``se_counts`` (distinct se, count)."""
    # pre-aggregate to (pair, se, count): what reaches a pair's group is bounded
    # by the side-effect catalogue, however many times the pair was observed
    obs = stored_once(pairs.groupBy("drug1", "drug2", "se").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.max(F.col("label") == 1), F.lit(False)).alias("_pos")), "pair-se")
    # slices of bounded size, as lists are sorted in memory
    slices = max(default_slices(pairs.sparkSession), -(-obs.count() // SLICE_ROWS))
    listed = F.col("se").isNotNull() & F.col("drug1").isNotNull() & F.col("drug2").isNotNull()
    per_pair = (obs.repartition(slices, "drug1", "drug2").groupBy("drug1", "drug2")
                .agg(F.sort_array(F.collect_list(F.when(listed, F.struct("se", "_n")))).alias("se_counts"),
                     F.max("_pos").alias("_pos")).where("_pos"))
    expand = F.flatten(F.transform("se_counts", lambda x: F.array_repeat(x["se"], x["_n"].cast("int"))))
    lists = per_pair.select("drug1", "drug2", expand.alias("se_list"),
                            F.transform("se_counts", lambda x: F.struct(x["se"].alias("se"), x["_n"].alias("n")))
                            .alias("se_counts"))
    return lists.select("*", F.explode(F.array("drug1", "drug2")).alias("focus"))


def top_positions(df: DataFrame, vec_col: str, k: int, genes: Sequence[int] | None = None) -> DataFrame:
    """Top ``k`` positions of a vector by absolute value (ties: lower position
    first), one row per rank: adds ``rank`` (1-based), ``pos``, ``gene_id`` and
    ``abs_value``. Row-local: sort of (-|x|, position) pairs, no shuffle."""
    keyed = F.transform(F.col(vec_col), lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("pos")))
    best = F.slice(F.array_sort(keyed), 1, k)
    out = df.select(*[c for c in df.columns if c != vec_col], F.posexplode(best).alias("_r", "_t"))
    gene = F.element_at(F.array(*[F.lit(g) for g in genes]), F.col("_t.pos") + 1) if genes else F.col("_t.pos")
    return out.select(*[c for c in df.columns if c != vec_col], (F.col("_r") + 1).alias("rank"),
                      F.col("_t.pos").alias("pos"), gene.cast("bigint").alias("gene_id"),
                      (-F.col("_t.k")).alias("abs_value"))


def gene_corr_distance(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``1 - Pearson`` between vector positions over all rows (the column
    distance of the cluster map), as ``(pos_i, pos_j, distance)``.

    Every partition adds up its ``[1, x]' [1, x]`` in one Arrow pass
    (``fit.ridge_gram``), around the column means so that large offsets do not
    cancel; the sums are written once and turned into correlations on the
    executors.
    """
    from ..session import ensure_checkpoint_dir
    from .fit import column_means, ridge_gram
    v = df.where(F.col(vec_col).isNotNull()).select(fill_zero(vec_col).alias("_x"))
    g = ridge_gram(v, "_x", None, intercept=True, shift=column_means(v, "_x")).where(F.col("block") == "xx").drop("block")
    ensure_checkpoint_dir(df.sparkSession)
    g = g.checkpoint(eager=True)  # width^2 rows, read three times below
    s1 = g.where((F.col("i") == 0) & (F.col("j") > 0)).select(F.col("j").alias("_k"), F.col("value").alias("_s"),
                                                             F.col("rows").alias("_n"))
    sq = g.where((F.col("i") == F.col("j")) & (F.col("i") > 0)).select(F.col("i").alias("_k"), F.col("value").alias("_q"))
    stats = s1.join(sq, "_k")  # one row per position; small enough tables are broadcast at run time
    a = stats.select(F.col("_k").alias("i"), F.col("_s").alias("si"), F.col("_q").alias("qi"), F.col("_n").alias("n"))
    b = stats.select(F.col("_k").alias("j"), F.col("_s").alias("sj"), F.col("_q").alias("qj"))
    cross = g.where((F.col("i") > 0) & (F.col("j") > 0)).join(a, "i").join(b, "j")
    nn = F.col("n")
    num = nn * F.col("value") - F.col("si") * F.col("sj")
    den = F.sqrt((nn * F.col("qi") - F.col("si") * F.col("si")) * (nn * F.col("qj") - F.col("sj") * F.col("sj")))
    r = F.when(den > 0, num / den)
    return cross.select((F.col("i") - 1).cast("int").alias("pos_i"), (F.col("j") - 1).cast("int").alias("pos_j"),
                        (1 - r).alias("distance"))


def profile_clusters(df: DataFrame, vec_col: str = "vec", k: int = 5, seed: int = 7,
                     id_cols: Sequence[str] = ("drug_id",), weight_col: str | None = None) -> DataFrame:
    """Cluster rows by correlation: rows are centred and scaled to unit length
    (cosine of such rows = Pearson), missing values become 0, then k-means
    with cosine distance (k-means|| start). Replaces average-linkage
    clustering, which has no distributed form; the labels are not the same.

    A row without a direction (constant or missing values only) has no
    correlation with any other; such rows form one cluster of their own,
    number ``k``. ``weight_col``: how many rows of this vector a row stands for
    (greater than 0). The features are persisted for the iterations of the fit
    (recomputed from lineage if lost) and released after it."""
    from pyspark import StorageLevel
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    weight = [weight_col] if weight_col else []
    cu = with_centre_unit(df.select(*id_cols, *weight, fill_zero(vec_col).alias("_z")), "_z", "_u")
    feats = cu.where(F.col("_u").isNotNull()).select(*id_cols, *weight, array_to_vector("_u").alias("features"))
    flat = cu.where(F.col("_u").isNull()).select(*id_cols, F.lit(k).alias("cluster"))
    kept = feats.persist(StorageLevel.MEMORY_AND_DISK)
    means = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20)
    model = (means.setWeightCol(weight_col) if weight_col else means).fit(kept)
    kept.unpersist()
    return model.transform(feats).select(*id_cols, F.col("prediction").alias("cluster")).unionByName(flat)


def with_row_pearson(df: DataFrame, a: str, b: str, out: str = "pearson") -> DataFrame:
    """Add ``out``: Pearson correlation of two equal-length array columns per
    row (NULL if either is constant); O(width) per row."""
    t = df.withColumn("_rp_a", centre(a)).withColumn("_rp_b", centre(b))
    ssum = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, z: s + z)
    cov = ssum(F.zip_with("_rp_a", "_rp_b", lambda x, y: x * y))
    va = ssum(F.transform("_rp_a", lambda x: x * x))
    vb = ssum(F.transform("_rp_b", lambda x: x * x))
    den = F.sqrt(va * vb)
    return t.withColumn(out, F.when(den > 0, cov / den)).drop("_rp_a", "_rp_b")


def gene_pearson(df: DataFrame, truth: str, pred: str, eps: float = 1e-7) -> DataFrame:
    """Per position, Pearson of truth vs prediction over all rows with
    ``denominator + eps``, clipped to [-1, 1] (average them for the single
    number). Each partition sums its rows as vectors in one Arrow pass and
    emits ``width`` rows; a keyed sum combines the partitions -- rows are never
    exploded into one row per position. Sums are taken around the column means,
    so large offsets do not cancel."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    from .fit import column_means
    mean_t, mean_p = column_means(df, truth), column_means(df, pred)
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("n", T.LongType())] +
                          [T.StructField(c, T.DoubleType()) for c in ("st", "sp", "stp", "stt", "spp")])

    def part(batches):
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            t = np.stack(pdf[truth].to_numpy()).astype(float) - mean_t
            p = np.stack(pdf[pred].to_numpy()).astype(float) - mean_p
            cur = [np.full(t.shape[1], t.shape[0], dtype=np.int64), t.sum(0), p.sum(0), (t * p).sum(0),
                   (t * t).sum(0), (p * p).sum(0)]
            acc = cur if acc is None else [a + c for a, c in zip(acc, cur)]
        if acc is not None:
            yield pd.DataFrame({"pos": np.arange(len(acc[0]), dtype=np.int32), "n": acc[0], "st": acc[1],
                                "sp": acc[2], "stp": acc[3], "stt": acc[4], "spp": acc[5]})

    parts = df.select(truth, pred).mapInPandas(part, schema)
    s = parts.groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("n", "st", "sp", "stp", "stt", "spp")])
    n = F.col("n")
    num = F.col("stp") - F.col("st") * F.col("sp") / n
    den = F.sqrt(F.greatest(F.col("stt") - F.col("st") * F.col("st") / n, F.lit(0.0)) *
                 F.greatest(F.col("spp") - F.col("sp") * F.col("sp") / n, F.lit(0.0)))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), num / (den + eps)))
    return s.select("pos", r.alias("r"))


def mse(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean squared error over all elements of all rows."""
    sq = F.aggregate(F.zip_with(truth, pred, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.agg((F.sum(sq) / F.sum(F.size(truth))).alias("mse"))
