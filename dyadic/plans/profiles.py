"""Q5 -- predict expression profiles from descriptors and rate them.

wide descriptors -> fingerprint / property / target arrays (column-name
rule) -> predictor (supplied weights, or a ridge fit on Spark) -> per-row
Pearson with the targets, per-position Pearson, MSE. Predictions are kept as
a DataFrame (the reference only printed their correlation)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analysis import gene_pearson, mse, with_row_pearson
from ..operators.fit import apply_linear, ridge_fit
from ..operators.reshape import split_descriptor_both
from ..operators.scoring import FeatureModel, predict_expression


@dataclass
class ProfilePrediction:
    predictions: DataFrame   # row_id, pred, y
    row_quality: DataFrame   # row_id, pearson
    quality: DataFrame       # metric, value (mean_row_pearson, mean_gene_pearson, mse)


def profile_quality(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = with_row_pearson(pred.select("row_id", "y", "pred"), "y", "pred").select("row_id", "pearson")
    g = gene_pearson(pred, "y", "pred").agg(F.avg("r").alias("mean_gene_pearson"))
    # the mean is NULL as soon as one row is constant (a mean over a NaN)
    mean_r = F.when(F.count("pearson") == F.count(F.lit(1)), F.avg("pearson"))
    r = rows.agg(mean_r.alias("value")).select(F.lit("mean_row_pearson").alias("metric"), "value")
    g = g.select(F.lit("mean_gene_pearson").alias("metric"), F.col("mean_gene_pearson").alias("value"))
    e = mse(pred, "y", "pred").select(F.lit("mse").alias("metric"), F.col("mse").alias("value"))
    return rows, r.unionByName(g).unionByName(e)


def predict_profiles(descriptors: DataFrame, n_desc: int, model: FeatureModel | None = None,
                     l2: float = 0.01) -> ProfilePrediction:
    parts = split_descriptor_both(descriptors, n_desc, keep=("row_id",))
    if model is not None:
        pred = predict_expression(parts, model).join(parts.select("row_id", "y"), "row_id")
    else:
        xy = parts.select("row_id", F.concat("fp", "desc").alias("x"), "y")
        W = ridge_fit(xy, "x", "y", l2)
        pred = apply_linear(xy, "x", W).select("row_id", "pred", "y")
    rows, summary = profile_quality(pred)
    return ProfilePrediction(pred, rows, summary)
