"""Writers for results. Long forms are the storage format; wide exports are
derived with a pivot only at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_text


def write_predictions(merged: DataFrame, path: str, fmt: str = "parquet", partition_by_se: bool = False) -> None:
    """Merged predictions (drug1, drug2, se, label, ... , gap)."""
    w = merged.write.mode("overwrite")
    if partition_by_se:
        w = w.partitionBy("se")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.option("compression", "zstd").parquet(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """Long thresholds ``(se, sample_no, thr)``; one path, read back by
    ``spark.read.parquet`` (no separate names for writing and loading)."""
    thresholds.select("se", "sample_no", "thr").write.mode("overwrite").parquet(path)


def top_genes_wide(top: DataFrame, key=("focus", "drug1", "drug2"), k: int = 100) -> DataFrame:
    """Rank as columns ``0 .. k-1`` holding the gene id (the export layout)."""
    return (top.groupBy(*key).pivot("rank", list(range(1, k + 1))).agg(F.first("gene_id"))
            .select(*key, *[F.col(str(r)).alias(str(r - 1)) for r in range(1, k + 1)]))


def write_top_genes(top: DataFrame, path: str, wide: bool = False, k: int = 100) -> None:
    out = top_genes_wide(top, k=k) if wide else top
    out.write.mode("overwrite").option("header", True).csv(path)


def drug_record(drug_id: str = "drug_id", name: str = "name"):
    """JSON record of one drug for the drug list."""
    return F.concat(F.lit('{"pubchemID": '), F.col(drug_id).cast("string"), F.lit(', "name": '), json_text(name), F.lit("}"))


def write_responses(responses: DataFrame, path: str) -> None:
    responses.write.mode("overwrite").json(path)
