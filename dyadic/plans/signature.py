"""Q4 -- signature of every drug: its first positive pairs on either side,
the side-effect lists and indicator vectors of those pairs, the strongest
profile positions, the column correlation distance and profile clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analysis import (drug_pairs_both_sides, gene_corr_distance, profile_clusters, se_lists,
                                  top_positions)
from ..operators.hierarchy import Tree, divisive_tree
from ..operators.joins import bounded_broadcast
from ..operators.reshape import pair_se_binary
from ..session import stored_once


@dataclass
class Signature:
    pairs: DataFrame         # focus, drug1, drug2, se, label, row_id, vec1
    se_lists: DataFrame      # focus, drug1, drug2, se_list, se_binary
    top_genes: DataFrame     # focus, drug1, drug2, rank, pos, gene_id, abs_value
    vectors: DataFrame       # focus, drug1, drug2, vec1 (NULL without a profile)
    n_clusters: int = 5
    keys: DataFrame | None = None        # focus, drug1, drug2
    per_drug: DataFrame | None = None    # drug1, vec1: the vectors, where they depend on drug1 alone

    def corr_distance(self) -> DataFrame:
        """Column (position) correlation distance; runs a job when called."""
        return gene_corr_distance(self.vectors, "vec1")

    def clusters(self) -> DataFrame:
        """Cluster labels of the vectors; fits a model when called. Where a vector depends on the drug alone, the fit
        holds it once, weighted by the number of its pairs, and only its label meets them."""
        if self.per_drug is not None:
            keys = stored_once(self.keys, "focus-pairs")
            uses = keys.groupBy("drug1").agg(F.count(F.lit(1)).cast("double").alias("weight"))
            used = stored_once(self.per_drug.join(uses, "drug1"), "used-profiles")
            labels = profile_clusters(used, "vec1", self.n_clusters, id_cols=("drug1",), weight_col="weight")
            labels = stored_once(labels, "drug-clusters")
            return (keys.join(bounded_broadcast(labels), "drug1", "left")
                    .select("focus", "drug1", "drug2", F.coalesce("cluster", F.lit(self.n_clusters)).alias("cluster")))
        return profile_clusters(self.vectors, "vec1", self.n_clusters, id_cols=("focus", "drug1", "drug2"))

    def tree(self, leaves: int | None = None) -> Tree:
        """Divisive tree of the vectors; grown when called."""
        return divisive_tree(self.vectors, leaves or self.n_clusters, "vec1", ("focus", "drug1", "drug2"))


def drug_signature(pairs: DataFrame, profile: DataFrame, n_se: int, k: int = 100, genes=None,
                   gated: DataFrame | None = None, n_clusters: int = 5) -> Signature:
    """``gated``: optional per-pair vectors (``drug1, drug2, s1``) from the full
    model; without it the drug's profile is used (identity model)."""
    pairs = stored_once(pairs, "pairs")  # read for the first pairs and for the lists
    both = drug_pairs_both_sides(pairs)
    keys = both.select("focus", "drug1", "drug2")
    one_side = None
    if gated is not None:
        pv = both.join(gated.select("drug1", "drug2", F.col("s1").alias("vec1")), ["drug1", "drug2"], "left")
        tops = top_positions(pv.select("focus", "drug1", "drug2", "vec1").where(F.col("vec1").isNotNull()),
                             "vec1", k, genes)
    else:
        one_side = profile.select(F.col("drug_id").alias("drug1"), F.col("vec").alias("vec1"))
        pv = both.join(one_side, "drug1", "left").select(*both.columns, "vec1")
        # the vector depends on the drug alone: sort it once per drug, then join the short list
        per_drug = top_positions(one_side.where(F.col("vec1").isNotNull()), "vec1", k, genes)
        tops = keys.join(per_drug, "drug1").select("focus", "drug1", "drug2", "rank", "pos", "gene_id", "abs_value")
    lists = pair_se_binary(se_lists(pairs), n_se)
    vecs = pv.select("focus", "drug1", "drug2", "vec1")
    return Signature(pv, lists, tops, vecs, n_clusters, keys, one_side)
