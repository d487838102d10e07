"""Connected components of an edge table by repeated contraction.

A round lets every node point at its smallest neighbour, follows pointers a few
steps, and replaces the edges by edges between the nodes pointed at; edges inside
a component vanish, so the table shrinks by a constant factor a round at least.
Only edge counts reach the driver. All joins read stored tables, so adaptive
execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

JUMPS = 2


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers after one step further: node -> p(p(node))."""
    onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return stored(pointers.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
                  "pointers")


def connected_components(edges: DataFrame) -> DataFrame:
    """Table of node and root (a node of its component) for every node that ``edges`` (u, v: long) names."""
    edges = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                   .distinct(), "edges")
    levels: list[DataFrame] = []
    while edges.count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = stored(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")),
                          "pointers")
        for _ in range(JUMPS):
            pointers = _jumped(pointers)
        levels.append(pointers)
        at = lambda end: pointers.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        edges = stored(edges.join(at("u"), "u").join(at("v"), "v").where("root_u <> root_v")
                       .select(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v"))
                       .distinct(), "edges")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[0]
    for deeper in levels[1:]:
        onward = deeper.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = stored(found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
                       "components")
    return found
