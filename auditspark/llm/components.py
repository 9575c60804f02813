"""Distributed connected components by randomised contraction.

In each round every node picks, among itself and its neighbours, the one whose
id hashes lowest under the round's seed; edges are rewritten to the picked nodes
and loops vanish. The expected number of nodes falls by a constant factor each
round, whatever the graph's shape. Everything stays in DataFrames; each round is
written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns, any order).

    Nodes share a root exactly when a path joins them. Loops and repeated edges
    are harmless; null ends are ignored; no edges give an empty table.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = None
    for seed in range(max_rounds):
        if e.isEmpty():
            break
        pick = e.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "v").alias("h"), "v")).alias("m"))
        own = F.struct(F.xxhash64(F.lit(seed), "u").alias("h"), F.col("u").alias("v"))
        r = cut(pick.select("u", F.least(F.col("m"), own)["v"].alias("r")), "cc-pick")
        ru, rv = r.select("u", F.col("r").alias("ru")), r.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        e = e.join(ru, "u").select("v", "ru").join(rv, "v").where("ru <> rv")
        e = cut(e.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "cc-edges")
        if labels is None:
            labels = r.select(F.col("u").alias("node"), F.col("r").alias("root"))
        else:
            step = r.select(F.col("u").alias("root"), "r")
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "cc-labels")
    else:
        raise RuntimeError("connected components did not converge")
    if labels is None:
        labels = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
