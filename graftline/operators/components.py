"""Connected components by alternating large-star and small-star (Kiveris et al. 2014), which ends in O(log^2 n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.plans.storage import stored


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions, and the least of each node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return both, both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both, least = _star(edges)
    out = both.where("v > u").join(stored(least, "large-star"), "u").where("v <> m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges have u > v: each node's smaller neighbours, and itself, are tied to the least of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    own = least.select("u", F.col("m").alias("v"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id in a link; component_id is the smallest id reachable. Loops and nulls are left out.

    Sums and minima are made before the shuffle, and the joins on hub nodes have plain exchanges on both sides, which
    adaptive execution can split. Each round is stored, so that lineage stays short and a lost executor costs one round.
    """
    u, v = F.col(a), F.col(b)
    edges = stored(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = stored(_small(stored(_large(edges), "edges")), "edges")
    roots = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component_id")), F.struct(F.col("v").alias("id"), F.col("v").alias("component_id")))))
    return roots.distinct()
