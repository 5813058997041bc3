"""Edges and nodes: pair aggregation, node index, degree table, checks (AGG1-6, AGG20, JOI2, JOI11, JOI12, SET3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.plans.ordered import percentiles, running_sums
from graftline.plans.storage import stored


def aggregate_edges(raw: DataFrame, already_unique: bool = False) -> DataFrame:
    """AGG1: w summed by (pre, post). A table said to be unique is not summed, but is checked."""
    if not already_unique:
        return raw.groupBy("pre", "post").agg(F.sum("w").alias("w"))
    raw = stored(raw.select("pre", "post", "w"), "unique-edges")  # made once; the check's sums are not in the tasks that make it
    if not raw.groupBy("pre", "post").count().where("count > 1").isEmpty():
        raise ValueError("edges repeat a pair")
    return raw


def aggregate_both_ways(raw: DataFrame) -> DataFrame:
    """AGG1 with JOI12: w summed by (pre, post), and w_back, the sum the other way or null; self-loops are their own.

    Both directions of a pair meet in one aggregate, so that the summed edges need not be joined with themselves. A null end is kept.
    """
    up, pre, post = F.col("pre") <= F.col("post"), F.col("pre"), F.col("post")
    a, b = F.when(up, pre).otherwise(post), F.when(up, post).otherwise(pre)  # a null end makes b -> a
    way = F.when(up, 1).otherwise(2)
    pairs = raw.groupBy(a.alias("a"), b.alias("b")).agg(F.sum(F.when(way == 1, F.col("w"))).alias("ab"), F.sum(F.when(way == 2, F.col("w"))).alias("ba"), F.bit_or(way).alias("ways"))
    edge = lambda way, pre, post, w, back: F.struct(F.lit(way).alias("way"), F.col(pre).alias("pre"), F.col(post).alias("post"), F.col(w).alias("w"), back.alias("w_back"))
    loop = F.when(F.col("a") == F.col("b"), F.col("ab")).otherwise(F.col("ba"))
    ways = F.array(edge(1, "a", "b", "ab", loop), edge(2, "b", "a", "ba", F.col("ab")))
    return pairs.select("ways", F.inline(ways)).where(F.col("way").bitwiseAND(F.col("ways")) > 0).select("pre", "post", "w", "w_back")


def symmetrised(edges: DataFrame) -> DataFrame:
    """SET3: (i, j, w, sign) both ways from one scan; sign 1 is out of i, -1 into it."""
    out = F.struct(F.col("pre").alias("i"), F.col("post").alias("j"), F.col("w"), F.lit(1).alias("sign"))
    into = F.struct(F.col("post").alias("i"), F.col("pre").alias("j"), F.col("w"), F.lit(-1).alias("sign"))
    return edges.select(F.inline(F.array(out, into)))


def node_ids(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """SET2: (source_id) of all edge ends and of one-column frames."""
    ids = edges.select(F.explode(F.array("pre", "post")).alias("source_id"))
    for df in more:
        ids = ids.unionByName(df.toDF("source_id"))
    return ids.distinct()


def node_index(ids: DataFrame) -> DataFrame:
    """AGG2: (source_id, node_id), contiguous from 0 in order of source_id; no task orders all ids."""
    counted = running_sums(ids.select("source_id").withColumn("one", F.lit(1).cast("long")), "source_id", {"upto": "one"})
    return counted.select("source_id", (F.col("upto") - 1).alias("node_id"))


def renumbered(edges: DataFrame, index: DataFrame) -> DataFrame:
    """JOI2: both ends by the index."""
    side = lambda c: index.select(F.col("source_id").alias(c), F.col("node_id").alias(f"n_{c}"))
    return edges.join(side("pre"), "pre").join(side("post"), "post").select(F.col("n_pre").alias("pre"), F.col("n_post").alias("post"), "w")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """JOI11: the edges with both ends kept (source_id), renumbered in order of their ids."""
    return renumbered(edges, node_index(kept.select("source_id").distinct()))


def degree_table(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """AGG3: (id, n_in, n_out, syn_in, syn_out); of nodes (source_id) without an edge, zeros."""
    ends = symmetrised(edges).groupBy(F.col("i").alias("id")).agg(
        F.count_if(F.col("sign") < 0).alias("n_in"),
        F.count_if(F.col("sign") > 0).alias("n_out"),
        F.sum(F.when(F.col("sign") < 0, F.col("w")).otherwise(0)).alias("syn_in"),
        F.sum(F.when(F.col("sign") > 0, F.col("w")).otherwise(0)).alias("syn_out"),
    )
    if nodes is None:
        return ends
    return nodes.select(F.col("source_id").alias("id")).join(ends, "id", "left").na.fill(0, ["n_in", "n_out", "syn_in", "syn_out"])


def weight_percentiles(edges: DataFrame, shares=(0.75, 0.9)) -> DataFrame:
    """AGG6: one row of exact, interpolated percentiles over edges."""
    return percentiles(edges, "w", {f"p{round(100 * p)}": p for p in shares})


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG20/JOI10/SET6: one row of counts that a sound graph has at zero; nodes have node_id."""
    ids = nodes.agg((F.count(F.lit(1)) - F.count("node_id")).alias("null_ids"), (F.count("node_id") - F.count_distinct("node_id")).alias("repeated_ids"))
    weights = edges.agg(F.count_if(F.col("pre").isNull() | F.col("post").isNull() | F.col("w").isNull()).alias("null_ends"), F.count_if(F.col("w") <= 0).alias("bad_weights"))
    pairs = edges.groupBy("pre", "post").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated_pairs"))
    ends = edges.select(F.explode(F.array("pre", "post")).alias("node_id")).distinct()
    loose = ends.join(nodes.select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("ends_without_node"))
    return ids.crossJoin(weights).crossJoin(pairs).crossJoin(loose)  # one row each


def require_sound(nodes: DataFrame, edges: DataFrame) -> None:
    bad = {k: v for k, v in check_graph(nodes, edges).first().asDict().items() if v}
    if bad:
        raise ValueError(f"graph is not sound: {bad}")


def reciprocal(edges: DataFrame) -> DataFrame:
    """JOI12: edges with the weight of the edge the other way, or null; self-loops are their own."""
    back = edges.select(F.col("post").alias("pre"), F.col("pre").alias("post"), F.col("w").alias("w_back"))
    return edges.join(back, ["pre", "post"], "left")
