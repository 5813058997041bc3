"""Raw releases to one canonical node and edge table (SRC1-5, JOI1-3, PRJ1-8, AGG20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions import labels as L
from graftline.functions import vocabulary as V
from graftline.operators import edges as E
from graftline.plans.storage import stored

NODE_COLUMNS = {
    "node_id": "int", "source_id": "bigint", "volume": "string", "region": "string", "nt_train": "string", "nt_train_source": "string", "nt_conf": "float", "nt_known": "string",
    "nt_known_clean": "boolean", "super_class": "string", "super_class_raw": "string", "cell_class": "string", "supertype": "string", "cell_type": "string", "hemibrain_type": "string",
    "fbbt_id": "string", "hemilineage": "string", "side": "string", "status": "string", "n_in": "int", "n_out": "int", "syn_in": "bigint", "syn_out": "bigint", "is_seed": "boolean",
}


def _canonical(raw_edges: DataFrame, annotations: DataFrame, key: str, unique: bool, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Nodes (edge ends and annotated ids, numbered in order of their id) and renumbered edges. Annotated ids are unique."""
    edges = stored(E.aggregate_edges(raw_edges, unique), "edges")
    index = stored(E.node_index(E.node_ids(edges, annotations.select(key))), "index")
    numbered = stored(E.renumbered(edges, index).select(*(F.col(c).cast("int").alias(c) for c in ("pre", "post", "w"))), "edges")
    degrees = E.degree_table(numbered, index.select(F.col("node_id").alias("source_id"))).withColumnRenamed("id", "node_id")
    told = annotations.select(F.col(key).alias("source_id"), *(c.alias(n) for n, c in values.items()))
    nodes = index.join(degrees, "node_id").join(told, "source_id", "left").withColumn("is_seed", F.col("n_in") + F.col("n_out") > 0)
    fixed = {"region": F.coalesce("region", F.lit("brain")), "nt_known_clean": F.coalesce("nt_known_clean", F.lit(False)), "volume": F.lit(None).cast("string")}
    nodes = nodes.withColumns({c: v for c, v in fixed.items()})
    return nodes.select(*(F.col(c).cast(t).alias(c) for c, t in NODE_COLUMNS.items())), numbered


def first_volume(connections: DataFrame, annotations: DataFrame, name: str = "fafb") -> tuple[DataFrame, DataFrame]:
    """Edges arrive by region and are summed; labels come from free text and a predictor."""
    ann = L.derive_label(annotations, "known_nt", "top_nt", "top_nt_conf")
    c = lambda n: L.column_or_null(ann, n)
    values = {n: F.col(n) for n in ("nt_train", "nt_train_source", "nt_conf", "nt_known", "nt_known_clean")} | {n: c(n) for n in ("super_class", "cell_class", "supertype", "cell_type", "hemibrain_type", "fbbt_id", "side")}
    values |= {"region": F.lit("brain"), "super_class_raw": c("super_class"), "hemilineage": L.clean_lineage(c("ito_lee_hemilineage")), "status": F.lit(None).cast("string")}
    raw = connections.select(F.col("pre_pt_root_id").alias("pre"), F.col("post_pt_root_id").alias("post"), F.col("syn_count").alias("w"))
    nodes, edges = _canonical(raw, ann, "root_id", False, values)
    return nodes.withColumn("volume", F.lit(name)), edges


def second_volume(connections: DataFrame, annotations: DataFrame, transmitters: DataFrame, name: str = "mcns") -> tuple[DataFrame, DataFrame]:
    """Edges are unique, which is checked; super-classes are mapped, one that the map lacks being an error; unclear labels are null."""
    key = "bodyId" if "bodyId" in annotations.columns else annotations.columns[0]
    joined = annotations.join(transmitters.select(F.col("body").alias(key), "consensus_nt", "ground_truth"), key, "left")
    ann = L.mapped(joined, "superclass", V.SUPER_CLASS_OF, "super_class")
    c = lambda n: L.column_or_null(ann, n)
    none = F.lit(None).cast("string")
    clear = lambda n: F.nullif(F.col(n), F.lit("unclear"))
    values = {
        "nt_train": clear("consensus_nt"), "nt_train_source": F.when(clear("consensus_nt").isNotNull(), "predicted"), "nt_conf": F.lit(None).cast("float"), "nt_known": clear("ground_truth"),
        "nt_known_clean": clear("ground_truth").isNotNull(), "region": F.when(F.coalesce(F.col("superclass"), F.lit("")).startswith("vnc"), "vnc").otherwise("brain"), "super_class": F.col("super_class"),
        "super_class_raw": F.col("superclass"), "cell_class": none, "supertype": none, "cell_type": c("flywireType"), "hemibrain_type": c("type"), "fbbt_id": none,
        "hemilineage": L.clean_lineage(c("itoleeHl")), "side": c("somaSide"), "status": c("statusLabel"),
    }
    raw = connections.select(F.col("body_pre").alias("pre"), F.col("body_post").alias("post"), F.col("weight").alias("w"))
    nodes, edges = _canonical(raw, ann, key, True, values)
    return nodes.withColumn("volume", F.lit(name)), edges


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("n_synapses"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_seed").alias("n_seeds"), F.count_if(~F.col("is_seed")).alias("n_edgeless"), F.count_if(F.col("region") == "vnc").alias("n_vnc"), F.count_if(F.col("super_class_raw").isNotNull() & F.col("super_class").isNull()).alias("n_superclass_unmapped"))
    return n.crossJoin(e)  # one row each


def check_schema(nodes: DataFrame, edges: DataFrame) -> None:
    """AGG20: raises unless the tables have the canonical columns, unique ids, ends among the nodes and positive weights."""
    missing = set(NODE_COLUMNS) - set(nodes.columns)
    if missing or edges.columns != ["pre", "post", "w"]:
        raise ValueError(f"columns missing {sorted(missing)}, edge columns {edges.columns}")
    E.require_sound(nodes, edges)
