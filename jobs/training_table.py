"""training table: from raw connection rows to the scaled, split table of node features that a model is fitted on.

The source graph's statistics are written beside its table; the table of another graph, to which a fitted model is applied
unchanged, is scaled by them instead of its own (source_scale):

    edges/part=K          pre, post, w, added up and checked, in parts by pre; w_back, the weight of the edge the other way, or null
    scale                 one row: mean_<c> and sd_<c> of every column over the train rows
    table/split=S         id, the columns, scaled, of train, val or test

Every output is replaced as a whole, splits and parts depend on ids alone, and sums are exact or rounded no further than
double precision, so a rerun gives the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import features, scaling, splits
from graftline.operators.edges import aggregate_both_ways
from jobs.common import main, present

LOG = logging.getLogger("jobs.training_table")
#: pre and post are columns of the rows; a prefix tells two kinds of ids apart; weight is a column or nothing (each row counts 1).
DEFAULTS = {"pre": "l_suppkey", "post": "l_partkey", "pre_prefix": "s", "post_prefix": "p", "weight": None, "seed": 0, "parts": 16, "source_scale": None}
EDGES = "pre string, post string, w double, w_back double, part int"


def edges_of(rows: DataFrame, config: dict) -> DataFrame:
    """(pre, post, w, w_back): rows with both ends, added up by pair, both ways at once; a null weight counts 0 and pairs of no weight go."""
    end = lambda side: F.concat(F.lit(config[f"{side}_prefix"]), F.col(f"`{config[side]}`").cast("string")).alias(side)
    w = F.coalesce(F.col(f"`{config['weight']}`").cast("double"), F.lit(0.0)) if config["weight"] else F.lit(1.0)
    raw = rows.select(end("pre"), end("post"), w.alias("w")).where("pre IS NOT NULL AND post IS NOT NULL")
    return aggregate_both_ways(raw).where("w > 0").withColumn("w_back", F.when(F.col("w_back") > 0, F.col("w_back")))


def run(spark: SparkSession, rows: str, out: str, config: dict | None = None) -> dict:
    """One run over all rows; returns how many edges and nodes were written."""
    config, out = DEFAULTS | (config or {}), out.rstrip("/")
    read = spark.read.parquet(rows)
    part = F.pmod(F.xxhash64("pre"), F.lit(config["parts"])).cast("int")
    edges_of(read, config).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{out}/edges")
    edges = present(spark, f"{out}/edges", EDGES).drop("part")
    n_edges = edges.count()
    LOG.info("read %s, wrote %d edges to %s/edges", rows, n_edges, out)
    nodes = splits.random_split(features.edge_features(edges), config["seed"]).withColumnRenamed("split_random", "split")
    columns = [c for c in nodes.columns if c not in ("id", "split")]
    nodes.write.mode("overwrite").parquet(f"{out}/unscaled")
    nodes = spark.read.schema(nodes.schema).parquet(f"{out}/unscaled")
    if config["source_scale"]:
        scale = spark.read.parquet(config["source_scale"])
        LOG.info("scaled by %s", config["source_scale"])
    else:
        scale = scaling.fit_scale(nodes, columns, F.col("split") == "train")
    scale.coalesce(1).write.mode("overwrite").parquet(f"{out}/scale")
    scale = spark.read.parquet(f"{out}/scale")
    lacking = sorted(c for c in columns if f"mean_{c}" not in scale.columns)
    if lacking:
        raise ValueError(f"the scale lacks {', '.join(lacking)}")
    scaling.apply_scale(nodes, scale, columns).write.mode("overwrite").partitionBy("split").parquet(f"{out}/table")
    counts = {r.split: r["count"] for r in output(spark, out).groupBy("split").count().collect()}
    LOG.info("wrote %s/table: %s", out, counts)
    return {"edges": n_edges, "nodes": sum(counts.values())}


def output(spark: SparkSession, out: str) -> DataFrame:
    """The table as it stands."""
    return spark.read.parquet(f"{out}/table")


if __name__ == "__main__":
    main(run, "training table: scaled and split node features from raw connection rows", DEFAULTS, {"rows": "Parquet table of connection rows", "out": "folder of the job's tables"})
