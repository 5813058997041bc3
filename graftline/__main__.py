"""The stages from the command line: python -m graftline STAGE --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graftline.operators import features, slicing
from graftline.plans import stages, volumes
from graftline.sources import tables as T

ANNOTATION_SCHEMA = "root_id long, known_nt string, top_nt string, top_nt_conf double, super_class string, cell_class string, supertype string, cell_type string, hemibrain_type string, fbbt_id string, ito_lee_hemilineage string, side string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graftline", description=__doc__)
    p.add_argument("--processed", default="data/processed", help="folder of the tables")
    p.add_argument("--volume", default="fafb")
    sub = p.add_subparsers(dest="stage", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    s = add("intake", "raw releases to nodes and edges")
    for a in ("--connections", "--annotations"):
        s.add_argument(a, required=True)
    s.add_argument("--transmitters")
    s = add("splits", "blocked and random splits with their audit")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--stratify-on", default="nt_best,super_class")
    s = add("features", "feature blocks")
    s.add_argument("--kinds", default="connection,rwse,flow,local,local_tri")
    s = add("topk", "strongest partners")
    s.add_argument("-k", type=int, default=64)
    s = add("embed", "baseline, untrained, trained or outside embeddings")
    s.add_argument("--method", default="raw", choices=("raw", "degree", "composition", "propagate", "untrained", "trained", "outside"))
    s.add_argument("--source", help="volume whose statistics, and whose trained encoder, are used")
    s.add_argument("--vectors", help="a table of id and x, for the method outside")
    s = add("train", "the encoder, on the labelled train rows")
    s.add_argument("--target", default="nt_best")
    for name, value in (("k", 64), ("width", 128), ("heads", 8), ("layers", 4), ("steps", 1000), ("batch", 1024), ("seed", 0)):
        s.add_argument(f"--{name}", type=int, default=value)
    s.add_argument("--rate", type=float, default=3e-4)
    s = add("transfer", "probes fitted on one volume, applied to another")
    s.add_argument("--target", required=True)
    s.add_argument("--method", default="raw")
    s.add_argument("--targets", default=",".join(stages.PLAN))
    s.add_argument("--out")
    s = add("breakdown", "a markdown report of predictions")
    s.add_argument("--predictions", required=True)
    s.add_argument("--probe-target", default="nt_best")
    s.add_argument("--slices", default="region,status,super_class,side")
    s = add("audit", "labels against predictions")
    s.add_argument("--other")
    s = add("release", "the wide table and the splits by source id")
    s.add_argument("--predictions", required=True)
    s.add_argument("--out", required=True)
    s = add("check", "two sets of predictions against one another")
    s.add_argument("--a", required=True)
    s.add_argument("--b", required=True)
    s.add_argument("--tol", type=float, default=1e-6)
    add("dictionary", "the feature dictionary")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.stage == "dictionary":
        print("\n".join("\t".join(map(str, e.values())) for e in features.feature_dictionary(list(features.REFINED), list(features.DROPPED))))
        return 0
    spark = SparkSession.builder.appName(f"graftline {a.stage}").getOrCreate()
    at = stages.Folder(spark, a.processed, a.volume)
    if a.stage == "intake":
        read = spark.read.parquet
        if a.transmitters:
            made = volumes.second_volume(read(a.connections), read(a.annotations), read(a.transmitters), a.volume)
        else:
            made = volumes.first_volume(read(a.connections), T.annotations(spark, a.annotations, ANNOTATION_SCHEMA), a.volume)
        print(stages.intake(at, made))
    elif a.stage == "splits":
        print(stages.make_splits(at, a.seed, tuple(a.stratify_on.split(","))))
    elif a.stage == "features":
        stages.feature_blocks(at, tuple(a.kinds.split(",")))
    elif a.stage == "topk":
        print(stages.top_k(at, a.k))
    elif a.stage == "embed":
        base = stages.Folder(spark, a.processed, a.source) if a.source else None
        made = {"untrained": lambda: stages.untrained_embedding(at), "trained": lambda: stages.trained_embedding(at, base), "outside": lambda: stages.outside_embedding(at, a.vectors)}
        at.write(f"embedding_{a.method}", made.get(a.method, lambda: stages.baseline_embedding(at, a.method, base))())
    elif a.stage == "train":
        print(stages.train_encoder(at, a.target, a.k, a.width, a.heads, a.layers, a.steps, a.batch, a.rate, a.seed))
    elif a.stage == "transfer":
        to = stages.Folder(spark, a.processed, a.target)
        print(json.dumps(stages.zero_shot(at, to, at.read(f"embedding_{a.method}"), to.read(f"embedding_{a.method}"), tuple(a.targets.split(",")), a.out), default=str))
    elif a.stage == "breakdown":
        columns = a.slices.split(",")
        rows = spark.read.parquet(a.predictions).where(F.col("probe_target") == a.probe_target).join(at.nodes().select("id", "cell_type", *columns), "id", "left")
        print(stages.breakdown(rows, columns, "cell_type"))
    elif a.stage == "audit":
        print(stages.label_audit(at, stages.Folder(spark, a.processed, a.other) if a.other else None))
    elif a.stage == "release":
        print(stages.release(at, spark.read.parquet(a.predictions), a.out))
    elif a.stage == "check":
        wrong = slicing.run_diff(spark.read.parquet(a.a), spark.read.parquet(a.b), ["probe_target", "where", "id"], ["pred", "p"], a.tol)
        n = wrong.count()
        print(f"{n} rows differ")
        return int(n > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
