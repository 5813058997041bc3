"""Reports on why a transferred read-out succeeds or fails (QRY17, QRY18), composed of probes, slices, correlations and projections.

Both take a source and a target of rows (id, x, label, cell_type, syn_out, n_out, syn_in, n_in) of connected nodes; the source has split too. Every part is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.labels import log2_ratio
from graftline.operators import probes
from graftline.operators.features import correlations
from graftline.operators.scaling import null_projection
from graftline.operators.scoring import class_scores, confusion, mann_whitney, score
from graftline.operators.slicing import quantile_bin
from graftline.plans.ordered import percentiles
from graftline.plans.storage import stored

COUNTS = ("syn_out", "n_out", "syn_in", "n_in")


def read_out(train: DataFrame, target: DataFrame, c: float, scaler_rows: DataFrame | None = None) -> DataFrame:
    """The target's labelled rows with true, pred and ok of a linear probe fitted on train; scaler_rows: whose statistics scale the target, else train's."""
    train = train.where("label IS NOT NULL")
    classes, own = probes.class_list(train), probes.fit_scaler(train)
    theirs = own if scaler_rows is None else probes.fit_scaler(scaler_rows)
    probe = probes.fit_logistic(stored(probes.scaled(train, own), "report-train"), classes, c)
    rows = probes.probabilities(probes.scaled(target.where("label IS NOT NULL"), theirs), probe)
    called = probes.prediction_rows(rows, classes).withColumn("true", F.col("label").cast("string"))
    return stored(called.withColumn("ok", (F.col("true") == F.col("pred")).cast("double")).drop("x", "proba"), "report-calls")


def _f1(called: DataFrame, name: str) -> DataFrame:
    return score(called).select(F.lit(name).alias("what"), "n", "macro_f1", "accuracy")


def without_counts(rows: DataFrame, source: DataFrame, rounds: int) -> DataFrame:
    """rows with the directions taken out of x from which the source's log counts can be read."""
    width = len(source.first()["x"])
    columns = [f"x{i}" for i in range(width)]
    logs = [F.log1p(F.col(c).cast("double")).alias(f"log_{c}") for c in COUNTS]
    wide = source.select(*(F.col("x")[i].alias(c) for i, c in enumerate(columns)), *logs)
    mean, p = null_projection(wide, columns, [f"log_{c}" for c in COUNTS], rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(x=list((np.array(b["x"].tolist()) - mean) @ p))

    return rows.mapInPandas(run, rows.schema)


def _typed_medians(target: DataFrame, source: DataFrame) -> DataFrame:
    median = lambda rows, name: percentiles(rows.where("cell_type IS NOT NULL"), "syn_out", {name: 0.5}, ("cell_type",))
    return median(target, "t").join(median(source, "s"), "cell_type").select("cell_type", log2_ratio(F.col("t"), F.col("s")).alias("ratio")).where("ratio IS NOT NULL")


def forward_mechanism(source: DataFrame, target: DataFrame, c: float = 0.01, least_cells: int = 10, least_types: int = 8, least_class: int = 40, rounds: tuple[int, ...] = (1, 4, 16)) -> dict[str, DataFrame]:
    """QRY17: A the read-out's score; B accuracy by type against the ratio of output synapses: correlation over all types, by class and by ratio bin; C accuracy by class and quartile of
    output synapses; D scores with the directions of log counts taken out; E whether the nearest source train neighbour has the row's type, by class, with chance."""
    train = source.where("split = 'train'")
    called = read_out(train, target, c)
    out = {"A": _f1(called, "linear")}

    typed = called.where("cell_type IS NOT NULL").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc"), F.mode("true", True).alias("class"))
    types = stored(typed.where(F.col("n") >= least_cells).join(_typed_medians(target, source), "cell_type"), "report-types")
    out["B"] = correlations(types, "ratio", "acc").withColumn("class", F.lit("all"))
    for (name,) in types.groupBy("class").count().where(F.col("count") >= least_types).select("class").orderBy("class").collect():
        out["B"] = out["B"].unionByName(correlations(types.where(F.col("class") == name), "ratio", "acc").withColumn("class", F.lit(name)))
    place = F.when(F.col("ratio") <= 0, "<=1x").when(F.col("ratio") <= 1, "1-2x").when(F.col("ratio") <= 2, "2-4x").otherwise(">4x")
    out["B by ratio"] = types.groupBy(place.alias("ratio_bin")).agg(F.count(F.lit(1)).alias("types"), F.avg("acc").alias("acc"))

    large = called.join(called.groupBy("true").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= least_class).select("true"), "true")
    out["C"] = quantile_bin(large, "syn_out", 4, ("true",), "id", "quartile").groupBy("true", "quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc"))

    out["D"] = _f1(called, "none")
    for r in rounds:
        out["D"] = out["D"].unionByName(_f1(read_out(without_counts(train, train, r), without_counts(target, train, r), c), f"{r} rounds"))

    scaler = probes.fit_scaler(train)
    of_types = train.where("cell_type IS NOT NULL").select("cell_type").distinct()
    asked = target.where("label IS NOT NULL").join(of_types, "cell_type", "left_semi")
    near = probes.neighbours(probes.scaled(asked, scaler), probes.scaled(train, scaler).withColumn("label", F.col("cell_type")), 1, "cosine")
    same = near.select("id", F.col("label").alias("near_type")).join(called, "id").withColumn("same", F.coalesce((F.col("near_type") == F.col("cell_type")).cast("double"), F.lit(0.0)))
    same = stored(same, "report-near")
    out["E"] = same.groupBy("true").agg(F.count(F.lit(1)).alias("n"), F.avg("same").alias("same_type"), F.avg("ok").alias("acc"))
    out["E by neighbour"] = same.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc"))
    share = train.groupBy("cell_type").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(train.agg(F.count(F.lit(1)).alias("all"))))  # one row
    out["E chance"] = same.join(share, "cell_type", "left").agg(F.avg("same").alias("same_type"), F.avg(F.coalesce(F.col("c") / F.col("all"), F.lit(0.0))).alias("chance"))
    return out


def reverse_drop(source: DataFrame, target: DataFrame, of: str, c: float = 1.0) -> dict[str, DataFrame]:
    """QRY18: how one class (of) fares when the read-out goes the other way: the confusion, its rows by type, how many of them have a type that the source labels, scores by whether the type
    is one the source labels, scores with the target's own statistics, and the class's counts where the call is right and wrong, with the Mann-Whitney test of output synapses."""
    known = source.where("label IS NOT NULL")
    called = read_out(source, target, c)
    mine = called.where(F.col("true") == of)
    shares = called.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))
    wrong = mine.where("ok = 0").groupBy("cell_type", "pred").agg(F.count(F.lit(1)).alias("c")).groupBy("cell_type").agg(F.min_by("pred", F.struct(-F.col("c"), F.col("pred"))).alias("top_wrong"))
    by_type = mine.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("correct"))
    types = lambda rows, name: rows.where("cell_type IS NOT NULL").select("cell_type").distinct().withColumn(name, F.lit(1.0))
    covered = called.join(types(known, "_in"), "cell_type", "left").join(types(known.where(F.col("label") == of), "_of"), "cell_type", "left").na.fill(0.0, ["_in", "_of"])
    covered = stored(covered.withColumn("type_in_source", F.col("_in") > 0), "report-covered")
    own = read_out(source, target, c, target)
    named = lambda rows, name: class_scores(confusion(rows)).withColumn("scaler", F.lit(name))
    counts = mine.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))
    for k in COUNTS:
        counts = counts.join(percentiles(mine, k, {f"median_{k}": 0.5}, ("ok",)), "ok", "left")
    return {
        "score": _f1(called, "source statistics").unionByName(_f1(own, "own statistics")),
        "confusion": shares.join(called.groupBy("true").agg(F.count(F.lit(1)).alias("_n")), "true").select("true", "pred", "n", (F.col("n") / F.col("_n")).alias("share")),
        "types": by_type.join(wrong.withColumnRenamed("cell_type", "_t"), F.col("cell_type").eqNullSafe(F.col("_t")), "left").drop("_t"),
        "coverage": covered.agg(F.avg("_in").alias("all_rows"), F.avg(F.when(F.col("true") == of, F.col("_of"))).alias("of_class")),
        "by coverage": score(covered, None, ("type_in_source",)).select("type_in_source", "n", "macro_f1", "accuracy"),
        "classes": named(called, "source").unionByName(named(own, "own")),
        "counts": counts,
        "test": mann_whitney(mine.withColumn("_v", F.col("syn_out").cast("double")), "_v", F.col("ok") > 0),
        "quartiles": quantile_bin(mine, "syn_out", 4, (), "id", "quartile").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("share")),
    }
