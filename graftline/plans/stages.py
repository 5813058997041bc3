"""The stages from canonical tables to features, tokens, embeddings and reports; each reads and writes tables under one folder."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import labels as L
from graftline.operators import encoder, flow, probes, scaling, scoring, slicing, splits, tokens, training
from graftline.operators import features as X
from graftline.plans import volumes
from graftline.plans.storage import stored
from graftline.sources import tables as T

#: Probe targets, in order.
PLAN = ("nt_best", "nt_known", "nt_train", "super_class", "hemilineage", "cell_type")


class Folder:
    """Tables of one volume in one folder."""

    def __init__(self, spark: SparkSession, path: str, volume: str):
        self.spark, self.path, self.volume = spark, path.rstrip("/"), volume

    def at(self, kind: str) -> str:
        return f"{self.path}/{self.volume}_{kind}.parquet"

    def read(self, kind: str) -> DataFrame:
        return T.required(self.spark, self.at(kind), f"stage {kind}")

    def write(self, kind: str, df: DataFrame) -> DataFrame:
        T.write_table(df, self.at(kind))
        return self.read(kind)

    def nodes(self) -> DataFrame:
        return self.read("nodes").withColumn("id", F.col("node_id").cast("long"))


def intake(to: Folder, made: tuple[DataFrame, DataFrame]) -> str:
    nodes, edges = (to.write(kind, df) for kind, df in zip(("nodes", "edges"), made, strict=True))
    volumes.check_schema(nodes, edges)
    return T.report(volumes.report(nodes, edges))


def make_splits(to: Folder, seed: int = 0, stratify_on: tuple[str, ...] = ("nt_best", "super_class")) -> str:
    nodes = L.harmonise(to.nodes())
    both = splits.random_split(splits.blocked_split(nodes, list(stratify_on), "cell_type", seed), seed)
    to.write("splits", both.select("node_id", "split", "split_random"))
    met = nodes.join(to.read("splits"), "node_id")
    audit = [splits.leak_audit(met, s, ["cell_type", "hemilineage"], F.col("nt_best").isNotNull()).unionByName(splits.twin_share(met, s)).withColumn("by", F.lit(s)) for s in ("split", "split_random")]
    cover = [splits.label_coverage(met, "split", t).withColumn("target", F.lit(t)) for t in stratify_on]
    return "\n".join(T.report(df) for df in (*audit, *cover))


def feature_blocks(to: Folder, kinds: tuple[str, ...] = ("connection", "rwse", "flow", "local", "local_tri")) -> None:
    """Each block is its own table with a row for every node, so a stage that was lost is made again alone.

    Every column is 0 for a node without an edge, and only such nodes are filled: a part of a block that lacks a node with an edge to another is an error.
    """
    edges, nodes = to.read("edges").selectExpr("CAST(pre AS long) pre", "CAST(post AS long) post", "w"), to.nodes()
    linked = stored(edges.where("pre <> post").select(F.explode(F.array("pre", "post")).alias("id")).distinct(), "linked")
    make = {
        "connection": lambda: [X.connection_features(edges)],
        "rwse": lambda: [X.walk_features(X.return_probabilities(edges, keep=to.at("rwse_parts")))],
        "flow": lambda: [flow.flow_block(edges, nodes.select("id"))[0]],
        "local": lambda: [X.reciprocity(edges), X.partner_degree(edges), X.core_numbers(edges).drop("core")],
        "local_tri": lambda: [X.triangles(edges)],
    }
    for kind in kinds:
        parts = [stored(df, f"block-{kind}") for df in make[kind]()]
        for df in parts:
            if not linked.join(df, "id", "left_anti").isEmpty():
                raise ValueError(f"a part of block {kind} ({', '.join(df.columns[1:3])}...) lacks nodes that have edges")
        to.write(kind, X.assemble(nodes.select("id"), *parts))


def features(at: Folder, columns: tuple[str, ...] | None = X.REFINED) -> DataFrame:
    """FEA-A3: (id, features) of all nodes in the columns' order of the blocks; every block must be there, with every node."""
    whole = X.attach(at.nodes().select("id"), *(at.read(k) for k in ("connection", "rwse", "flow", "local", "local_tri")))
    return whole if columns is None else X.select_columns(whole, list(columns))


def volume_inputs(at: Folder, columns: tuple[str, ...] | None = X.REFINED) -> dict:
    """SRC14: what a model of one volume reads: nodes, their split within the scope, edges, standardised features and the statistics they were standardised by."""
    nodes, whole = at.nodes(), features(at, columns)
    whole = whole.withColumnsRenamed({c: c.replace("@", "_at_") for c in whole.columns})
    split = nodes.join(at.read("splits"), "node_id").select("id", L.restrict_split(F.col("split"), F.col("is_seed")).alias("split"))
    names = whole.columns[1:]
    stats = scaling.fit_scale(whole.join(split, "id"), names, F.col("split") == "train")
    return {"nodes": nodes, "split": split, "edges": at.read("edges"), "features": scaling.apply_scale(whole, stats, names), "stats": stats}


def probe_sweep(at: Folder, embedding: DataFrame, targets: tuple[str, ...] = PLAN, scopes: dict | None = None, **how) -> dict:
    """PRB2: probes within the volume for each target and scope (name -> mask over the nodes)."""
    nodes = L.harmonise(at.nodes()).join(at.read("splits"), "node_id").withColumn("split", L.restrict_split(F.col("split"), L.in_scope("brain")))
    return probes.sweep(nodes.join(embedding, "id"), list(targets), scopes or {"whole_brain": F.lit(True)}, **how)


def top_k(to: Folder, k: int = 64) -> str:
    edges = to.read("edges")
    to.write("topk", tokens.token_arrays(tokens.top_partners(edges, k)))
    return T.report(tokens.token_stats(edges, to.read("nodes").count(), k))


def baseline_embedding(at: Folder, method: str = "raw", source: Folder | None = None) -> DataFrame:
    """NN13/NN8/SCL2: (id, x): raw features, the degree block, partner composition or two untrained propagation steps, standardised by the source's connected train rows."""
    def columns(f: Folder) -> DataFrame:
        whole = features(f, None if method == "degree" else X.REFINED)
        edges = f.read("edges")
        if method == "degree":
            return whole.select("id", *(F.col(f"`{c}`") for c in X.DEGREES))
        if method == "composition":
            known = L.harmonise(f.nodes()).select("id", F.col("nt_best").alias("label"))
            shares = tokens.composition(edges, known, list(L.V.TRANSMITTERS))
            side = lambda s: shares.where(F.col("side") == s).select("id", *(F.col(c).alias(f"{c}_{s}") for c in shares.columns[2:]))
            return X.assemble(whole.select("id"), side("out"), side("in"))
        if method == "propagate":
            names = {c: c.replace("@", "_at_") for c in whole.columns}
            base = whole.withColumnsRenamed(names)
            parts = [base]
            for direction in ("in", "out"):
                step = tokens.propagate(edges, base, base.columns[1:], "mean", direction)
                parts.append(step.select("id", *(F.col(c).alias(f"{c}_{direction}_1") for c in base.columns[1:])))
            return X.assemble(whole.select("id"), *parts)
        if method != "raw":
            raise ValueError(f"unknown method {method!r}: raw, degree, composition or propagate")
        return whole

    plain = lambda df: df.withColumnsRenamed({c: c.replace("@", "_at_") for c in df.columns})
    own, base = plain(columns(at)), source or at
    theirs = own if source is None else plain(columns(base))
    mask = L.restrict_split(F.col("split"), F.col("is_seed")) == "train"
    train = theirs.join(base.nodes().join(base.read("splits"), "node_id").select("id", "split", "is_seed"), "id")
    names = own.columns[1:]
    scaled = scaling.apply_scale(own, scaling.fit_scale(train, names, mask), names)
    return scaled.select("id", F.array(*(F.col(c).cast("double") for c in names)).alias("x"))


def untrained_embedding(at: Folder, k: int = 64, width: int = 128, heads: int = 8, layers: int = 4, seed: int = 0) -> DataFrame:
    """NN2/NN5: the encoder at initialisation over each node's tokens."""
    x = baseline_embedding(at, "raw")
    sets = tokens.gather(T.checked_tokens(at.read("topk"), k), x)
    d_in = len(x.first()["x"])
    return encoder.embed(sets, encoder.random_weights(d_in, width, heads, layers, len(L.V.TRANSMITTERS), seed), k).select("id", F.col("embedding").alias("x"))


#: Seed tokens that class codes are scaled to: so many of smallest digest.
CODE_ROWS = 4096


def train_encoder(at: Folder, target: str = "nt_best", k: int = 64, width: int = 128, heads: int = 8, layers: int = 4, steps: int = 1000, batch: int = 1024, rate: float = 3e-4, seed: int = 0) -> str:
    """NN6, NN7, SNK4c: trains the encoder on the labelled train rows of a volume and writes its weights, the loss of each step and the target's statistics, which are returned. The state lies beside
    them, under the settings' digest; a run that was cut off goes on from it."""
    settings = {"target": target, "k": k, "width": width, "heads": heads, "layers": layers, "batch": batch, "rate": rate, "seed": seed}
    sets = tokens.gather(T.checked_tokens(at.read("topk"), k), baseline_embedding(at, "raw"))
    classes = F.array(*(F.lit(c) for c in L.V.TRANSMITTERS))
    rows = L.harmonise(at.nodes()).join(at.read("splits"), "node_id").withColumn("split", L.restrict_split(F.col("split"), L.in_scope("brain")))
    coded = rows.where(F.col("split") == "train").select("id", (F.array_position(classes, F.col(target)) - 1).cast("int").alias("code")).where("code >= 0")
    sets = stored(sets.join(coded, "id"), "training-sets")
    some = [r.seed for r in splits.cohort(sets, CODE_ROWS, seed).select("seed").collect()]
    if not some:
        raise ValueError(f"no labelled train row for {target}")
    weights = encoder.random_weights(len(some[0]), width, heads, layers, len(L.V.TRANSMITTERS), seed)
    weights, scale = encoder.calibrate_codes(weights, np.pad(np.array(some, float), ((0, 0), (0, 2))))
    name = hashlib.md5(json.dumps(settings, sort_keys=True).encode()).hexdigest()
    done = training.train(sets, weights, k, steps, batch, rate, seed=seed, state=f"{at.path}/{at.volume}_encoder_state/{name}")
    at.write("encoder", training.weights_table(at.spark, done["weights"], settings | {"steps": steps}))
    at.write("encoder_loss", at.spark.createDataFrame([(c["step"], c["loss"]) for c in done["curve"]], "step int, loss double").coalesce(1))
    told = settings | done["stats"] | {"steps": steps, "code_norm": scale, "loss": done["curve"][-1]["loss"] if done["curve"] else None}
    at.write("encoder_report", at.spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "report string"))
    return json.dumps(told, sort_keys=True)


def trained_embedding(at: Folder, source: Folder | None = None) -> DataFrame:
    """NN5, SRC11: (id, x) by the encoder that was trained on the source (or on this volume), the class unknown for every node; features are scaled by the source's statistics."""
    weights, settings = training.read_weights((source or at).read("encoder"))
    sets = tokens.gather(T.checked_tokens(at.read("topk"), settings["k"]), baseline_embedding(at, "raw", source))
    unknown = sets.withColumn("code", F.lit(None).cast("int"))
    return encoder.embed(unknown, weights, settings["k"], shown="code").select("id", F.col("embedding").alias("x"))


def outside_embedding(at: Folder, path: str) -> DataFrame:
    """SRC9/SRC10: (id, x) of vectors made elsewhere, a table of id and x with one row for each node of the volume."""
    given = T.checked_vectors(at.spark.read.parquet(path).select(F.col("id").cast("long").alias("id"), "x"), "x", at.nodes().count())
    if not at.nodes().select("id").join(given, "id", "left_anti").isEmpty():
        raise ValueError(f"{path} lacks nodes of {at.volume}")
    return given.withColumn("x", F.col("x").cast("array<double>"))


def probe_rows(at: Folder, embedding: DataFrame, target: str, split: str = "split", source: bool = True) -> DataFrame:
    nodes = L.harmonise(at.nodes()).withColumn("connected", L.in_scope("brain"))
    met = nodes.join(at.read("splits"), "node_id").withColumn("split", L.restrict_split(F.col(split), F.col("connected")))
    kept = met if source else met.where("connected")
    return kept.select("id", F.col(target).alias("label"), "split", "status").join(embedding, "id")


def zero_shot(source: Folder, target: Folder, x_source: DataFrame, x_target: DataFrame, plan: tuple[str, ...] = PLAN, out: str | None = None, **how) -> dict:
    """PRB10: every target of the plan; predictions are written by target and place, reports returned."""
    reports, written = {}, None
    for t in plan:
        rows, found = probes.transfer(probe_rows(source, x_source, t), probe_rows(target, x_target, t, source=False), **how)
        reports[t] = {k: v for k, v in found.items() if k not in ("probe", "scaler")}
        if rows is None:
            continue
        rows = rows.withColumn("probe_target", F.lit(t))
        if t == "nt_train":
            status = target.nodes().select("id", "status")
            reports["by_status"] = [r.asDict() for r in slicing.by_status(rows.where(F.col("where") == "target").join(status, "id")).collect()]
        written = rows if written is None else written.unionByName(rows, allowMissingColumns=True)
    if out and written is not None:
        T.write_table(written, out, ("probe_target", "where"))
    return reports


def breakdown(rows: DataFrame, slices: list[str], type_: str | None = None) -> str:
    """QRY2-5, SCR5 of one target's predictions as markdown."""
    rows = stored(rows, "breakdown")
    target = rows.where(F.col("where") == "target")
    parts = [("Classes", slicing.per_class(rows)), ("Slices", slicing.slices(target, slices)), ("Confidence", scoring.coverage(target)), ("Triage", scoring.triage(target)), ("Calibration", scoring.calibration_error(target))]
    if type_:
        parts.append(("Worst types", slicing.worst(slicing.by_type(target, type_))))
    return "\n\n".join(f"## {name}\n\n{T.markdown(df)}" for name, df in parts)


def label_audit(at: Folder, other: Folder | None = None) -> str:
    """QRY6: disagreements of experimental and predicted labels, by change and by type, and the agreement of types across volumes."""
    nodes = L.harmonise(at.nodes())
    parts = [slicing.changes(nodes, "nt_known", "nt_train"), slicing.changed_types(nodes.where("nt_known IS NOT NULL"), "cell_type", "nt_known", "nt_train")]
    if other:
        parts.append(slicing.type_agreement(nodes, L.harmonise(other.nodes()), "cell_type", "nt_best"))
    return "\n".join(T.report(df) for df in parts)


def release(at: Folder, predictions: DataFrame, out: str, targets: dict[str, str] | None = None) -> str:
    """QRY19/QRY20: one row a connected node with both probes' calls, and the splits by source id; fails unless each node is there once."""
    nodes = at.nodes().where(L.in_scope("brain"))
    table = stored(slicing.release_table(nodes.select("id", "source_id", "cell_type", "super_class", "nt_known", "nt_train"), predictions, targets or {"nt_known": "explabel_linear", "nt_best": "trainlabel_linear"}), "release")
    wrong = slicing.uncovered(nodes.select("id"), table.select("id"), "id")
    if not wrong.isEmpty():
        raise ValueError(f"release does not cover its nodes once: {wrong.take(5)}")
    T.write_csv(table, f"{out}/table")
    T.write_csv(at.nodes().join(at.read("splits"), "node_id").select("source_id", "split", "split_random"), f"{out}/splits")
    return json.dumps({"rows": table.count(), "scored": table.where("scored").count()})
