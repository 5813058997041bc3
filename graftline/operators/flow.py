"""Hierarchy levels of a directed graph (FEA-F1 to F6, AGG21, AGG22): trophic levels and SpringRank by conjugate gradients.

Vectors are DataFrames keyed by node; the matrix stays where it is, the vectors come to it by a join, and only inner products reach
the driver, at every size. Systems of one graph, whatever their weights, run side by side as columns of the same steps.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graftline.functions.labels import weighted
from graftline.operators.clusters import clusters
from graftline.operators.components import components
from graftline.operators.edges import symmetrised
from graftline.plans.storage import stored

WEIGHTINGS = ("binary", "raw", "log1p")
ALPHAS = (0.0, 0.1, 1.0, 10.0)
#: Clusters of the coarse system, at most: its matrix, of so many squared, is solved on the driver. A graph of under four times as many nodes has none.
MOST_CLUSTERS = 1024


def component_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG21: (id, component) of nodes (id); the component is its smallest id, a node without edge its own."""
    found = components(edges.select(F.col("pre").alias("a"), F.col("post").alias("b")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component"))


def laplacians(edges: DataFrame, weightings: tuple[str, ...] = WEIGHTINGS) -> tuple[DataFrame, DataFrame]:
    """FEA-F3: (i, j, v_<weighting>...) of the symmetrised weights without loops, and (i, d_<weighting>, b_<weighting>...) with d the
    strength and b in- minus out-weight."""
    w = F.struct(*(weighted(k, F.col("w")).cast("double").alias(k) for k in weightings)).alias("w")
    both = symmetrised(edges.where("pre <> post").select("pre", "post", w))
    off = stored(both.groupBy("i", "j").agg(*(F.sum(f"w.{k}").alias(f"v_{k}") for k in weightings)), "laplacian")
    sums = [c for k in weightings for c in (F.sum(f"w.{k}").alias(f"d_{k}"), F.sum(-F.col("sign") * F.col(f"w.{k}")).alias(f"b_{k}"))]
    return off, stored(both.groupBy("i").agg(*sums), "diagonal")


def _coarse(off: DataFrame, diagonal: DataFrame, systems: dict[int, tuple[str, int, float]]) -> tuple[DataFrame, dict[int, np.ndarray]] | None:
    """(i, c), the clusters of the graph, and the inverse of each system on them; None for a graph that is small."""
    if diagonal.count() < 4 * MOST_CLUSTERS:
        return None
    names = list(dict.fromkeys(w for w, _, _ in systems.values()))
    of = clusters(off.select("i", "j", F.col(f"v_{names[0]}").alias("v")), diagonal.select("i"), MOST_CLUSTERS)
    end = lambda c, name: of.select(F.col("i").alias(c), F.col("c").alias(name)).hint("shuffle_hash")
    between = off.join(end("i", "a"), "i").join(end("j", "b"), "j").where("a <> b").groupBy("a", "b").agg(*(F.sum(f"v_{w}").alias(w) for w in names)).toArrow()
    sizes = of.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros(sizes.num_rows)
    n[sizes["c"].to_numpy()] = sizes["n"].to_numpy()
    inverse = {}
    for k, (w, _, alpha) in systems.items():
        e = np.zeros((len(n), len(n)))
        e[between["a"].to_numpy(), between["b"].to_numpy()] = -between[w].to_numpy()
        np.fill_diagonal(e, alpha * n - e.sum(axis=1))
        scale = np.sqrt(np.maximum(np.diag(e), 1e-300))
        value, vector = np.linalg.eigh((e + e.T) / (2 * np.outer(scale, scale)))
        kept = value > 1e-12  # a component's constant is not in the range of a system without alpha
        vector = vector[:, kept] / scale[:, None]
        inverse[k] = (vector / value[kept]) @ vector.T
    return of, inverse


def solve(off: DataFrame, diagonal: DataFrame, systems: dict[str, tuple[str, int, float]], rtol: float = 1e-10, maxiter: int = 5000) -> tuple[DataFrame, dict[str, dict]]:
    """FEA-F4: (i, <name>...) with (L + alpha I) x = sign b for each {name: (weighting, sign, alpha)}, by Jacobi-preconditioned conjugate
    gradients from zero, and the status of each.

    The matrix is dealt once by column and kept in the executors, where its stored table makes good what is lost. One product and one
    reduction of its stored rows make an iteration of all systems: what moves is one row of values a node to the columns, and one sum a
    row and task back. A system that has converged stands still. Each step is stored, so a lost executor costs one step.

    Parts of a graph that few edges tie together differ by what Jacobi steps carry from one to the next, an edge a step. On large graphs the preconditioner
    therefore adds the solution of the system on clusters: the driver is sent sums of residuals by cluster, and sends a value a cluster back.
    """
    parts = int(off.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrix = off.repartition(parts, "j").sortWithinPartitions("j").persist()
    of = dict(enumerate(systems.values()))
    coarse = _coarse(off, diagonal, of)
    keep = ["i", *(["c"] if coarse else []), *(f"m{k}" for k in of)]
    left = lambda k, a: F.col(f"r{k}") - a[k] * F.col(f"q{k}")

    def product(new: DataFrame) -> tuple[DataFrame, list[float]]:
        """new (i, and m, x, r, p of each system) with q, the product with p, stored; and the sums of p q."""
        sent = new.select(F.col("i").alias("j"), *(f"p{k}" for k in of))
        moved = matrix.join(sent, "j").groupBy("i").agg(*(F.sum(F.col(f"v_{w}") * F.col(f"p{k}")).alias(f"a{k}") for k, (w, _, _) in of.items()))
        new = new.join(moved, "i", "left").select(*new.columns, *((F.col(f"m{k}") * F.col(f"p{k}") - F.coalesce(f"a{k}", F.lit(0.0))).alias(f"q{k}") for k in of))
        seen = Observation()  # the sums come with the write, in tasks that count once
        new = stored(new.observe(seen, *(F.sum(F.col(f"p{k}") * F.col(f"q{k}")).alias(f"pq{k}") for k in of)), "cg")
        return new, [seen.get[f"pq{k}"] or 0.0 for k in of]

    def reduced(state: DataFrame, a: list[float]) -> tuple[list[np.ndarray], list[float], list[float]]:
        """Of the residuals after a step of a: what the clusters add to the preconditioned ones, and the sums of r u and r r."""
        sums = [F.sum(c).alias(f"{name}{k}") for k in of for name, c in (("r", left(k, a)), ("ru", left(k, a) * left(k, a) / F.col(f"m{k}")), ("rr", left(k, a) * left(k, a)))]
        table = state.groupBy(*(["c"] if coarse else [])).agg(*sums).toArrow()
        order = np.argsort(table["c"].to_numpy()) if coarse else [0]
        held = {name: table[name].to_numpy()[order] for name in table.column_names if name != "c"}
        told = [coarse[1][k] @ held[f"r{k}"] if coarse else np.zeros(1) for k in of]
        return told, [float(held[f"ru{k}"].sum() + held[f"r{k}"] @ told[k]) for k in of], [float(held[f"rr{k}"].sum()) for k in of]

    try:
        first = [c for k, (w, sign, alpha) in of.items() for c in ((F.col(f"d_{w}") + alpha).alias(f"m{k}"), F.lit(0.0).alias(f"x{k}"), (sign * F.col(f"b_{w}")).alias(f"r{k}"), F.lit(0.0).alias(f"p{k}"), F.lit(0.0).alias(f"q{k}"))]
        state = (diagonal.join(coarse[0], "i") if coarse else diagonal).select(*keep[: -len(of)], *first)
        a, b, done = [0.0] * len(of), [0.0] * len(of), [0] * len(of)
        told, ru, rr = reduced(state, a)
        norm, size = [v**0.5 for v in rr], [v**0.5 for v in rr]
        while live := [k for k in of if size[k] > rtol * norm[k] and done[k] < maxiter]:
            values = F.from_json(F.lit(json.dumps(np.stack(told, axis=1).ravel().tolist())), "array<double>")  # one node of the plan
            made = []
            for k in of:
                u = left(k, a) / F.col(f"m{k}") + (F.get(values, F.col("c") * len(of) + k) if coarse else 0.0)
                p = u + b[k] * F.col(f"p{k}") if k in live else F.lit(0.0)
                made += [(F.col(f"x{k}") + a[k] * F.col(f"p{k}")).alias(f"x{k}"), left(k, a).alias(f"r{k}"), p.alias(f"p{k}")]
            state, pq = product(state.select(*keep, *made))
            a = [ru[k] / pq[k] if k in live and pq[k] else 0.0 for k in of]
            last = ru
            told, ru, rr = reduced(state, a)
            for k in live:
                size[k], b[k], done[k] = rr[k] ** 0.5, ru[k] / last[k] if last[k] else 0.0, done[k] + 1
    finally:
        matrix.unpersist()
    status = {name: {"iterations": done[k], "relative_residual": size[k] / norm[k] if norm[k] else 0.0, "converged": size[k] <= rtol * norm[k]} for k, name in enumerate(systems)}
    return state.select("i", *((F.col(f"x{k}") + a[k] * F.col(f"p{k}")).alias(name) for k, name in enumerate(systems))), status


def centred(values: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """AGG22: the component's mean taken off; the means are aggregates of their own, so a giant component is no single task."""
    met = values.join(labels, "id")
    means = stored(met.groupBy("component").agg(*(F.avg(c).alias(f"_{c}") for c in columns)), "means")
    rest = [c for c in values.columns if c not in columns]
    return met.join(means, "component").select(*(F.col(f"`{c}`") for c in rest), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in columns))


def _trophic(weighting: str) -> tuple[str, tuple[str, int, float]]:
    return f"trophic_{weighting}", (weighting, 1, 0.0)


def _rank(weighting: str, alpha: float) -> tuple[str, tuple[str, int, float]]:
    return f"springrank_{weighting}_a{alpha:g}", (weighting, -1, alpha)


def levels(edges: DataFrame, nodes: DataFrame, systems: dict[str, tuple[str, int, float]], labels: DataFrame | None = None, **how) -> tuple[DataFrame, dict[str, dict]]:
    """(id, <name>...): the solutions on all nodes, 0 without an edge; those without an alpha are centred by component."""
    off, diagonal = laplacians(edges, tuple(dict.fromkeys(w for w, _, _ in systems.values())))
    solution, status = solve(off, diagonal, systems, **how)
    out = nodes.select("id").join(solution.withColumnRenamed("i", "id"), "id", "left").na.fill(0.0)
    isolated = nodes.select("id").join(diagonal.select(F.col("i").alias("id")), "id", "left_anti").count()
    free = [name for name, (_, _, alpha) in systems.items() if not alpha]
    if free:
        out = centred(out, component_labels(edges, nodes) if labels is None else labels, free)
    return out, {name: s | {"isolated_nodes": isolated} for name, s in status.items()}


def trophic_levels(edges: DataFrame, nodes: DataFrame, weighting: str, labels: DataFrame | None = None, **how) -> tuple[DataFrame, dict]:
    """FEA-F1: (id, trophic_<weighting>), centred by component; a node without edge is 0."""
    name, system = _trophic(weighting)
    level, status = levels(edges, nodes, {name: system}, labels, **how)
    return level, status[name]


def springrank(edges: DataFrame, nodes: DataFrame, alpha: float, weighting: str = "log1p", labels: DataFrame | None = None, **how) -> tuple[DataFrame, dict]:
    """FEA-F2: (id, springrank_<weighting>_a<alpha>); alpha 0 is minus the trophic level and is centred, others are not."""
    name, system = _rank(weighting, alpha)
    level, status = levels(edges, nodes, {name: system}, labels, **how)
    return level, status[name]


def _gap(weighting: str, h: str) -> Column:
    w, gap = weighted(weighting, F.col("w")), F.col(f"post.{h}") - F.col(f"pre.{h}") - 1
    return F.sum(w * gap * gap) / F.sum(w)


def _with_levels(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    side = lambda c: values.select(F.col("id").alias(f"_{c}"), F.struct(*names).alias(c))
    return edges.toDF("_pre", "_post", "w").join(side("pre"), "_pre").join(side("post"), "_post")


def incoherence(edges: DataFrame, values: DataFrame, weighting: str, level: str | None = None) -> DataFrame:
    """FEA-F5: one row: sum of w (h_post - h_pre - 1)^2 over the sum of w; loops count with a gap of -1."""
    h = level or f"trophic_{weighting}"
    return _with_levels(edges.select("pre", "post", "w"), values, [h]).agg(_gap(weighting, h).alias("incoherence"))


def flow_block(edges: DataFrame, nodes: DataFrame, alphas=ALPHAS, **how) -> tuple[DataFrame, dict]:
    """FEA-F6: every trophic column, every positive alpha, and the component, by id; all systems are solved in one pass of steps."""
    edges = stored(edges.select("pre", "post", "w"), "flow-edges")  # read five times and more; what they come from is done once
    nodes = stored(nodes, "flow-nodes")
    labels = stored(component_labels(edges, nodes), "components")
    systems = dict([*map(_trophic, WEIGHTINGS), *(_rank("log1p", a) for a in alphas if a)])
    out, report = levels(edges, nodes, systems, labels, **how)
    out = stored(labels.join(out, "id"), "flow")
    names = [f"trophic_{w}" for w in WEIGHTINGS]
    gaps = _with_levels(edges.select("pre", "post", "w"), out, names).agg(*(_gap(w, h).alias(h) for w, h in zip(WEIGHTINGS, names, strict=True))).first()
    return out, {name: s | ({"incoherence": gaps[name]} if name in names else {}) for name, s in report.items()}
