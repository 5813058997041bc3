"""Strongest partners and partner classes (TOP1-7, AGG18, NN1, NN8-10, NN13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.operators.edges import symmetrised
from graftline.operators.splits import hash_share
from graftline.plans.ordered import percentiles
from graftline.plans.storage import stored


def top_partners(edges: DataFrame, k: int = 64) -> DataFrame:
    """TOP1: (id, rank, partner, weight, sign), the k heaviest connections of each node over both directions; ties by out before
    in, then by partner. Ranks are cut before the shuffle where a task has more than k rows of a node."""
    order = Window.partitionBy("i").orderBy(F.desc("w"), F.desc("sign"), "j")
    ranked = symmetrised(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("i").alias("id"), (F.col("rank") - 1).alias("rank"), F.col("j").alias("partner"), F.log1p(F.col("w").cast("double")).alias("weight"), "sign")


def token_arrays(top: DataFrame) -> DataFrame:
    """(id, tokens, length): ragged arrays in order of rank, at most k long."""
    packed = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "partner", "weight", "sign"))).alias("tokens"))
    return packed.withColumn("length", F.size("tokens"))


def token_stats(edges: DataFrame, n_nodes: int, k: int = 64) -> DataFrame:
    """TOP2: one row: degree percentiles, and the shares of nodes cut and connections kept at k."""
    degree = stored(symmetrised(edges).groupBy("i").agg(F.count(F.lit(1)).alias("d")), "token-degrees")
    kept = F.least("d", F.lit(k))
    sums = degree.agg(
        F.max("d").alias("most"), (F.count_if(F.col("d") > k) / n_nodes).alias("truncated_share"), (F.sum(kept) / F.sum("d")).alias("kept_share"),
        (n_nodes - F.count(F.lit(1))).alias("isolated"), (F.sum(kept) / (n_nodes * k)).alias("fill"),
    )
    return percentiles(degree, "d", {"median": 0.5, "p90": 0.9, "p99": 0.99}).crossJoin(F.broadcast(sums))  # one row each


def composition(edges: DataFrame, labels: DataFrame, vocabulary: list[str]) -> DataFrame:
    """AGG18: (id, side, one share of weight for each class and for unknown); labels: (id, label). out goes to a partner, in comes from one."""
    met = symmetrised(edges).join(labels.select(F.col("id").alias("j"), "label"), "j", "left")
    known = F.when(F.col("label").isin(*vocabulary), F.col("label")).otherwise("unknown")
    side = F.when(F.col("sign") > 0, "out").otherwise("in")
    total = F.greatest(F.sum("w"), F.lit(1))
    shares = [(F.sum(F.when(known == c, F.col("w")).otherwise(0)) / total).alias(c) for c in (*vocabulary, "unknown")]
    return met.groupBy(F.col("i").alias("id"), side.alias("side")).agg(*shares)


def gather(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """NN1: (id, seed, partners): the features (id, x) of each node and of its tokens in order, with log weight and sign."""
    flat = tokens.select("id", F.inline("tokens"))
    met = flat.join(features.select(F.col("id").alias("partner"), "x"), "partner")
    packed = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "weight", "sign"))).alias("partners"))
    return features.select("id", F.col("x").alias("seed")).join(packed, "id", "left")


def propagate(edges: DataFrame, features: DataFrame, columns: list[str], how: str = "mean", direction: str = "in", weight: str | None = None) -> DataFrame:
    """NN8/NN9/JOI14: one step of untrained message passing: the (weighted) mean or sum of partners' columns, by node. in gathers
    from pre to post, out the other way."""
    src, dst = ("pre", "post") if direction == "in" else ("post", "pre")
    met = edges.join(features.withColumnRenamed("id", src), src)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = {"sum": lambda c: F.sum(w * F.col(c)), "mean": lambda c: F.sum(w * F.col(c)) / F.sum(w)}[how]
    return met.groupBy(F.col(dst).alias("id")).agg(*(total(c).alias(c) for c in columns))


def attention(edges: DataFrame, scores: str, features: DataFrame, columns: list[str]) -> DataFrame:
    """NN10: softmax of an edge score over each node's incoming edges, applied to the partners' columns; sums, no window."""
    top = edges.groupBy("post").agg(F.max(scores).alias("_top"))
    met = edges.join(top, "post").join(features.withColumnRenamed("id", "pre"), "pre")
    e = F.exp(F.col(scores) - F.col("_top"))
    return met.groupBy(F.col("post").alias("id")).agg(*((F.sum(e * F.col(c)) / F.sum(e)).alias(c) for c in columns))


def dropped_edges(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """NN8: edges without a share of them, by hash, so that reruns agree."""
    return edges.where(hash_share(F.col("pre"), F.col("post"), F.lit(seed)) >= share)


def _linear(df: DataFrame, inputs: list[str], weights: list[list[float]], bias: list[float], relu: bool = True) -> DataFrame:
    """(id, h0, h1, ...): one column for each row of weights, by expressions."""
    made = [sum((F.lit(float(w)) * F.col(c) for w, c in zip(row, inputs, strict=True)), F.lit(float(b))) for row, b in zip(weights, bias, strict=True)]
    return df.select("id", *((F.greatest(m, F.lit(0.0)) if relu else m).alias(f"h{k}") for k, m in enumerate(made)))


def _met(edges: DataFrame, h: DataFrame, how: str, directions: list[str], weight: str | None) -> DataFrame:
    """h and, under _<direction>_<column>, what its partners send (0 without one)."""
    met = h
    for direction in directions:
        sent = propagate(edges, h, h.columns[1:], how, direction, weight)
        met = met.join(sent.withColumnsRenamed({c: f"_{direction}_{c}" for c in sent.columns[1:]}), "id", "left")
    return met.na.fill(0.0)


def sage_layer(edges: DataFrame, h: DataFrame, own: list[list[float]], near: list[list[float]], bias: list[float], relu: bool = True, near_out: list[list[float]] | None = None, weight: str | None = None) -> DataFrame:
    """NN10: own weights of a node's columns and near weights of its incoming partners' mean (0 without one), by weight if one is named; with near_out,
    those of the outgoing partners' mean as well."""
    names, sides = h.columns[1:], {"in": near} | ({"out": near_out} if near_out else {})
    met = _met(edges, h, "mean", list(sides), weight)
    rows = [[x for part in parts for x in part] for parts in zip(own, *sides.values(), strict=True)]
    return _linear(met, [*names, *(f"_{s}_{c}" for s in sides for c in names)], rows, bias, relu)


def gin_layer(edges: DataFrame, h: DataFrame, weights: list[list[float]], bias: list[float], eps: float = 0.0, relu: bool = True, weights_out: list[list[float]] | None = None, eps_out: float = 0.0, weight: str | None = None) -> DataFrame:
    """NN10: weights of 1 + eps times a node's columns and its incoming partners' (weighted) sum; with weights_out, those of the outgoing partners' side as well."""
    names, sides = h.columns[1:], {"in": (weights, eps)} | ({"out": (weights_out, eps_out)} if weights_out else {})
    met = _met(edges, h, "sum", list(sides), weight)
    mixed = met.select("id", *(((1 + e) * F.col(c) + F.col(f"_{s}_{c}")).alias(f"{s}_{c}") for s, (_, e) in sides.items() for c in names))
    rows = [[x for part in parts for x in part] for parts in zip(*(w for w, _ in sides.values()), strict=True)]
    return _linear(mixed, mixed.columns[1:], rows, bias, relu)


def _attended(edges: DataFrame, h: DataFrame, direction: str, lin: list[list[float]], src: list[list[float]], dst: list[list[float]], weight: list[float], slope: float) -> DataFrame:
    """(id, h0, h1, ...): partners' projected columns, averaged by a softmax for each head of leaky scores of both ends and of the edge's log weight."""
    partner, own = ("pre", "post") if direction == "in" else ("post", "pre")
    heads, c = len(src), len(src[0])
    x = _linear(h, h.columns[1:], lin, [0.0] * (heads * c), relu=False)
    score = lambda a, k: sum(F.lit(float(v)) * F.col(f"h{k * c + i}") for i, v in enumerate(a[k]))
    ends = edges.select(F.col(partner).alias("_p"), F.col(own).alias("_o"), F.log1p(F.col("w").cast("double")).alias("_w"))
    met = ends.join(x.select(F.col("id").alias("_p"), *(score(src, k).alias(f"_s{k}") for k in range(heads))), "_p")
    met = met.join(x.select(F.col("id").alias("_o"), *(score(dst, k).alias(f"_d{k}") for k in range(heads))), "_o")
    raw = [F.col(f"_s{k}") + F.col(f"_d{k}") + F.lit(float(weight[k])) * F.col("_w") for k in range(heads)]
    logits = stored(met.select("_p", "_o", *(F.when(r > 0, r).otherwise(slope * r).alias(f"_e{k}") for k, r in enumerate(raw))), "attention")
    top = logits.groupBy("_o").agg(*(F.max(f"_e{k}").alias(f"_m{k}") for k in range(heads)))
    share = [F.exp(F.col(f"_e{k}") - F.col(f"_m{k}")) for k in range(heads)]
    sent = logits.join(top, "_o").join(x.withColumnRenamed("id", "_p"), "_p")
    return sent.groupBy(F.col("_o").alias("id")).agg(*((F.sum(share[j // c] * F.col(f"h{j}")) / F.sum(share[j // c])).alias(f"h{j}") for j in range(heads * c)))


def gat_layer(edges: DataFrame, h: DataFrame, own: list[list[float]], bias: list[float], sides: dict[str, dict], relu: bool = True, slope: float = 0.2) -> DataFrame:
    """NN10: own weights of a node's columns plus, for each direction of sides, its partners' columns by attention (0 without one). A direction has weights of its own: lin (a row for each
    column made), src and dst (a vector for each head) and weight (of the log weight, one a head). An edge carries a score a head to the shuffle; columns meet it once."""
    made = _linear(h, h.columns[1:], own, bias, relu=False)
    for direction, given in sides.items():
        sent = _attended(edges, h, direction, slope=slope, **given)
        made = made.join(sent.withColumnsRenamed({c: f"_{c}" for c in sent.columns[1:]}), "id", "left").select("id", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in made.columns[1:]))
    return made.select("id", *(F.greatest(F.col(c), F.lit(0.0)).alias(c) for c in made.columns[1:])) if relu else made


def gnn_forward(edges: DataFrame, h: DataFrame, layers: list[dict]) -> DataFrame:
    """NN11: a stack's forward pass: each layer is {"kind": "sage", "gin" or "gat", its weights, and optionally "norm": (mean, deviation, scale, shift) of each column, kept from the source}."""
    for layer in layers:
        given = {k: v for k, v in layer.items() if k not in ("kind", "norm")}
        h = {"sage": sage_layer, "gin": gin_layer, "gat": gat_layer}[layer["kind"]](edges, h, relu=False, **given)
        norm = layer.get("norm") or [(0.0, 1.0, 1.0, 0.0)] * (len(h.columns) - 1)
        h = h.select("id", *(F.greatest((F.col(c) - m) / s * g + b, F.lit(0.0)).alias(c) for c, (m, s, g, b) in zip(h.columns[1:], norm, strict=True)))
    return h
