"""The set-transformer encoder's forward pass over token sets (NN2, NN3, NN4, NN5) in numpy, inside Arrow batches.

Weights are a mapping of arrays: random ones, or those that operators/training.py fits by the gradients of backward().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def random_weights(d_in: int, d: int, heads: int, layers: int, n_codes: int, seed: int = 0) -> dict:
    """An untrained encoder, as the untrained arm uses."""
    rng = np.random.default_rng(seed)
    dense = lambda a, b: rng.standard_normal((a, b)) / math.sqrt(a)
    block = lambda: {"qkv": dense(d, 3 * d), "out": dense(d, d), "up": dense(d, 4 * d), "down": dense(4 * d, d)}
    return {"token": dense(d_in + 2, d), "query": rng.standard_normal(d) / math.sqrt(d), "codes": rng.standard_normal((n_codes, d)) / math.sqrt(d), "unknown": rng.standard_normal(d) / math.sqrt(d), "blocks": [block() for _ in range(layers)], "heads": heads}


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)


def norm_slope(x: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The gradient by x of a loss whose gradient by _norm(x) is given."""
    y = _norm(x)
    inner = grad - grad.mean(axis=-1, keepdims=True) - y * (grad * y).mean(axis=-1, keepdims=True)
    return inner / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    t = np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * math.sqrt(2 / math.pi) * (1 + 3 * 0.044715 * x * x)


def forward(weights: dict, tokens: np.ndarray, valid: np.ndarray, code: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
    """(rows, d) read-outs of (rows, tokens, d_in + 2) inputs with a mask of real tokens; code is the class shown to the seed token, or -1.
    A tape is given what backward() needs of each block."""
    x = tokens @ weights["token"]
    if code is not None:
        x[:, 0] += np.where((code >= 0)[:, None], weights["codes"][np.maximum(code, 0)], weights["unknown"])
    x = np.concatenate([np.broadcast_to(weights["query"], (len(x), 1, x.shape[2])), x], axis=1)
    mask = np.concatenate([np.ones((len(x), 1), bool), valid], axis=1)
    heads, n, d = weights["heads"], x.shape[1], x.shape[2]
    for b in weights["blocks"]:
        q, k, v = (z.reshape(len(x), n, heads, d // heads).transpose(0, 2, 1, 3) for z in np.split(_norm(x) @ b["qkv"], 3, axis=2))
        a = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
        a = np.where(mask[:, None, None], a, -1e30)
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        a = a / a.sum(axis=-1, keepdims=True)
        mixed = (a @ v).transpose(0, 2, 1, 3).reshape(len(x), n, d)
        middle = x + mixed @ b["out"]
        up = _norm(middle) @ b["up"]
        if tape is not None:
            tape.append((x, q, k, v, a, mixed, middle, up))
        x = middle + _gelu(up) @ b["down"]
    if tape is not None:
        tape.append((tokens, x))
    return _norm(x[:, 0])


def backward(weights: dict, tape: list, grad: np.ndarray) -> dict:
    """The gradients by the weights, in their own layout, of a loss whose gradient by the read-outs is given. Class codes are fixed and have none."""
    flat = lambda z: z.reshape(-1, z.shape[-1])
    joined = lambda z: z.transpose(0, 2, 1, 3).reshape(len(z), z.shape[2], -1)
    *saved, (tokens, last) = tape
    dx = np.zeros_like(last)
    dx[:, 0] = norm_slope(last[:, 0], grad)
    blocks = []
    for b, (x, q, k, v, a, mixed, middle, up) in zip(reversed(weights["blocks"]), reversed(saved), strict=True):
        d_up = (dx @ b["down"].T) * gelu_slope(up)
        d_middle = dx + norm_slope(middle, d_up @ b["up"].T)
        d_mixed = (d_middle @ b["out"].T).reshape(len(x), x.shape[1], weights["heads"], -1).transpose(0, 2, 1, 3)
        d_a = d_mixed @ v.transpose(0, 1, 3, 2)
        d_a = a * (d_a - (d_a * a).sum(axis=-1, keepdims=True)) / math.sqrt(q.shape[-1])
        d_qkv = np.concatenate([joined(d_a @ k), joined(d_a.transpose(0, 1, 3, 2) @ q), joined(a.transpose(0, 1, 3, 2) @ d_mixed)], axis=2)
        blocks.append({"qkv": flat(_norm(x)).T @ flat(d_qkv), "out": flat(mixed).T @ flat(d_middle), "up": flat(_norm(middle)).T @ flat(d_up), "down": flat(_gelu(up)).T @ flat(dx)})
        dx = d_middle + norm_slope(x, d_qkv @ b["qkv"].T)
    return {"token": flat(tokens).T @ flat(dx[:, 1:]), "query": dx[:, 0].sum(axis=0), "blocks": blocks[::-1]}


def random_predictor(d: int, layers: int = 2, widen: int = 2, seed: int = 0) -> dict:
    """NN3b: an untrained head from read-outs to displacements: hidden layers of widen * d, each normed and through GELU."""
    rng, sizes = np.random.default_rng([seed, 1]), [d, *[d * widen] * layers]
    return {"hidden": [rng.standard_normal((a, b)) / math.sqrt(a) for a, b in zip(sizes, sizes[1:])], "out": rng.standard_normal((sizes[-1], d)) / math.sqrt(sizes[-1])}


def predict(head: dict, z: np.ndarray, tape: list | None = None) -> np.ndarray:
    for w in head["hidden"]:
        up = z @ w
        if tape is not None:
            tape.append((z, up))
        z = _gelu(_norm(up))
    if tape is not None:
        tape.append((z, None))
    return z @ head["out"]


def predict_backward(head: dict, tape: list, grad: np.ndarray) -> tuple[dict, np.ndarray]:
    """The gradients by the head's weights and by its input."""
    *saved, (z, _) = tape
    out, dz, hidden = z.T @ grad, grad @ head["out"].T, []
    for w, (x, up) in zip(reversed(head["hidden"]), reversed(saved), strict=True):
        d_up = norm_slope(up, dz * gelu_slope(_norm(up)))
        hidden.append(x.T @ d_up)
        dz = d_up @ w.T
    return {"hidden": hidden[::-1], "out": out}, dz


def arrays(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their mask of gathered sets (seed, partners)."""
    d = len(part["seed"].iloc[0])
    tokens, valid = np.zeros((len(part), k + 1, d + 2)), np.zeros((len(part), k + 1), bool)
    for i, (seed, partners) in enumerate(zip(part["seed"], part["partners"], strict=True)):
        tokens[i, 0, :d], valid[i, 0] = seed, True
        for j, p in enumerate((partners if partners is not None else [])[:k], 1):
            tokens[i, j], valid[i, j] = [*p["x"], p["weight"], p["sign"]], True
    return tokens, valid


def calibrate_codes(weights: dict, seed_tokens: np.ndarray) -> tuple[dict, float]:
    """NN3c: the class codes (and the unknown one) scaled to the mean norm of a seed token, (rows, d_in + 2), so that a label moves the read-out as much as a node's own features do; and that norm."""
    scale = float(np.linalg.norm(seed_tokens @ weights["token"], axis=1).mean())
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12) * scale
    return weights | {"codes": unit(weights["codes"]), "unknown": unit(weights["unknown"])}, scale


def read_out(weights: dict, shown: bool = False):
    """NN3d: a function (tokens, valid, code) -> read-outs: with the class of each row's code shown, or with the unknown class whatever it is."""
    return lambda tokens, valid, code: forward(weights, tokens, valid, code if shown else np.full(len(tokens), -1))


def embed(gathered: DataFrame, weights: dict, k: int, shown: str | None = None, rows: int = 256) -> DataFrame:
    """NN5: (id, embedding) of gathered sets (id, seed, partners of x, weight and sign, shown: a class code or null). A batch's size falls with the square of k."""
    shared = gathered.sparkSession.sparkContext.broadcast(weights)
    size = max(1, min(rows, rows * 64 * 64 // (k * k)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                tokens, valid = arrays(part, k)
                code = part[shown].fillna(-1).to_numpy(int) if shown else None
                yield pd.DataFrame({"id": part["id"].values, "embedding": list(forward(w, tokens, valid, code))})

    return gathered.mapInPandas(run, "id long, embedding array<double>")


def displacement(with_label: DataFrame, without: DataFrame) -> DataFrame:
    """NN4: the read-out with the class shown, less the one with it unknown."""
    from pyspark.sql import functions as F

    other = without.select("id", F.col("embedding").alias("_e"))
    return with_label.join(other, "id").select("id", F.zip_with("embedding", "_e", lambda a, b: a - b).alias("embedding"))
