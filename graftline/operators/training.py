"""Training the encoder on displacements (NN6, NN7, SNK4c): gradients in numpy inside tasks, added up over the executors; one step of AdamW a batch on the driver.

A frozen random copy of the encoder reads each labelled node twice, with its class shown and with the unknown class; what lies between is the displacement. The trainable encoder
never sees a class; its head learns to foretell the displacement. What passes through the driver is a sum of gradients, as large as the model, never rows.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graftline.operators import encoder
from graftline.operators.splits import hash_share
from graftline.plans.storage import shared_dir, stored

#: A model of more values is refused: its gradient passes through the driver at each step.
MOST_VALUES = 50_000_000
BLOCK = ("qkv", "out", "up", "down")


def leaves(weights: dict, head: dict) -> list[np.ndarray]:
    """The arrays that are trained (or their gradients), always in this order."""
    return [weights["token"], weights["query"], *(b[name] for b in weights["blocks"] for name in BLOCK), *head["hidden"], head["out"]]


def smooth_l1(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1, 0.5 * x * x, np.abs(x) - 0.5)


def moved(target: dict, tokens: np.ndarray, valid: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The read-out with the class unknown, and the displacement to the one with it shown."""
    anchor = encoder.forward(target, tokens, valid, np.full(len(tokens), -1))
    return anchor, encoder.forward(target, tokens, valid, code) - anchor


def loss_and_gradients(weights: dict, head: dict, target: dict, scale: float, tokens: np.ndarray, valid: np.ndarray, code: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The summed loss (mean over places, summed over rows) and its gradients by the leaves."""
    return _towards(weights, head, moved(target, tokens, valid, code)[1] / scale, tokens, valid)


def _towards(weights: dict, head: dict, wanted: np.ndarray, tokens: np.ndarray, valid: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The same of displacements that are known."""
    tape, above = [], []
    z = encoder.forward(weights, tokens, valid, np.full(len(tokens), -1), tape)
    off = encoder.predict(head, z, above) - wanted
    grad_head, dz = encoder.predict_backward(head, above, np.clip(off, -1, 1) / off.shape[1])
    return float(smooth_l1(off).mean(axis=1).sum()), leaves(encoder.backward(weights, tape, dz), grad_head)


def _slices(batches: Iterator[pd.DataFrame], k: int, label: str, rows: int = 64):
    for b in batches:
        for at in range(0, len(b), rows):
            part = b.iloc[at : at + rows]
            yield part, *encoder.arrays(part, k), part[label].to_numpy(int)


def _packed(sets: DataFrame, target: dict, k: int, label: str) -> DataFrame:
    """(id, tokens, valid, anchor, move): each row's input as bytes, its read-out by the frozen target and its displacement, which are made once."""
    shared = sets.sparkSession.sparkContext.broadcast(target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, tokens, valid, code in _slices(batches, k, label):
            u, m = moved(shared.value, tokens, valid, code)
            made = {name: [r.tobytes() for r in rows] for name, rows in (("tokens", tokens), ("valid", valid), ("anchor", u), ("move", m))}
            yield pd.DataFrame({"id": part["id"].to_numpy(), **made})

    return stored(sets.mapInPandas(run, "id long, tokens binary, valid binary, anchor binary, move binary"), "training-rows")


def _rows(column: pd.Series, *shape: int, of: type = float) -> np.ndarray:
    return np.frombuffer(b"".join(column), of).reshape(len(column), *shape)


def _summed(df: DataFrame, run, size: int, few: bool = False) -> tuple[int, np.ndarray]:
    """The sum over the tasks of what run(batches) yields, (least id, rows, vector) at most once, in order of the ids; merged in the executors to one, which reaches the driver.
    few: there are a few tasks whose vectors are small enough to meet in one."""
    schema = "first long, n long, s binary"
    frame = lambda first, n, s: pd.DataFrame({"first": [first], "n": [n], "s": [s.tobytes()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first, n, s in run(batches):
            yield frame(first, n, s)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.first)
        if found:
            yield frame(found[0].first, sum(r.n for r in found), np.sum([np.frombuffer(r.s) for r in found], axis=0))

    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    merged = df.mapInPandas(partial, schema)
    if not few:
        merged = merged.repartition(tasks, "first").mapInPandas(merge, schema)
    found = merged.repartition(1).mapInPandas(merge, schema).first()  # one row a task before: some vectors, in one task
    return (found.n, np.frombuffer(found.s)) if found else (0, np.zeros(size))


def target_stats(sets: DataFrame, target: dict, k: int, label: str = "code") -> dict:
    """NN7: what the class is worth in the frozen encoder, over all rows (id, seed, partners, label): the displacements' size beside the anchors' spread, the loss of who knows
    nothing of classes and says the mean displacement. Two passes of mergeable sums. No row is an error."""
    return _stats(_packed(sets, target, k, label), len(target["query"]))


def _stats(packed: DataFrame, d: int) -> dict:
    def first_pass(batches):
        total, n, least = np.zeros(2 * d + 2), 0, None
        for part in batches:
            if part.empty:
                continue
            u, m = _rows(part["anchor"], d), _rows(part["move"], d)
            total += np.concatenate([u.sum(axis=0), m.sum(axis=0), [(m * m).sum(), np.linalg.norm(m, axis=1).sum()]])
            n, least = n + len(part), min(part["id"].min(), least if least is not None else part["id"].min())
        if n:
            yield least, n, total

    n, sums = _summed(packed, first_pass, 2 * d + 2)
    if not n:
        raise ValueError("target_stats: no labelled row")
    mean_u, mean_m, square = sums[:d] / n, sums[d : 2 * d] / n, sums[2 * d] / (n * d)
    rms = float(np.sqrt(square))
    if rms == 0:
        raise ValueError("target_stats: the class moves no read-out")

    def second_pass(batches):
        total, n, least = np.zeros(3), 0, None
        for part in batches:
            if part.empty:
                continue
            u, m = _rows(part["anchor"], d), _rows(part["move"], d)
            away = u - mean_u
            total += [np.linalg.norm(away, axis=1).sum(), (away * away).sum(), smooth_l1((m - mean_m) / rms).mean(axis=1).sum()]
            n, least = n + len(part), min(part["id"].min(), least if least is not None else part["id"].min())
        if n:
            yield least, n, total

    spread, spread2, constant = _summed(packed, second_pass, 3)[1] / n
    size = float(sums[2 * d + 1] / n)
    return {"rows": n, "constant_predictor_loss": float(constant), "displacement": size, "anchor_spread": float(spread), "ratio": size / float(spread) if spread else None, "class_share": float(square / (square + spread2 / d)), "class_blind_loss": float(0.5 * square), "rms": rms}


def batches_of(sets: DataFrame, steps: int, batch: int, seed: int = 0) -> str:
    """Deals rows to steps and stores them by step; returns the folder. An epoch goes through all rows in the order of a digest of id, seed and epoch, cut in batches of about the
    given size; only as many epochs as the steps need, so at most some steps * batch rows are written (or one epoch's)."""
    spark, n = sets.sparkSession, sets.count()
    if not n:
        raise ValueError("training: no labelled row")
    per_epoch = max(1, round(n / batch))
    epochs = -(-steps // per_epoch)
    dealt = sets.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    dealt = dealt.withColumn("step", (F.col("_epoch") * per_epoch + F.floor(hash_share(F.col("id"), F.lit(seed), F.col("_epoch")) * per_epoch)).cast("int")).where(F.col("step") < steps).drop("_epoch")
    path = f"{shared_dir(spark)}/training-{spark.sql('SELECT uuid()').first()[0]}"
    spread = F.pmod(F.xxhash64("id"), F.lit(8))  # a step's rows lie in eight files and are read by as many tasks
    dealt.repartition("step", spread).write.partitionBy("step").parquet(path)
    return path


def save(spark: SparkSession, path: str, step: int, model: dict) -> None:
    """The state after a step: arrays as rows, whole or not taken: each row says how many there are."""
    flat = [(name, i, a) for name in ("leaves", "first", "second") for i, a in enumerate(model[name])]
    meta = json.dumps({"curve": model["curve"]})
    rows = [(name, i, list(a.shape), bytearray(np.ascontiguousarray(a).tobytes()), len(flat), meta) for name, i, a in flat]
    spark.createDataFrame(rows, "name string, place int, shape array<int>, value binary, number int, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")


def load(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The last whole state, or None."""
    try:
        kept = spark.read.parquet(path)
        whole = kept.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number")).where("n = number").agg(F.max("step")).first()[0]
    except AnalysisException:
        return None
    if whole is None:
        return None
    rows = sorted(kept.where(F.col("step") == whole).collect(), key=lambda r: (r.name, r.place))
    model = {name: [np.frombuffer(bytes(r.value)).reshape(r.shape).copy() for r in rows if r.name == name] for name in ("leaves", "first", "second")}
    return whole, model | {"curve": json.loads(rows[0].meta)["curve"]}


def train(sets: DataFrame, weights: dict, k: int, steps: int, batch: int = 1024, rate: float = 3e-4, decay: float = 0.01, label: str = "code", seed: int = 0, state: str | None = None, save_every: int = 50) -> dict:
    """NN6: {"weights", "head", "curve", "stats"} after a number of steps of AdamW over sets (id, seed, partners, label: a class code).

    The frozen target is the encoder as given, its codes scaled to the seed tokens by the caller (encoder.calibrate_codes). curve: one {"step", "loss"} a step (SNK4c), the loss in units of the
    displacements' root mean square; below stats["constant_predictor_loss"] it has learned classes. state: a folder where the model is saved every so many steps, and from which
    a run that was cut off goes on. Rows without a label are not for training. The same input and layout give the same result.
    """
    spark = sets.sparkSession
    sets = sets.where(F.col(label).isNotNull())
    target, weights, head = copy.deepcopy(weights), copy.deepcopy(weights), encoder.random_predictor(len(weights["query"]), seed=seed)
    params = leaves(weights, head)
    size = sum(a.size for a in params)
    if size > MOST_VALUES:
        raise ValueError(f"a model of {size} values; {MOST_VALUES} at most")
    packed = _packed(sets, target, k, label)
    stats = _stats(packed, len(target["query"]))
    first, second, curve, begin = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], [], 0
    found = load(spark, state) if state else None
    if found:
        begin, model = found
        for mine, kept in zip((params, first, second), (model["leaves"], model["first"], model["second"]), strict=True):
            for a, b in zip(mine, kept, strict=True):
                a[...] = b
        curve = model["curve"]
    path = batches_of(packed.drop("anchor"), steps, batch, seed)
    there = {r.step for r in spark.read.parquet(path).select("step").distinct().collect()}  # a batch of a small table can be empty
    schema, d_in, rms = packed.drop("anchor").schema, len(weights["token"]), stats["rms"]
    for step in range(begin, steps):
        shared = spark.sparkContext.broadcast((weights, head))

        def run(batches, shared=shared):
            w, h = shared.value
            total, n, least = np.zeros(size + 1), 0, None
            for b in batches:
                for at in range(0, len(b), 64):
                    part = b.iloc[at : at + 64]
                    loss, grads = _towards(w, h, _rows(part["move"], len(w["query"])) / rms, _rows(part["tokens"], k + 1, d_in), _rows(part["valid"], k + 1, of=bool))
                    total += np.concatenate([[loss], *(g.ravel() for g in grads)])
                    n, least = n + len(part), min(part["id"].min(), least if least is not None else part["id"].min())
            if n:
                yield least, n, total

        rows = spark.read.schema(schema).parquet(f"{path}/step={step}") if step in there else None  # the folder of the step alone is listed
        n, total = _summed(rows, run, size + 1, few=size < 1 << 20) if rows else (0, None)
        shared.destroy()
        if n:
            grads, at = total[1:] / n, 0
            for a, m, v in zip(params, first, second, strict=True):
                g, at = grads[at : at + a.size].reshape(a.shape), at + a.size
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a *= 1 - rate * decay
                a -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
            curve.append({"step": step, "loss": float(total[0] / n)})
        if state and ((step + 1) % save_every == 0 or step + 1 == steps):
            save(spark, state, step + 1, {"leaves": params, "first": first, "second": second, "curve": curve})
    return {"weights": weights, "head": head, "curve": curve, "stats": stats}


def weights_table(spark: SparkSession, weights: dict, settings: dict) -> DataFrame:
    """SRC11: an encoder as a table: one row an array, with the settings that it was trained with."""
    flat = {name: weights[name] for name in ("token", "query", "codes", "unknown")}
    flat |= {f"{i}.{name}": b[name] for i, b in enumerate(weights["blocks"]) for name in BLOCK}
    meta = json.dumps(settings | {"heads": weights["heads"], "layers": len(weights["blocks"])}, sort_keys=True)
    rows = [(name, list(a.shape), bytearray(np.ascontiguousarray(a, float).tobytes()), meta) for name, a in flat.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, value binary, settings string").coalesce(1)


def read_weights(table: DataFrame) -> tuple[dict, dict]:
    """The encoder of a weights_table and its settings; a table that lacks an array, or has one of another size or name, is an error."""
    rows = table.limit(10_000).collect()  # arrays, a few a layer
    if not rows:
        raise ValueError("no weights")
    settings, found = json.loads(rows[0].settings), {}
    for r in rows:
        a = np.frombuffer(bytes(r.value))
        if a.size != int(np.prod(r.shape)):
            raise ValueError(f"weights {r.name}: {a.size} values for shape {r.shape}")
        found[r.name] = a.reshape(r.shape).copy()
    wanted = {"token", "query", "codes", "unknown", *(f"{i}.{name}" for i in range(settings["layers"]) for name in BLOCK)}
    if set(found) != wanted or len(rows) != len(wanted):
        raise ValueError(f"weights: {sorted(set(found) ^ wanted)} missing, unknown or repeated")
    blocks = [{name: found[f"{i}.{name}"] for name in BLOCK} for i in range(settings["layers"])]
    return {name: found[name] for name in ("token", "query", "codes", "unknown")} | {"blocks": blocks, "heads": settings["heads"]}, settings
