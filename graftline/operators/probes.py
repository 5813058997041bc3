"""Linear and nearest-neighbour probes (PRB1-12, JOI15, JOI16, MTH9): fitted on one data set, applied unchanged to another.

Rows have id, x (array of doubles), label and, where a probe is tuned, split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from graftline.functions import arrays as A
from graftline.operators.scoring import score
from graftline.plans.storage import stored

PENALTIES = (0.01, 0.1, 1.0, 10.0)
NEIGHBOURS = (1, 5, 15, 50)
#: Bytes of vectors that a block of queries, or a part of the reference, holds, and values of distances that a slice of a block holds.
MOST_BYTES, SLICE_VALUES = 16 << 20, 1 << 21
#: Pivots around which a reference lies in cells.
MOST_PIVOTS = 1024
#: Bytes of a model that every executor may hold, and values of probabilities that a batch holds.
MOST_MODEL, BATCH_VALUES = 1 << 28, 1 << 21


def fit_scaler(rows: DataFrame, x: str = "x") -> tuple[list[float], list[float]]:
    """SCL4: mean and population deviation of each place, 0 becoming 1; sums by place, so the arrays are not gathered."""
    places = rows.select(F.posexplode(x)).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    return [float(r.m) for r in places], [float(r.s) or 1.0 for r in places]


def scaled(rows: DataFrame, scaler: tuple[list[float], list[float]], x: str = "x") -> DataFrame:
    mean, sd = (F.array(*map(F.lit, v)) for v in scaler)
    return rows.withColumn(x, F.zip_with(F.zip_with(F.col(x), mean, lambda a, m: a - m), sd, lambda a, s: a / s))


def class_list(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.where("label is not null").select(F.col("label").cast("string").alias("label")).distinct().orderBy("label").collect()]


def class_table(spark: SparkSession, classes: list[str]) -> DataFrame:
    """(code, class): the classes as rows, which labels and codes meet by a join, however many there are."""
    return spark.createDataFrame(pa.table({"code": pa.array(range(len(classes)), pa.int32()), "class": pa.array(classes, pa.string())}))


def coded(rows: DataFrame, classes: list[str], name: str, label: str = "label") -> DataFrame:
    """rows with the place of the label in the classes, from 0; null if it is not one of them."""
    met = class_table(rows.sparkSession, classes).select(F.col("code").alias(name), F.col("class").alias("_class"))
    return rows.join(met, F.col(label).cast("string") == F.col("_class"), "left").drop("_class")


def fit_logistic(rows: DataFrame, classes: list[str], c: float = 1.0, balanced: bool = True):
    """PRB4: multinomial logistic regression with an L2 penalty: the objective 1/2 |B|^2 + c sum of weighted losses."""
    known = coded(rows, classes, "_y").where("_y is not null").withColumn("_y", F.col("_y").cast("double"))
    sizes = stored(known.groupBy("_y").agg(F.count(F.lit(1)).alias("_k")), "class-sizes")
    n, there = sizes.agg(F.sum("_k"), F.count(F.lit(1))).first()
    weight = F.lit(float(n)) / (there * F.col("_k")) if balanced else F.lit(1.0)
    data = known.join(sizes, "_y").select("_y", array_to_vector("x").alias("_x"), weight.alias("_w"))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    model = lr.fit(data)
    coef, intercept = model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray())
    if len(intercept) < len(classes):  # the last classes have no row; their odds are nothing
        coef, intercept = np.vstack([coef, np.zeros((len(classes) - len(coef), coef.shape[1]))]), np.append(intercept, np.full(len(classes) - len(intercept), -np.inf))
    return {"classes": classes, "coef": coef, "intercept": intercept, "iterations": model.summary.totalIterations, "c": c}


def probabilities(rows: DataFrame, probe: dict, x: str = "x") -> DataFrame:
    """PRB9/MTH7: adds proba, from the arrays alone: the model is broadcast, at most MOST_MODEL bytes, and meets the rows as matrix products in Arrow batches."""
    coef, intercept = np.asarray(probe["coef"], dtype=float), np.asarray(probe["intercept"], dtype=float)
    if coef.nbytes > MOST_MODEL:
        raise ValueError(f"a model of {coef.nbytes} bytes; {MOST_MODEL} at most")
    model = rows.sparkSession.sparkContext.broadcast((coef, intercept))
    schema = StructType([*(f for f in rows.schema.fields if f.name != "proba"), StructField("proba", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, intercept = model.value
        most = max(1, BATCH_VALUES // len(intercept))
        for batch in batches:
            for at in range(0, len(batch), most):
                b = batch.slice(at, most)
                vectors = b[x]
                given = np.asarray(vectors.is_valid())
                z = np.asarray(vectors.flatten(), dtype=float).reshape(int(given.sum()), -1) @ coef.T + intercept if given.any() else np.zeros((0, len(intercept)))
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(given * len(intercept))]).astype(np.int32), mask=np.append(~given, False))
                proba = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([proba if f.name == "proba" else b[f.name] for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)


def prediction_rows(rows: DataFrame, classes: list[str], p: str = "proba") -> DataFrame:
    """PRB8/MTH4-6: pred, p, p_true (null for a class that is not known), margin and entropy."""
    names = class_table(rows.sparkSession, classes).select(F.col("code").alias("_best"), F.col("class").alias("pred"))
    met = coded(rows, classes, "_true").withColumn("_best", A.argmax(F.col(p))).join(names, "_best", "left")
    return met.withColumns({"p": F.array_max(p), "p_true": F.get(F.col(p), F.col("_true")), "margin": A.margin(F.col(p)), "entropy": A.entropy(F.col(p))}).drop("_true", "_best")


def _matrix(x: pa.Array, metric: str) -> np.ndarray:
    """Arrays of doubles as a matrix, from their Arrow values."""
    m = np.asarray(x.flatten(), dtype=float).reshape(len(x), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" else m


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


class Cells:
    """The reference (id, x, label, cell, part), stored: each row in the cell of its nearest pivot, a reference row; cells in parts of bounded size, small ones
    together and large ones cut; and, for each cell, how many rows it has and how far from its pivot the last one is.

    Cosine distance orders unit vectors as their distance does; a zero vector, to which that does not apply, lies in a last cell that all queries meet.
    """

    def __init__(self, reference: DataFrame, metric: str):
        self.metric = metric
        n, width = reference.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        self.row_bytes = 8 * (width or 1)
        count = max(1, min(MOST_PIVOTS, max(-(-n * self.row_bytes // MOST_BYTES), math.isqrt(n) // 2)))
        pivots = reference.select("x").orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
        self.pivots = _matrix(pivots["x"].combine_chunks(), metric) if len(pivots) else np.zeros((1, width or 1))
        last, pivots = len(self.pivots), self.pivots
        fields = reference.select("id", "x", F.col("label").cast("string").alias("label"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 4096):
                    part = b.slice(at, 4096)
                    x = _matrix(part["x"], metric)
                    d = _distances(x, pivots)
                    cell = d.argmin(axis=1)
                    r = d[np.arange(len(x)), cell]
                    if metric == "cosine":
                        cell = np.where((x * x).sum(axis=1) < 0.5, last, cell)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(r)], names=[*part.schema.names, "cell", "r"])

        self.rows = stored(fields.mapInArrow(place, f"id {fields.schema['id'].dataType.simpleString()}, x array<double>, label string, cell int, r double"), "cells")
        found = {r.cell: (r.n, r.r) for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()}
        self.size = np.array([found.get(c, (0, 0.0))[0] for c in range(last + 1)])
        self.radius = np.array([found.get(c, (0, 0.0))[1] for c in range(last)] + [np.inf])
        pieces = np.maximum(1, -(-self.size * self.row_bytes // MOST_BYTES))
        # cells near each other come one after the other, so that a query needs few parts; a cell that fills one has its own
        order = [*np.argsort(_distances(self.pivots, self.pivots[:1])[:, 0], kind="stable").tolist(), last]
        self.first, number, filled = np.zeros(last + 1, int), -1, math.inf
        for c in order:
            share = self.size[c] * self.row_bytes
            if pieces[c] > 1 or filled + share > MOST_BYTES:
                number, filled = number + 1, 0
            self.first[c], filled = number, filled + share
            if pieces[c] > 1:
                number, filled = number + int(pieces[c]) - 1, math.inf
        self.pieces, self.parts = pieces, number + 1
        first, pieces = (F.array(*(F.lit(int(p)) for p in a))[F.col("cell")] for a in (self.first, pieces))
        self.rows = self.rows.withColumn("part", (first + F.pmod(F.xxhash64("id", F.lit(1)), pieces.cast("long"))).cast("int")).drop("r")

    def needed(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query and cell, whether the cell can hold one of the k nearest: by the triangle inequality no row of it is nearer than the
        pivot less the radius, while k rows are no farther than some pivots plus their radius."""
        if not self.size.any():
            return np.zeros((len(x), len(self.size)), bool)
        d = np.hstack([_distances(x, self.pivots), np.zeros((len(x), 1))])
        far = np.where(self.size > 0, d + self.radius, np.inf)
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(self.size[order], axis=1) >= k).argmax(axis=1)
        bound = np.take_along_axis(far, order, axis=1)[np.arange(len(x)), enough]
        bound[self.size.sum() < k] = np.inf
        if self.metric == "cosine":
            bound[(x * x).sum(axis=1) < 0.5] = np.inf
        return (d - self.radius <= bound[:, None] + 1e-7 * (1 + np.abs(d))) & (self.size > 0)

    def needed_parts(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query and part, whether it has rows of a needed cell."""
        out = np.zeros((len(x), self.parts), bool)
        for c, need in enumerate(self.needed(x, k).T):
            out[need, self.first[c] : self.first[c] + self.pieces[c]] = True
        return out


def met_share(queries: DataFrame, reference: DataFrame, k: int, metric: str = "euclidean") -> float:
    """JOI15: the share of all pairs of a query and a reference row that neighbours() looks at."""
    cells = Cells(reference, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                x = _matrix(b["x"].slice(at, 1024), metric)
                met = (cells.needed(x, k) * cells.size).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.full(len(x), cells.size.sum()))], names=["met", "of"])

    cells.rows, rows = None, queries.select("x")  # the function takes no table along
    met, of = rows.mapInArrow(run, "met long, of long").agg(F.sum("met"), F.sum("of")).first()
    return met / of if of else 0.0


def neighbours(queries: DataFrame, reference: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """JOI15/JOI16/TOP7: (id, rank from 1, neighbour, label, distance) of each query's k nearest, ties by id.

    The reference lies in cells around pivots, cells in parts, and a query goes only to parts with a cell that can hold one of its nearest, so what moves is
    a copy of the query for each such part, and of a part for each block of queries. A block meets a part in a task of its own, as matrix products with the
    needed cells, in slices; both are of MOST_BYTES and come as Arrow, so a task holds the same however many rows there are. The best of all are merged by
    rank. Pivots, of which there are at most MOST_PIVOTS, and cell sizes are all that reaches the driver.
    """
    cells = Cells(reference, metric)
    tasks, m = queries.sparkSession.sparkContext.defaultParallelism, queries.count()
    blocks = max(1, -(-m * cells.row_bytes // MOST_BYTES), min(tasks, m // 256))
    right = cells.rows.select("id", "x", "label", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    cells.rows = None  # the function takes no table along

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                for number, need in enumerate(cells.needed_parts(_matrix(part["x"], metric), k).T):
                    if need.any():
                        sent = part.filter(pa.array(need))
                        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.full(len(sent), number, np.int32))], names=[*sent.schema.names, "part"])

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = {"id": [], "neighbour": [], "label": [], "distance": []}
        if len(q) and len(r):
            r = r.take(np.argsort(r["cell"].to_numpy(), kind="stable"))
            ids, m = r["id"].to_numpy(), _matrix(r["x"].combine_chunks(), metric)
            cell, begin = np.unique(r["cell"].to_numpy(), return_index=True)
            spans = list(zip(cell, begin, [*begin[1:], len(ids)], strict=True))
            squares = (m * m).sum(axis=1)
            vectors, most = q["x"].combine_chunks(), max(1, min(256, SLICE_VALUES // len(ids)))
            asked, last = q["id"].to_numpy(), min(k, len(ids)) - 1
            for at in range(0, len(q), most):
                x = _matrix(vectors.slice(at, most), metric)
                need, d = cells.needed(x, k), np.full((len(x), len(ids)), np.inf)
                for c, a, z in spans:
                    rows = np.flatnonzero(need[:, c])
                    if len(rows):
                        v = x[rows]
                        d[rows, a:z] = 1 - v @ m[a:z].T if metric == "cosine" else np.maximum((v * v).sum(axis=1)[:, None] + squares[a:z] - 2 * v @ m[a:z].T, 0)
                for query, row, v in zip(asked[at : at + most], d, x, strict=True):
                    near = np.flatnonzero((row <= np.partition(row, last)[last] + 1e-9) & (row < np.inf))
                    exact = 1 - m[near] @ v if metric == "cosine" else np.sqrt(((m[near] - v) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], exact))[:k]
                    out["id"].append(np.full(len(best), query))
                    out["neighbour"].append(near[best])
                    out["distance"].append(exact[best])
        spot = np.concatenate(out["neighbour"]) if out["neighbour"] else np.zeros(0, int)
        flat = lambda name, kind: np.concatenate(out[name]) if out[name] else np.zeros(0, kind)
        label = r["label"].take(pa.array(spot)).cast(pa.string()) if len(spot) else pa.array([], pa.string())
        return pa.table({"id": pa.array(flat("id", np.int64), pa.int64()), "neighbour": pa.array(r["id"].to_numpy()[spot] if len(spot) else spot, pa.int64()), "label": label, "distance": pa.array(flat("distance", float))})

    asked = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    left = asked.mapInArrow(send, f"id {asked.schema['id'].dataType.simpleString()}, x array<double>, block int, part int")
    keys = ["part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "id long, neighbour long, label string, distance double")
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(near: DataFrame, k: int) -> DataFrame:
    """PRB6: (id, pred_knn, knn_share): the commonest label of the first k, ties to the least."""
    counts = near.where(F.col("rank") <= k).groupBy("id", "label").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("id").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("pred_knn"), (F.max("c") / F.sum("c")).alias("knn_share"))


def class_votes(near: DataFrame, k: int) -> DataFrame:
    """PRB8: (id, label, share) of the first k."""
    return near.where(F.col("rank") <= k).groupBy("id", "label").agg((F.count(F.lit(1)) / k).alias("share"))


def baselines(train: DataFrame, test: DataFrame) -> DataFrame:
    """PRB7: one row: the accuracy of the commonest train class, and the expected accuracy of drawing from the train classes."""
    counts = stored(train.groupBy("label").agg(F.count(F.lit(1)).alias("c")), "class-counts")
    total = counts.agg(F.sum("c").alias("s"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("majority"))
    met = test.groupBy("label").agg(F.count(F.lit(1)).alias("t")).join(counts, "label", "left").crossJoin(F.broadcast(total))  # one row
    n, hits = F.sum("t"), F.sum(F.when(F.col("label") == F.col("majority"), F.col("t")).otherwise(0))
    return met.agg((hits / n).alias("majority_accuracy"), (F.sum(F.col("t") * F.coalesce(F.col("c") / F.col("s"), F.lit(0.0))) / n).alias("prior_accuracy"))


def _macro(rows: DataFrame, classes: list[str], pred: str = "pred") -> float:
    return score(rows.select(F.col("label").cast("string").alias("true"), F.col(pred).alias("pred")), classes).first()["macro_f1"]


def tune(train: DataFrame, val: DataFrame, classes: list[str], balanced: bool = True, penalties=PENALTIES, ks=NEIGHBOURS) -> tuple[dict, int]:
    """PRB5: the penalty and k of highest macro-F1 on val; only a strict gain moves on, so the smallest wins."""
    best, chosen = -1.0, None
    for c in penalties:
        probe = fit_logistic(train, classes, c, balanced)
        f1 = _macro(prediction_rows(probabilities(val, probe), classes), classes)
        if f1 > best:
            best, chosen = f1, probe
    n = train.count()
    usable = [k for k in ks if k < n] or [max(1, n - 1)]
    near = stored(neighbours(val, train, max(usable)), "neighbours")
    best, k_best = -1.0, usable[0]
    for k in usable:
        f1 = _macro(val.join(vote(near, k), "id"), classes, "pred_knn")
        if f1 > best:
            best, k_best = f1, k
    return chosen, k_best


def transfer(source: DataFrame, target: DataFrame, balanced: bool = True, penalties=PENALTIES, ks=NEIGHBOURS) -> tuple[DataFrame, dict]:
    """PRB3: everything is fitted on the source's train rows and tuned on its val rows, then applied to its test rows and to the target.

    Target rows of classes that the source's train rows lack are left out; those without a label are kept as target_unlabelled. Source val and
    test rows are not filtered. Fewer than two classes: skipped; an empty part: error.
    """
    train, val, test = (source.where((F.col("split") == s) & F.col("label").isNotNull()) for s in ("train", "val", "test"))
    classes = class_list(train)
    if len(classes) < 2:
        return None, {"skipped": f"{len(classes)} classes"}
    if val.isEmpty() or test.isEmpty():
        return None, {"error": "an empty part"}
    scaler = fit_scaler(train)
    train, val = stored(scaled(train, scaler), "probe-train"), stored(scaled(val, scaler), "probe-val")
    probe, k = tune(train, val, classes, balanced, penalties, ks)
    known = F.col("label").isNull() | F.col("label").cast("string").isin(*classes)
    place = F.when(F.col("label").isNull(), "target_unlabelled").otherwise("target")
    columns = ["id", "x", "label"]
    rows = test.select(*columns, F.lit("source_test").alias("where")).unionByName(target.where(known).select(*columns, place.alias("where")))
    rows = stored(scaled(rows, scaler), "probe-rows")
    called = prediction_rows(probabilities(rows, probe), classes)
    parts = []
    for name, of in (("source", "where = 'source_test'"), ("target", "where <> 'source_test'")):
        q = rows.where(of.replace("where ", "`where` "))
        parts.append(vote(neighbours(q, train, k), k).withColumn("_of", F.lit(name)))
    votes = parts[0].unionByName(parts[1])
    out = called.withColumn("_of", F.when(F.col("where") == "source_test", "source").otherwise("target")).join(votes, ["id", "_of"], "left").drop("_of")
    out = stored(out.withColumnRenamed("label", "true").withColumn("true", F.col("true").cast("string")).drop("x"), "predictions")
    report = {"classes": classes, "c": probe["c"], "k": k, "iterations": probe["iterations"]}
    for place_, name in (("source_test", "source_macro_f1"), ("target", "target_macro_f1")):
        part = out.where(F.col("where") == place_)
        report[name] = score(part, classes).first()["macro_f1"]
        report[f"{name}_knn"] = score(part.withColumn("pred", F.col("pred_knn")), classes).first()["macro_f1"]
    return out, report | {"probe": probe, "scaler": scaler}


def in_volume(rows: DataFrame, **how) -> tuple[DataFrame, dict]:
    """PRB1: fitted, tuned and tested within one data set; rows of classes that train lacks are left out of val and test, and counted."""
    train = rows.where("split = 'train' and label is not null")
    classes = class_list(train)
    usable = F.col("label").cast("string").isin(*classes) if classes else F.lit(False)
    lost = rows.where("split <> 'train' and label is not null").where(~usable).count()
    kept = rows.where((F.col("split") == "train") | usable)
    out, report = transfer(kept, kept.limit(0), **how)
    return out, report | {"rows_of_unknown_class": lost}


def sweep(rows: DataFrame, targets: list[str], scopes: dict[str, Column], **how) -> dict:
    """PRB2: in_volume for each target column and scope."""
    return {(t, name): in_volume(rows.where(mask).withColumn("label", F.col(t)), **how)[1] for t in targets for name, mask in scopes.items()}


def curve_point(rows: DataFrame, most: int = 15) -> dict:
    """PRB11: one cheap reading of a run: macro-F1 on val of a linear probe with penalty 1 and of a vote among min(most, n - 1) neighbours, both fitted on train."""
    train, val = (rows.where((F.col("split") == s) & F.col("label").isNotNull()) for s in ("train", "val"))
    classes, scaler, k = class_list(train), fit_scaler(train), min(most, train.count() - 1)
    train, val = stored(scaled(train, scaler), "curve-train"), stored(scaled(val, scaler), "curve-val")
    linear = prediction_rows(probabilities(val, fit_logistic(train, classes, 1.0)), classes)
    return {"linear": _macro(linear, classes), "knn": _macro(val.join(vote(neighbours(val, train, k), k), "id"), classes, "pred_knn"), "k": k}


def bundle(report: dict, reference: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """PRB9/SNK5: a probe as one row of arrays, and its nearest-neighbour reference as rows (id, code); apply it with apply_bundle() and neighbours() alone."""
    p, (mean, sd) = report["probe"], report["scaler"]
    row = (p["classes"], mean, sd, [float(v) for v in p["coef"].ravel()], [float(v) for v in p["intercept"]], report["k"])
    kept = spark.createDataFrame([row], "classes array<string>, scaler_mean array<double>, scaler_scale array<double>, linear_coef array<double>, linear_intercept array<double>, k int")
    return kept, coded(reference, p["classes"], "code").select("id", "code")


def apply_bundle(bundle_row, rows: DataFrame) -> DataFrame:
    """PRB9: prediction rows of a stored probe."""
    classes = list(bundle_row.classes)
    coef = np.array(bundle_row.linear_coef).reshape(len(classes), -1)
    probe = {"coef": coef, "intercept": bundle_row.linear_intercept}
    return prediction_rows(probabilities(scaled(rows, (bundle_row.scaler_mean, bundle_row.scaler_scale)), probe), classes)


def same_label_share(near: DataFrame, rows: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """QRY11/JOI16: the share of rows whose nearest neighbour has their label."""
    own = rows.select("id", F.col(label).cast("string").alias("_own"), *([by] if by else []))
    met = near.where("rank = 1").join(own, "id")
    return met.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("_own")).cast("double")).alias("same_share"))
