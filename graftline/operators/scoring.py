"""Scores of predictions, calibration and rank tests (SCR1-13, AGG12, WIN2). Rows have true and pred, and p where it is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions import arrays as A
from graftline.functions.arrays import floor_bin, right_bin
from graftline.plans.ordered import running_sums
from graftline.plans.storage import stored


def confusion(rows: DataFrame, by: tuple[str, ...] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    """(by, true, pred, n): all scores come from it."""
    return rows.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, class, tp, support, predicted, precision, recall, f1) from a confusion; 0 where a denominator is."""
    hit, none = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0), F.lit(0).cast("long")
    end = lambda c, tp, support, predicted: F.struct(F.col(c).alias("class"), tp.alias("tp"), support.alias("support"), predicted.alias("predicted"))
    ends = F.array(end("true", hit, F.col("n"), none), end("pred", none, none, F.col("n")))
    sums = counts.select(*by, F.inline(ends)).where("class is not null").groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.withColumns({"precision": safe(tp, p), "recall": safe(tp, s), "f1": safe(2 * tp, s + p)})


def score(rows: DataFrame, classes: list | None = None, by: tuple[str, ...] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    """SCR1: macro scores over the probe's classes (absent ones count 0) and over those present; SCR2/3/11/12/13 with classes None: present only."""
    per = class_scores(confusion(rows, by, true, pred), by)
    present = F.col("support") > 0
    listed = F.lit(True) if classes is None else F.col("class").isin(*classes)
    k = F.count_if(present) if classes is None else F.lit(len(classes))
    of = lambda c, where=present: F.sum(F.when(where, F.col(c)).otherwise(0.0))
    n = F.sum("support")
    return per.groupBy(*by).agg(
        n.alias("n"),
        (of("f1", present if classes is None else listed) / k).alias("macro_f1"),
        (of("f1") / F.count_if(present)).alias("macro_f1_present"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        (of("recall", present if classes is None else listed) / k).alias("balanced_accuracy"),
        (of("recall") / F.count_if(present)).alias("balanced_accuracy_present"),
        (F.sum("tp") / n).alias("accuracy"),
        (k - F.count_if(present & listed)).alias("classes_absent"),
    )


def coverage(rows: DataFrame, goals=(0.8, 0.9, 0.95, 0.99), by: tuple[str, ...] = (), p: str = "p", hit: Column | None = None) -> DataFrame:
    """SCR4/SCR5/SCR7: (by, goal, coverage, threshold): the longest run down the confidences whose precision is still the goal.

    Equal confidences stand or fall together, so a running sum is over distinct values of p, of which the histogram is made first.
    """
    right = (F.col("true") == F.col("pred")) if hit is None else hit
    steps = rows.groupBy(*by, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("h"))
    ran = running_sums(steps.where("p IS NOT NULL"), "p", {"rn": "n", "hits": "h"}, by, descending=True)
    tried = ran.withColumn("goal", F.explode(F.array(*map(F.lit, goals))))
    ok = F.col("hits") >= F.col("goal") * F.col("rn") - 1e-12
    return tried.groupBy(*by, "goal").agg(F.coalesce(F.max(F.when(ok, F.col("rn"))) / F.max("rn"), F.lit(0.0)).alias("coverage"), F.min(F.when(ok, F.col("p"))).alias("threshold"))


def coverage_by_row(rows: DataFrame, goals=(0.8, 0.9, 0.95, 0.99), by: tuple[str, ...] = (), p: str = "p", id_: str = "id") -> DataFrame:
    """SCR4 with ties told apart by id, row by row; for tables of predictions that one task may order."""
    run = Window.partitionBy(*by).orderBy(F.desc(p), id_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col("true") == F.col("pred")).cast("double")
    ran = rows.withColumns({"rn": F.row_number().over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "precision": F.avg(hit).over(run)})
    tried = ran.withColumn("goal", F.explode(F.array(*map(F.lit, goals))))
    ok = F.col("precision") >= F.col("goal")
    return tried.groupBy(*by, "goal").agg(F.coalesce(F.max(F.when(ok, F.col("rn"))) / F.max("rn"), F.lit(0.0)).alias("coverage"), F.max_by(p, F.when(ok, F.col("rn"))).alias("threshold"))


def calibration_error(rows: DataFrame, p: str = "p", closed: str = "left", bins: int = 10) -> DataFrame:
    """SCR4 (closed left, the last bin on both sides) and SCR6 (closed right): one row."""
    place = floor_bin(F.col(p), bins) if closed == "left" else right_bin(F.col(p), bins)
    hit = (F.col("true") == F.col("pred")).cast("double")
    binned = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(hit).alias("accuracy"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def triage(rows: DataFrame, goal: float = 0.95, by: str = "pred") -> DataFrame:
    """SCR5: coverage and threshold for each predicted class."""
    return coverage(rows, (goal,), (by,)).drop("goal")


def temperature(rows: DataFrame, log_p: str = "log_p", code: str = "true_code", low: float = 0.05, high: float = 20.0, steps: int = 7, width: int = 17) -> float:
    """SCR8: the temperature of least negative log-likelihood: each aggregate weighs width temperatures, even in logarithm, and the next looks
    between the neighbours of the best, which halves of a loss with one valley allow."""

    def loss(t: float) -> Column:
        z = F.transform(F.col(log_p), lambda x: x / t)
        norm = F.array_max(z) + F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - F.array_max(z))), F.lit(0.0), lambda s, x: s + x))
        return F.avg(norm - F.element_at(z, F.col(code) + 1))

    a, b = math.log(low), math.log(high)
    for _ in range(steps):
        points = [a + (b - a) * i / (width - 1) for i in range(width)]
        losses = rows.agg(*(loss(math.exp(p)).alias(f"l{i}") for i, p in enumerate(points))).first()
        best = min(range(width), key=lambda i: losses[i])
        a, b = points[max(0, best - 1)], points[min(width - 1, best + 1)]
    return math.exp((a + b) / 2)


def calibrated(source: DataFrame, target: DataFrame, bins: int = 10) -> tuple[float, DataFrame]:
    """SCR8 on the target: the temperature fitted on the source's rows (log_p, true_code), and (rows, before, after) of the target: the mean gap of
    confidence and accuracy over equal bins of confidence, weighted by rows, as given and at that temperature."""
    t = temperature(source)
    name = lambda c: F.col(c).cast("string")
    out = None
    for when, heat in (("before", 1.0), ("after", t)):
        p = target.withColumn("_p", A.softmax(F.col("log_p"), heat)).select(name("true_code").alias("true"), A.argmax(F.col("_p")).cast("string").alias("pred"), F.array_max("_p").alias("p"))
        binned = p.groupBy(A.floor_bin(F.col("p"), bins).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg("p").alias("_m"), F.avg((F.col("true") == F.col("pred")).cast("double")).alias("_a"))
        one = binned.agg(F.sum("_n").alias("rows"), (F.sum(F.col("_n") * F.abs(F.col("_m") - F.col("_a"))) / F.sum("_n")).alias(when))
        out = one if out is None else out.join(one, "rows")
    return t, out


def mann_whitney(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """SCR9: (n1, n2, u, p_greater): group true against false, ties averaged, normal approximation with continuity and ties.

    Ranks come from counts by value, whose running sum is over distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    counts = running_sums(counts.withColumn("n", F.col("a") + F.col("b")), "v", {"upto": "n"})
    n = F.col("n")
    ranked = counts.withColumn("rank", F.col("upto") - (n - 1) / 2)
    out = ranked.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(n * n * n - n).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / sd
    return out.select("n1", "n2", u.alias("u"), upper_tail(z).alias("p_greater"))


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail (Abramowitz and Stegun 26.2.17, error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A score table written once, for reports that read it again."""
    return stored(df, name)
