"""Slices, reports and audits of predictions (QRY1-20, WIN3-8, TOP3-6, AGG7-17, SET1-6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.labels import classified
from graftline.operators.scoring import class_scores, confusion, score
from graftline.plans.ordered import percentiles, row_numbers


def rank_bin(rn: Column, n: Column, bins: int) -> Column:
    """WIN3/WIN4: the bin, from 1, of a row by its rank among n, cut at interpolated quantiles of the ranks."""
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((rn - 1) * bins / (n - 1)))).cast("int")


def quantile_bin(rows: DataFrame, value: str, bins: int, by: tuple[str, ...] = (), id_: str = "id", out: str = "bin") -> DataFrame:
    """WIN3: per group, ranks of a numeric value with ties by id; a null value ranks first."""
    counts = rows.groupBy(*(F.col(b).alias(f"_by_{b}") for b in by)).agg(F.count(F.lit(1)).alias("_n_all"))
    ranked = row_numbers(rows, value, id_, "_rn", by)
    same = reduce(lambda a, b: a & ranked[b].eqNullSafe(counts[f"_by_{b}"]), by, F.lit(True))
    met = ranked.join(counts, same) if by else ranked.crossJoin(F.broadcast(counts))  # one row
    return met.withColumn(out, rank_bin(F.col("_rn"), F.col("_n_all"), bins)).select(*rows.columns, out)


def value_quartile(rows: DataFrame, value: str, out: str = "quartile") -> DataFrame:
    """WIN5: quartiles by value, closed on the right; equal edges leave bins out."""
    q = percentiles(rows, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    place = 1 + sum((F.col(value) > F.col(c)).cast("int") for c in q.columns)
    return rows.crossJoin(F.broadcast(q)).withColumn(out, F.when(F.col(value).isNotNull(), place)).drop(*q.columns)  # one row


def fixed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """WIN6/WIN7: (lo, hi] bins; outside them null."""
    out = F.lit(None).cast("string")
    for lo, hi, name in zip(edges, edges[1:], labels, strict=False):
        out = F.when((value > lo) & (value <= hi), name).otherwise(out)
    return out


def share_of_total(rows: DataFrame, column: str, out: str = "share") -> DataFrame:
    """WIN8/AGG10: the column over its sum."""
    return rows.crossJoin(F.broadcast(rows.agg(F.sum(column).alias("_sum")))).withColumn(out, F.col(column) / F.col("_sum")).drop("_sum")


def shown(column: str, expected: list, counts: DataFrame, row: str) -> DataFrame:
    """AGG12/AGG13: a table of counts by row and the expected values of a column, each over its row's sum, and the sum."""
    cells = [F.sum(F.when(F.col(column) == v, F.col("n")).otherwise(0)).alias(f"{column}_{v}") for v in expected]
    wide = counts.groupBy(row).agg(F.sum("n").alias("n"), *cells)
    return wide.select(row, "n", *((F.col(f"{column}_{v}") / F.col("n")).alias(f"{column}_{v}") for v in expected))


def attach_metadata(pred: DataFrame, nodes: DataFrame, source_types: DataFrame, type_: str = "cell_type") -> DataFrame:
    """QRY1/JOI4: predictions with node metadata, degree, its quintile by target, token bin, and whether the type is in the source."""
    met = pred.join(nodes, "id", "left").join(source_types.select(type_).distinct().withColumn("_in", F.lit(True)), type_, "left")
    degree = F.coalesce(F.col("n_in"), F.lit(0)) + F.coalesce(F.col("n_out"), F.lit(0))
    met = met.withColumns({"degree": degree, "type_in_source": classified(F.col(type_), F.col("_in").isNotNull(), "no type"), "tokens": fixed_bin(degree, [-1, 7, 15, 31, 63, 1e18], ["0-7", "8-15", "16-31", "32-63", "64+"])}).drop("_in")
    return quantile_bin(met, "degree", 5, ("probe_target",), "id", "degree_quintile")


def per_class(rows: DataFrame, place: str = "where") -> DataFrame:
    """QRY2: scores of each class by place (target beside source), with the mean confidence of its predictions."""
    scores = class_scores(confusion(rows, (place,)), (place,))
    mean = rows.groupBy(place, F.col("pred").alias("class")).agg(F.avg("p").alias("mean_p"))
    return scores.join(mean, [place, "class"], "left")


def slices(rows: DataFrame, columns: list[str], floor: int = 30, most: int = 12) -> DataFrame:
    """QRY4/WIN8/TOP3: (slice, value, n, wrong, share_of_errors, accuracy, macro_f1): every slice from one scan, unpivoted to a confusion by
    slice and value; scores where n is at least floor; the most largest values of each slice."""
    pairs = F.array(*(F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = rows.select("true", "pred", F.inline(pairs)).groupBy("slice", "value", "true", "pred").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("value", F.coalesce("value", F.lit("(none)")))
    per = class_scores(counts, ("slice", "value"))
    macro = per.where("support > 0").groupBy("slice", "value").agg(F.avg("f1").alias("macro_f1"))
    sums = counts.groupBy("slice", "value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("true") == F.col("pred"), 0).otherwise(F.col("n"))).alias("wrong"))
    whole = Window.partitionBy("slice")
    ranked = sums.join(macro, ["slice", "value"], "left").withColumns({"share_of_errors": F.try_divide(F.col("wrong"), F.sum("wrong").over(whole)), "_r": F.row_number().over(whole.orderBy(F.desc("n"), "value"))})
    enough = F.col("n") >= floor
    return ranked.where(F.col("_r") <= most).select("slice", "value", "n", "wrong", "share_of_errors", F.when(enough, 1 - F.col("wrong") / F.col("n")).alias("accuracy"), F.when(enough, F.col("macro_f1")).alias("macro_f1"))


def by_type(rows: DataFrame, type_: str, least: int = 10) -> DataFrame:
    """QRY5/AGG7: (type, n, accuracy, wrong, modal_true, modal_pred) of types with enough rows; modes tie to the least."""
    hit = (F.col("true") == F.col("pred")).cast("double")
    return rows.where(F.col(type_).isNotNull()).groupBy(type_).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.count_if(F.col("true") != F.col("pred")).alias("wrong"), F.mode("true", True).alias("modal_true"), F.mode("pred", True).alias("modal_pred")).where(F.col("n") >= least)


def worst(rows: DataFrame, n: int = 20) -> DataFrame:
    """TOP4: the n types with most errors, ties by type."""
    return rows.orderBy(F.desc("wrong"), rows.columns[0]).limit(n)


def changes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """QRY6/AGG11: disagreements by change."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def changed_types(rows: DataFrame, type_: str, a: str, b: str, least: int = 5) -> DataFrame:
    """AGG19: one row: types with enough rows, and how many changed by over 90 % and under 10 %."""
    t = rows.where(F.col(type_).isNotNull()).groupBy(type_).agg(F.avg((~F.col(a).eqNullSafe(F.col(b))).cast("double")).alias("changed"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return t.agg(F.count(F.lit(1)).alias("types"), F.count_if(F.col("changed") > 0.9).alias("mostly"), F.count_if(F.col("changed") < 0.1).alias("hardly"))


def type_agreement(left: DataFrame, right: DataFrame, type_: str, label: str) -> DataFrame:
    """QRY6/JOI6/JOI7: types of both sides by their modal label: how many, and the share that agrees."""
    mode = lambda df, out: df.where(F.col(type_).isNotNull() & F.col(label).isNotNull()).groupBy(type_).agg(F.mode(label, True).alias(out))
    met = mode(left, "l").join(mode(right, "r"), type_)
    return met.agg(F.count(F.lit(1)).alias("types"), F.avg((F.col("l") == F.col("r")).cast("double")).alias("agreement"))


def over_runs(rows: DataFrame, by: str, seed: str = "seed") -> DataFrame:
    """QRY7/QRY13b: macro-F1 of each seed, then mean, least and most of the runs."""
    runs = score(rows, None, (by, seed))
    return runs.groupBy(by).agg(F.avg("macro_f1").alias("mean"), F.min("macro_f1").alias("least"), F.max("macro_f1").alias("most"), F.count(F.lit(1)).alias("runs"))


def commonest_rule(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TOP5/SCR3/QRY13c: the accuracy of always calling a group's commonest class, ties to the least."""
    counts = rows.groupBy(*by, "true").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*by).agg(F.min_by("true", F.struct(-F.col("c"), F.col("true"))).alias("commonest"), (F.max("c") / F.sum("c")).alias("accuracy"))


def seen_unseen(rows: DataFrame, source: DataFrame, type_: str) -> DataFrame:
    """PRJ17/QRY8/QRY15: scores of rows whose type the source has, has not, or that have none."""
    seen = source.where(F.col(type_).isNotNull()).select(type_).distinct().withColumn("_in", F.lit(True))
    met = rows.join(seen, type_, "left").withColumn("group", classified(F.col(type_), F.col("_in").isNotNull()))
    return score(met, None, ("group",)).select("group", "n", "macro_f1", "accuracy")


def matched(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """QRY13: the same rows under two runs: how many both, either or neither called right, and flips each way."""
    met = a.select(*keys, "true", F.col("pred").alias("pa")).join(b.select(*keys, F.col("pred").alias("pb")), list(keys))
    ra, rb = F.col("true") == F.col("pa"), F.col("true") == F.col("pb")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(ra & rb).alias("both"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"), F.count_if(~F.col("pa").eqNullSafe(F.col("pb"))).alias("flips"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """JOI8: rows of a whose values in b are absent or differ, null-safe, numbers by a tolerance."""
    met = a.join(b.select(*keys, *(F.col(v).alias(f"{v}_other") for v in values), F.lit(True).alias("_there")), keys, "left")
    def differs(v: str) -> Column:
        x, y = F.col(v), F.col(f"{v}_other")
        if dict(a.dtypes)[v] in ("double", "float"):
            return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
        return ~x.eqNullSafe(y)
    wrong = F.col("_there").isNull()
    for v in values:
        wrong = wrong | differs(v)
    return met.where(wrong).drop("_there")


def uncovered(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """JOI10/SET4-6: (key, problem): missing, extra or repeated."""
    missing = expected.join(got, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = got.join(expected, key, "left_anti").select(key, F.lit("extra").alias("problem")).distinct()
    twice = got.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def release_table(nodes: DataFrame, pred: DataFrame, targets: dict[str, str], key: str = "id") -> DataFrame:
    """QRY19/JOI3: one row a node, each target's call and confidence side by side; targets: probe target -> column prefix."""
    cells = [c for t, name in targets.items() for c in (F.max(F.when(F.col("probe_target") == t, F.col("pred"))).alias(f"{name}_call"), F.max(F.when(F.col("probe_target") == t, F.col("p"))).alias(f"{name}_p"))]
    wide = pred.groupBy(key).agg(*cells)
    return nodes.join(wide, key, "left").withColumn("scored", F.coalesce(*(F.col(f"{n}_call") for n in targets.values())).isNotNull())


def by_status(pred: DataFrame, status: str = "status", most: int = 5, least: int = 500) -> DataFrame:
    """TOP6/PRB10: scores by the most common statuses that have enough rows."""
    top = pred.where(F.col(status).isNotNull()).groupBy(status).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), status).limit(most).where(F.col("c") >= least)
    return score(pred.join(F.broadcast(top.select(status)), status), None, (status,))


def side_shares(features: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """QRY16/AGG14/AGG15: (by, side, n, median, mean) of the share of single-weight partners, nodes without partner on the side left out."""
    met = features.join(nodes, "id")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"fracW1_{s}").alias("share"), F.col(f"logD{s}@1").alias("d")) for s in ("out", "in")))
    return median_and_mean(met.select(by, F.inline(sides)).where("d > 0"), "share", (by, "side"))


def median_and_mean(rows: DataFrame, value: str, by: tuple[str, ...], **more: Column) -> DataFrame:
    """AGG14: (by, n, median, mean) and further aggregates; a group of nulls has a median of null."""
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *(c.alias(k) for k, c in more.items()))
    middle = percentiles(rows, value, {"median": 0.5}, by).withColumnsRenamed({b: f"_by_{b}" for b in by})
    met = own.join(middle, reduce(lambda a, b: a & own[b].eqNullSafe(middle[f"_by_{b}"]), by, F.lit(True)), "left")
    return met.select(*by, "n", "median", "mean", *more)


def recalls(rows: DataFrame, by: tuple[str, ...], least: int = 200) -> DataFrame:
    """QRY9: (by, n, recall) of groups with enough rows."""
    hit = (F.col("true") == F.col("pred")).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("recall")).where(F.col("n") >= least)


def confident(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """QRY10: (by, n, confident): rows without a label whose call is at least so sure."""
    return rows.where(F.col("true").isNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= threshold).alias("confident"))


def split_composition(rows: DataFrame, split: str, type_: str, label: str) -> DataFrame:
    """QRY14/AGG9/AGG16: (split, n, types, labels) and the types that lie in one part alone."""
    whole = rows.where(F.col(type_).isNotNull()).groupBy(type_).agg(F.count_distinct(split).alias("_parts"), F.first(split, True).alias(split)).where("_parts = 1")
    own = whole.groupBy(split).agg(F.count(F.lit(1)).alias("own_types"))
    parts = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(type_).alias("types"), F.count_distinct(label).alias("labels"))
    return parts.join(own, split, "left").na.fill(0, ["own_types"])


def arms(runs: dict[str, DataFrame], by: tuple[str, ...]) -> DataFrame:
    """QRY7/QRY12/QRY13c: scores of several runs side by side, one row a run and group."""
    out = None
    for name, rows in runs.items():
        one = rows.withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return score(out, None, ("run", *by)).select("run", *by, "n", "macro_f1", "weighted_f1", "accuracy")
