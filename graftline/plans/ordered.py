"""Running sums over a whole table's order without one task that holds it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.plans.storage import stored


def ranged(df: DataFrame, order: str, out: str = "_range") -> DataFrame:
    """df with the number of its range: ranges are cut at sampled quantiles of a numeric column, a few for each shuffle
    partition. Only the cuts reach the driver. Equal values share a range; null is in the first."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n)).first()[0]
    bounds = F.from_json(F.lit(json.dumps(sorted(set(cuts or [])))), f"array<{dict(df.dtypes)[order]}>")  # one node of the plan
    return df.withColumn(out, F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col(order))), F.lit(0)))


def _starts(placed: DataFrame, sums: dict, by: tuple[str, ...], way) -> DataFrame:
    """placed with, under _<name>, the sum of each aggregate over the ranges before its own."""
    totals = placed.groupBy(*by, "_range").agg(*(c.alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    return placed.join(starts, reduce(lambda a, b: a & placed[b].eqNullSafe(starts[f"_by_{b}"]), by, placed["_range"] == starts["_of"]))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """df with running sums {new column: summed column} up to and with each row, in order of a numeric column whose values are
    distinct within by. Each range is summed by itself and starts at the sum of the ranges before it."""
    way = F.desc if descending else F.asc
    met = _starts(ranged(df, order), {n: F.sum(c) for n, c in sums.items()}, by, way)
    inside = Window.partitionBy(*by, "_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).select(*df.columns, *sums)


def row_numbers(df: DataFrame, order: str, tie: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the row's number, from 1, by a numeric column and then by tie, within by."""
    met = _starts(ranged(df, order), {"n": F.count(F.lit(1))}, by, F.asc)
    inside = Window.partitionBy(*by, "_range").orderBy(order, tie)
    return met.withColumn(out, F.col("_n") + F.row_number().over(inside)).select(*df.columns, out)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., <name>...): exact percentiles of a numeric column, interpolated between ranks, of each group with a value; without
    groups one row, of nulls where there is no value.

    Values are counted, the counts are added up by range, and only in the ranges that hold a wanted rank are values put in order:
    no task holds a column, nor more than a range's distinct values of a group.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    placed = ranged(counts, "_v")
    totals = stored(placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_t")), "range-counts")
    group = Window.partitionBy(*by)  # one row a range
    starts = totals.withColumns({"_before": F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_t").over(group)})
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    ends = lambda q: [F.struct(f(place(q)).cast("long").alias("_rank"), w.alias("_w"), F.lit(name).alias("_q")) for f, w, name in ((F.floor, F.floor(place(q)) + 1 - place(q), q), (F.ceil, place(q) - F.floor(place(q)), q))]
    wanted = starts.select(*by, "_range", "_before", "_t", F.inline(F.array(*(e for q in sorted(set(shares.values())) for e in ends(q)))))
    wanted = stored(wanted.where("_w > 0 AND _rank >= _before AND _rank < _before + _t"), "ranks")
    mine = wanted.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_range").alias("_of"), F.col("_before"))
    same = lambda right: reduce(lambda a, b: a & placed[b].eqNullSafe(right[f"_by_{b}"]), by, placed["_range"] == right["_of"])
    open_ranges = mine.distinct()
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = placed.join(open_ranges, same(open_ranges)).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).select(*by, "_range", "_v", "_n", "_upto")
    ranks = wanted.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_range").alias("_of"), "_rank", "_w", "_q")
    met = held.join(ranks, reduce(lambda a, b: a & held[b].eqNullSafe(ranks[f"_by_{b}"]), by, held["_range"] == ranks["_of"])).where("_rank < _upto AND _rank >= _upto - _n")
    return met.groupBy(*by).agg(*(F.sum(F.when(F.col("_q") == q, F.col("_v") * F.col("_w"))).alias(name) for name, q in shares.items()))
