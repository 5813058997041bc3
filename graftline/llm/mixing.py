"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. A source's budget falls into one bucket; only that bucket is split into finer
ones, until it holds a single hash. The threshold then says per row whether it is taken once more, with no sort of rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.common import WORD, keyed, stored

LEVELS, LEVEL_BITS = 5, 12
HASH_BITS = LEVELS * LEVEL_BITS
#: Sources are a dimension; one row of each reaches the driver, and more than so many are refused.
MOST_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3, share: Fraction = Fraction(1)) -> dict:
    """Source -> target. Sources by code point, null last, weigh the weights in turn; none exceeds most times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        budget -= sum(out[s] for s in full)
        open_ -= full
    return out


def key(source: Column) -> Column:
    """A source as a join key: null is a key of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """One row per input row: id, size (words), source_size, target (of its source), taken (words, repeats counted).

    Every row of a source is taken floor(target / source_size) times, and those whose hash lies under the source's
    threshold once more, so taken is at most most * size and a source's sum misses its target by less than half its
    boundary row. A null or empty text has size 0 and gives nothing; a null source is one source; rows that repeat an id
    have one hash and go together. The hash is of the id and the seed, so reruns agree. No row gives no row.
    Sources are a dimension: one row of each reaches the driver, and nothing else; histograms stay in the executors, one source's in one task. More than MOST_SOURCES
    sources raise an error.
    """
    spark = docs.sparkSession
    slim = keyed(docs, id_col, text_col, source_col).select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), 64 - HASH_BITS).alias("hash"),
    )
    sized = stored(slim, "mix-sizes")
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in totals.collect()}
    goal = targets(sizes, weights, most)
    whole = {s: int(t / sizes[s]) if sizes[s] else 0 for s, t in goal.items()}
    left = {s: goal[s] - whole[s] * sizes[s] for s in goal}
    rows = [(_key(s), sizes[s], float(goal[s]), whole[s]) for s in sizes]
    plan = spark.createDataFrame(rows, "_key string, source_size long, target double, _whole long")
    plan = stored(plan.join(thresholds(sized, {s: v for s, v in left.items() if v > 0}), "_key", "left").na.fill(0, ["_below"]), "mix-plan")
    joined = sized.withColumn("_key", key(F.col("source"))).join(plan, "_key")
    taken = F.col("size") * (F.col("_whole") + (F.col("hash") < F.col("_below")).cast("long"))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def _key(source: str | None) -> str:
    return "null" if source is None else f"s{source}"


def thresholds(sized: DataFrame, budget: dict) -> DataFrame:
    """(_key, _below): for each source the hash below which its rows' words come nearest to its budget (Fractions, below the source's sum)."""
    spark = sized.sparkSession
    # whole numbers that compare as the fractions do: sums with the budget, and twice a sum with twice the budget
    open_ = spark.createDataFrame([(_key(s), 0, 0, floor(b), ceil(2 * b)) for s, b in budget.items()], "_key string, _prefix long, _spent long, _budget long, _twice long")
    words = sized.where("size > 0").withColumn("_key", key(F.col("source")))
    upto = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2**LEVEL_BITS rows at most
    found = None
    for level in range(LEVELS if budget else 0):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = words.join(open_.select("_key", "_prefix"), "_key").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("_prefix"))
        sums = inside.groupBy("_key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        before = (F.col("_spent") + F.sum("size").over(upto) - F.col("size")).alias("before")
        met = sums.join(open_, "_key").select("_key", "bucket", "size", "low", "high", "_budget", "_twice", before)
        edge = stored(met.where((F.col("before") <= F.col("_budget")) & (F.col("before") + F.col("size") > F.col("_budget"))), "mix-level")
        nearer = 2 * F.col("before") + F.col("size") < F.col("_twice")  # one hash: in, if that comes nearer
        done = edge.where("low = high").select("_key", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("_below"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.where("low < high").select("_key", F.col("bucket").alias("_prefix"), F.col("before").alias("_spent"), "_budget", "_twice")
        if open_.isEmpty():
            break
    return spark.createDataFrame([], "_key string, _below long") if found is None else found
