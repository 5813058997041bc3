"""Splits, samples and leakage (SPL1-8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.plans.ordered import row_numbers
from graftline.plans.storage import stored

PARTS = ("train", "val", "test")
FRACTIONS = (0.7, 0.15, 0.15)


def draw(*key: Column) -> Column:
    """The order of a draw: the digest of the key's parts as text, the same in any engine."""
    return F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary"))


def hash_share(*key: Column) -> Column:
    """A value from 0 to 1 by the first 32 bits of a key's digest."""
    return F.conv(F.substring(draw(*key), 1, 8), 16, 10).cast("long") / 4294967296.0


def cut(share: Column, fractions=FRACTIONS) -> Column:
    """train, val or test by a value from 0 to 1."""
    return F.when(share < fractions[0], PARTS[0]).when(share < fractions[0] + fractions[1], PARTS[1]).otherwise(PARTS[2])


def random_split(nodes: DataFrame, seed: int = 0, fractions=FRACTIONS) -> DataFrame:
    """SPL1: by the hash of the id and the seed, so that every engine task and rerun agrees."""
    return nodes.withColumn("split_random", cut(hash_share(F.col("id"), F.lit(seed)), fractions))


def modulo_split(key: Column, of: int = 20, train: int = 14, val: int = 17) -> Column:
    """SPL1 by remainder, for tables with even keys."""
    m = F.pmod(key, F.lit(of))
    return F.when(m < train, "train").when(m < val, "val").otherwise("test")


def group_key(group: Column, id_: Column) -> Column:
    """SPL2: a node without a group is a group of its own."""
    return F.coalesce(group.cast("string"), F.concat(F.lit("__ungrouped_"), id_.cast("string")))


def dealt(held: np.ndarray, wanted: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, parts): how many of n groups of one size each part gets, when each goes to the part that lacks most (the first of equals): held and wanted by row and part.

    In closed form: a part's lacks fall by the size with each group it gets, so the j-th of a part is dealt after those of the others that lack more, whose number is known; j is found by halving.
    """
    size, n = size[:, None], n[:, None]
    lack = lambda q, j: wanted[:, q, None] - (held[:, q, None] + j * size)

    def before(p: int, j: np.ndarray) -> np.ndarray:
        at, v = j.copy(), lack(p, j)
        for q in range(held.shape[1]):
            if q == p:
                continue
            more = (lambda c, q=q: lack(q, c) >= v) if q < p else (lambda c, q=q: lack(q, c) > v)
            c = np.maximum(np.floor((lack(q, 0) - v) / size).astype(np.int64), 0)
            for _ in range(2):  # the quotient is rounded
                c = np.where(more(c), c + 1, c)
            for _ in range(2):
                c = np.where((c > 0) & ~more(c - 1), c - 1, c)
            at += c
        return at

    out = []
    for p in range(held.shape[1]):
        low, high = np.zeros_like(n), n.copy()  # the first j that is not among the n
        while (low < high).any():
            middle = (low + high) // 2
            inside = (before(p, middle) < n) & (low < high)
            low, high = np.where(inside, middle + 1, low), np.where(inside, high, np.minimum(high, middle))
        out.append(low)
    return np.concatenate(out, axis=1)


def blocked_split(nodes: DataFrame, stratify_on: list[str], group: str, seed: int = 0, fractions=FRACTIONS) -> DataFrame:
    """SPL3: nodes with a split that keeps each group whole: per stratum, groups by size are dealt to the part that lacks most.

    A group's stratum is its commonest one (least of equals); null is a stratum. Strata are dealt by themselves, which gives the same result as dealing all at once. Groups of one size
    are a run, ordered by digest; one task holds a stratum's runs, as many as it has distinct sizes, and a group's part follows from its number in the run.
    """
    stratum = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("__null")) for c in stratify_on))
    keyed = nodes.withColumns({"_group": group_key(F.col(group), F.col("id")), "_stratum": stratum})
    groups = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("size"), F.mode("_stratum", True).alias("stratum")).withColumn("draw", draw(F.col("_group"), F.lit(seed)))
    groups = stored(groups.withColumns({"place": F.conv(F.substring("draw", 1, 15), 16, 10).cast("long"), "tie": F.struct("draw", "_group")}), "split-groups")

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total, held, out = int((pdf["size"] * pdf["n"]).sum()), np.zeros((1, len(fractions)), np.int64), []
        wanted = np.array([[f * total for f in fractions]])
        for stratum, size, n in pdf[["stratum", "size", "n"]].itertuples(index=False):
            out.append((stratum, size, total, held[0].tolist()))
            held = held + size * dealt(held, wanted, np.array([size]), np.array([n]))
        return pd.DataFrame(out, columns=["stratum", "size", "total", "held"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                held, size, n = np.array(b["held"].tolist(), np.int64), b["size"].to_numpy(np.int64), b["number"].to_numpy(np.int64)
                wanted = np.array(fractions)[None] * b["total"].to_numpy()[:, None]
                got = (dealt(held, wanted, size, n) - dealt(held, wanted, size, n - 1)).argmax(axis=1)
                yield pd.DataFrame({"_group": b["_group"].to_numpy(), "split": [PARTS[p] for p in got]})

    starts = groups.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("stratum").applyInPandas(runs, "stratum string, size long, total long, held array<long>")
    numbered = row_numbers(groups, "place", "tie", "number", ("stratum", "size"))
    split = numbered.join(stored(starts, "split-runs"), ["stratum", "size"]).select("_group", "size", "total", "held", "number").mapInPandas(place, "_group string, split string")
    return keyed.join(split, "_group").drop("_group", "_stratum")


def leak_share(nodes: DataFrame, split: str, column: str, labelled: Column | None = None) -> DataFrame:
    """SPL4: one row: of the (labelled) test rows with a value, how many and the share whose value a train row has."""
    seen = nodes.where((F.col(split) == "train") & F.col(column).isNotNull()).select(column).distinct().withColumn("_seen", F.lit(True))
    test = nodes.where((F.col(split) == "test") & F.col(column).isNotNull())
    test = test if labelled is None else test.where(labelled)
    met = test.join(seen, column, "left")
    return met.agg(F.lit(column).alias("audited"), F.count(F.lit(1)).alias("rows"), F.avg(F.col("_seen").isNotNull().cast("double")).alias("leaked"))


def leak_audit(nodes: DataFrame, split: str, columns: list[str], labelled: Column | None = None) -> DataFrame:
    out = None
    for c in columns:
        one = leak_share(nodes, split, c, labelled)
        out = one if out is None else out.unionByName(one)
    return out


def twin_share(nodes: DataFrame, split: str, type_: str = "cell_type", side: str = "side") -> DataFrame:
    """SPL4: the leak among types with exactly two members, one on the left and one on the right side."""
    sided = nodes.where(F.col(side).isin("left", "right") & F.col(type_).isNotNull())
    pairs = sided.groupBy(type_).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
    return leak_share(sided.join(pairs.select(type_), type_, "left_semi"), split, type_)


def label_coverage(nodes: DataFrame, split: str, target: str) -> DataFrame:
    """SPL5: (split, missing): classes that a part lacks, as sorted text."""
    parts = nodes.select(split).distinct()
    named = nodes.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("_c")).agg(F.collect_set(split).alias("_in"))  # as many as there are parts
    lists = parts.agg(F.collect_set(split).alias("_parts"))
    lacking = named.crossJoin(F.broadcast(lists)).select("_c", F.explode(F.array_except("_parts", "_in")).alias(split))  # one row
    return parts.join(lacking.groupBy(split).agg(F.array_join(F.array_sort(F.collect_list("_c")), ",").alias("missing")), split, "left").na.fill("", ["missing"])


def cohort(nodes: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """SPL6/SPL8: so many rows of smallest hash of id and seed."""
    return nodes.orderBy(draw(F.col("id"), F.lit(seed)), "id").limit(size)


def holdout(seeds: DataFrame, width: int, labelled_train: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SPL7: (holdout, trainable, pool) of one-column frames: min(max(4 width, 2048), n / 4) held, the others, and those labelled in train."""
    n = seeds.count()
    held = cohort(seeds, min(max(4 * width, 2048), n // 4), seed)
    rest = seeds.join(held, "id", "left_anti")
    return held, rest, rest.join(labelled_train, "id", "left_semi")
