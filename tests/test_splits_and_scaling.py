import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graftline.operators import scaling, slicing, splits


def test_blocked_split_keeps_groups_whole_and_parts_even(spark):
    rows = [(i, f"t{i % 37}" if i % 5 else None, "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, cell_type string, label string")
    got = splits.blocked_split(df, ["label"], "cell_type", 3).toPandas()
    assert len(got) == 1000 and (got.dropna().groupby("cell_type")["split"].nunique() == 1).all()
    assert abs((got["split"] == "train").mean() - 0.7) < 0.03
    again = splits.blocked_split(df.repartition(7), ["label"], "cell_type", 3).toPandas()
    assert dict(zip(got["id"], got["split"], strict=True)) == dict(zip(again["id"], again["split"], strict=True))


def test_samples(spark):
    df = spark.range(5000)
    held, rest, pool = splits.holdout(df, 8, df.where("id < 100"))
    assert held.count() == 1250 and rest.count() == 3750 and rest.join(held, "id").count() == 0
    assert pool.count() == rest.where("id < 100").count()
    shares = splits.random_split(df).groupBy("split_random").count().collect()
    assert {r.split_random for r in shares} == {"train", "val", "test"} and max(r["count"] for r in shares) / 5000 < 0.73


def test_quantile_bins_equal_pandas(spark):
    for n in (1, 2, 5, 6, 13, 59, 101):
        df = spark.createDataFrame([(i, float(i * 7 % n)) for i in range(n)], "id long, v double")
        got = {r.id: r.bin for r in slicing.quantile_bin(df, "v", 5).collect()}
        if n >= 5:
            v = pd.Series([i * 7 % n for i in range(n)]).rank(method="first")
            assert got == dict(enumerate(pd.qcut(v, 5, labels=False) + 1)), n


def test_spectra(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4)) @ np.diag([3, 1, 1, 0.01])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    e = np.linalg.eigvalsh(np.cov(x.T))
    p = e / e.sum()
    m = scaling.collapse_metrics(df, list("abcd"))
    assert abs(m["effective_rank"] - np.exp(-(p * np.log(p)).sum())) < 1e-6 and abs(m["stable_rank"] - e.sum() / e.max()) < 1e-9
    assert m["dead_fraction"] == 0.25 and 0 < m["ratio_to_null"] < 1
    assert scaling.rank_stats(np.zeros(3))["effective_rank"] == 0.0
    point = df.select(*(F.lit(1.0).alias(c) for c in "abcd"))
    assert scaling.collapse_metrics(point, list("abcd"))["effective_rank"] == 0.0


def test_projection_takes_the_target_away(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    df = spark.createDataFrame([(*map(float, r), float(2 * r[0] - r[3])) for r in x], ", ".join(f"x{i} double" for i in range(5)) + ", t double")
    from graftline.operators.features import explained_by

    cols = [f"x{i}" for i in range(5)]
    assert explained_by(df, "t", cols) > 0.999
    assert explained_by(scaling.null_space(df, cols, ["t"], 2), "t", cols) < 0.05


def test_products_of_many_columns_and_tasks(spark):
    """512 columns in many tasks: planned at once, added up in turns, equal to numpy; null counts 0."""
    from graftline.operators.features import gramian

    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 64)).round(3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(23)
    names = [f"x{i}" for i in range(512)]
    wide = df.select("id", *(F.when((F.col("id") != 7) | F.lit(i != 3), F.col("x")[i % 64] * (1 + i // 64)).alias(c) for i, c in enumerate(names)))
    want = np.concatenate([x * (1 + k) for k in range(8)], axis=1)
    want[7, 3] = 0
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        n, s, g = gramian(wide, names)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert n == 700 and np.allclose(s, want.sum(0)) and np.allclose(g, want.T @ want)
    assert gramian(wide.limit(0), names)[0] == 0


def test_null_space_equals_numpy_and_keeps_other_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 6)) + 2
    t = x[:, 0] - 2 * x[:, 4]
    df = spark.createDataFrame([(i, *map(float, r), float(v), "k") for i, (r, v) in enumerate(zip(x, t, strict=True))], "id long, " + ", ".join(f"x{i} double" for i in range(6)) + ", t double, s string")
    cols = [f"x{i}" for i in range(6)]
    got = scaling.null_space(df, cols, ["t"]).orderBy("id").toPandas()
    c, y = x - x.mean(0), t - t.mean()
    b = np.linalg.solve(c.T @ c + 1e-3 * np.trace(c.T @ c) / 6 * np.eye(6), c.T @ y)
    q = b / np.linalg.norm(b)
    assert np.allclose(got[cols].to_numpy(), c - np.outer(c @ q, q)) and set(got["s"]) == {"k"} and np.allclose(got["t"], t)


def test_runs_of_equal_groups_are_dealt_as_one_by_one(spark):
    """The closed form gives each part what the loop gives it, ties included; a stratum of many singletons is dealt by many tasks."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        total, size, n = int(rng.integers(1, 400)), int(rng.integers(1, 9)), int(rng.integers(0, 60))
        held = rng.integers(0, 80, 3)
        wanted, loop = [f * total for f in splits.FRACTIONS], [int(h) for h in held]
        for _ in range(n):
            lacks = [w - h for w, h in zip(wanted, loop, strict=True)]
            loop[lacks.index(max(lacks))] += size
        got = splits.dealt(held[None].astype(np.int64), np.array([wanted]), np.array([size]), np.array([n]))[0]
        assert (held + size * got).tolist() == loop

    sizes = [1] * 3000 + [2] * 500 + [7] * 40 + [300]
    rows, at = [], 0
    for g, k in enumerate(sizes):
        for _ in range(k):
            rows.append((at, None if k == 1 else f"g{g}", "a"))
            at += 1
    nodes = spark.createDataFrame(rows, "id long, grp string, label string")
    got = {r.id: r.split for r in splits.blocked_split(nodes, ["label"], "grp", 3).collect()}
    names, loop = {}, [0, 0, 0]
    for i, g, _ in rows:
        names.setdefault(g or f"__ungrouped_{i}", []).append(i)
    order = sorted(names, key=lambda g: (-len(names[g]), hashlib.md5(f"{g}:3".encode()).hexdigest(), g))
    for g in order:
        lacks = [f * at - h for f, h in zip(splits.FRACTIONS, loop, strict=True)]
        best = lacks.index(max(lacks))
        loop[best] += len(names[g])
        assert {got[i] for i in names[g]} == {splits.PARTS[best]}
    assert len(got) == at
