import random

import numpy as np
import pytest

from graftline.plans.ordered import percentiles

SHARES = {"least": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0}


@pytest.mark.parametrize("kind", ["few", "many", "hot"])
def test_percentiles_equal_numpy_by_group(spark, kind):
    """Few and many distinct values, one value that is most of the rows; null values and a null group; groups of one row."""
    rng = random.Random(kind)
    value = {"few": lambda: float(rng.randrange(5)), "many": lambda: rng.gauss(0, 100), "hot": lambda: 7.0 if rng.random() < 0.8 else rng.random() * 20}[kind]
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([1, 2]), None if rng.random() < 0.1 else value()) for _ in range(2500)] + [("one", 1, 3.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = {(r.g, r.h): r for r in percentiles(df, "v", SHARES, ("g", "h")).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose([got[k][n] for n in SHARES], np.quantile(v, list(SHARES.values())))
    whole = percentiles(df, "v", SHARES).collect()
    assert len(whole) == 1 and np.allclose([whole[0][n] for n in SHARES], np.quantile([v for _, _, v in rows if v is not None], list(SHARES.values())))


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g int, v double")
    assert percentiles(df, "v", {"m": 0.5}).collect()[0].m is None
    assert percentiles(df, "v", {"m": 0.5}, ("g",)).collect() == []


def test_only_ranges_with_a_wanted_rank_are_put_in_order(spark):
    """The rows that reach the ordering window are a small part of the distinct values."""
    df = spark.range(20000).selectExpr("CAST(id * 7919 % 20011 AS double) AS v")
    out = percentiles(df, "v", {"median": 0.5, "p90": 0.9})
    assert out.collect()[0].median == float(np.median([i * 7919 % 20011 for i in range(20000)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") and "Percentile" not in plan.replace("percentile_approx", "")
