import importlib
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from compare import assert_same, connect

import __spark_entry__
from graftline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert_same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", ["fea_z_redundancy", "scl5_effective_rank", "scr8_temperature", "prb2_sweep", "nn1_nn5_untrained_embedding", "prb11_curve_point", "nn6_training_curve", "nn7_target_stats"])
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_pairs_are_added_up_before_they_are_ranked(spark):
    assert "Aggregate" not in registry.QUERIES["top1_partners"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tree_stands_without_the_optional_parts(tmp_path):
    """A copy without the subpackage, its tests and the pipeline, or without one of the two, imports, runs a query and collects its tests."""
    root = importlib.import_module("conftest").ROOT
    code = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= names
"""
    for k, gone in enumerate((("graftline/llm", "tests/llm"), ("graftline/llm", "tests/llm", "corpus_pipeline.py"))):
        copy = tmp_path / str(k)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
        for part in gone:
            (shutil.rmtree if (copy / part).is_dir() else os.remove)(copy / part)
        paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
        env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *paths])}
        for command in (["-c", code], ["-m", "pytest", "tests", "-q", "-k", "test_label or test_entry_has_rows", "-x", "-p", "no:cacheprovider"]):
            done = subprocess.run([sys.executable, *command], cwd=copy, env=env, capture_output=True, text=True)
            assert done.returncode == 0, done.stdout + done.stderr


def test_whole_jobs(spark, duck):
    """All places of the embedding, all languages and both sides, against numpy."""
    vec = np.array(duck.execute("SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id").fetchnumpy()["CAST(embedding AS DOUBLE[])"].tolist())
    ids = [i for (i,) in duck.execute("SELECT vec_id FROM embeddings ORDER BY vec_id").fetchall()]
    run = lambda name: registry.QUERIES[name](spark, SF)
    part = {r.id: r.split for r in registry._vec(spark, SF).collect()}
    train = np.array([part[i] == "train" for i in ids])
    even = np.array([i % 2 == 0 for i in ids])
    for name, fitted, shown in (("scl1_standardise", train, np.ones(len(ids), bool)), ("scl2_transfer", train & even, ~even)):
        want = (vec[shown] - vec[fitted].mean(0)) / np.maximum(vec[fitted].std(0), 1e-6)
        got = sorted(tuple(r) for r in run(name).select("id", *(f"x{i}" for i in range(64))).collect())
        assert np.allclose([g[1:] for g in got], want, atol=1e-5)
    x = (vec - vec.mean(0)) / vec.std(0)
    c, y = vec - vec.mean(0), vec[:, 0] + vec[:, 1]
    b = np.linalg.solve(c.T @ c + 1e-3 * np.trace(c.T @ c) / 64 * np.eye(64), c.T @ (y - y.mean()))
    q = b / np.linalg.norm(b)
    assert np.allclose([r[1:] for r in sorted(map(tuple, run("scl9_null_space").collect()))], c - np.outer(c @ q, q), atol=1e-5)
    p = np.maximum(np.linalg.eigvalsh(np.cov(x.T)), 1e-300)
    p /= p.sum()
    assert abs(run("scl5_effective_rank").first().standardised - np.exp(-(p * np.log(p)).sum())) < 1e-4
    assert run("win3_quintiles").count() == duck.execute(f"SELECT count(*) FROM {registry._PRED}").fetchone()[0]
    assert {r.side for r in run("agg18_composition").select("side").distinct().collect()} == {"in", "out"}
