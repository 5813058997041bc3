"""Known answers on toy graphs."""

import numpy as np
import pytest

from graftline.operators import flow
from graftline.operators.clusters import clusters


def graph(spark, pairs, n, w=1):
    return spark.createDataFrame([(a, b, w) for a, b in pairs], "pre long, post long, w long"), spark.range(n)


def levels(df):
    return [r[1] for r in sorted(df.collect())]


@pytest.mark.parametrize(
    "pairs,n,expected",
    [
        ([(0, 1), (1, 2), (2, 3)], 4, [-1.5, -0.5, 0.5, 1.5]),
        ([(0, 1), (1, 2), (2, 0)], 3, [0, 0, 0]),
        ([(0, 2), (0, 3), (1, 2), (1, 3)], 4, [-0.5, -0.5, 0.5, 0.5]),
        ([(0, 1), (1, 2)], 4, [-1, 0, 1, 0]),
    ],
)
def test_trophic_levels(spark, pairs, n, expected):
    edges, nodes = graph(spark, pairs, n)
    level, status = flow.trophic_levels(edges, nodes, "binary")
    assert np.allclose(levels(level), expected, atol=1e-9) and status["converged"]
    assert status["isolated_nodes"] == n - len({x for p in pairs for x in p})
    f = flow.incoherence(edges, level, "binary").first()[0]
    assert abs(f - (1 if pairs[-1][1] == 0 else 0)) < 1e-12


def test_springrank_without_alpha_is_minus_the_trophic_level(spark):
    edges, nodes = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 1)], 4, 3)
    a = levels(flow.springrank(edges, nodes, 0.0)[0])
    b = levels(flow.trophic_levels(edges, nodes, "log1p")[0])
    assert max(abs(x + y) for x, y in zip(a, b, strict=True)) < 1e-9


def test_springrank_solves_its_system(spark):
    rng = np.random.default_rng(4)
    w = rng.integers(0, 4, (12, 12)) * (rng.random((12, 12)) < 0.4)
    edges = spark.createDataFrame([(i, j, int(w[i, j])) for i in range(12) for j in range(12) if w[i, j]], "pre long, post long, w long")
    got = levels(flow.springrank(edges, spark.range(12), 1.0, "raw")[0])
    a = w.astype(float)
    np.fill_diagonal(a, 0)
    lap = np.diag(a.sum(0) + a.sum(1)) - a - a.T
    assert np.allclose(got, np.linalg.solve(lap + np.eye(12), a.sum(1) - a.sum(0)), atol=1e-8)


def test_systems_side_by_side_equal_each_alone_and_a_dense_solve(spark):
    """On two components, a node without edge and a loop; weights of all kinds, all alphas, in one pass."""
    rng = np.random.default_rng(8)
    w = rng.integers(0, 9, (20, 20)) * (rng.random((20, 20)) < 0.3)
    w[:12, 12:] = w[12:, :12] = 0
    w[3, 3] = 4
    edges = spark.createDataFrame([(i, j, int(w[i, j])) for i in range(20) for j in range(20) if w[i, j]], "pre long, post long, w long")
    out, report = flow.flow_block(edges, spark.range(21), rtol=1e-12)
    got = out.toPandas().sort_values("id")
    assert all(r["converged"] and r["isolated_nodes"] == 1 for r in report.values())
    part = np.array(got["component"])
    assert set(part) == {0, 12, 20}
    systems = {f"trophic_{k}": (k, 1, 0) for k in flow.WEIGHTINGS} | {f"springrank_log1p_a{a:g}": ("log1p", -1, a) for a in flow.ALPHAS if a}
    for name, (weighting, sign, alpha) in systems.items():
        a = np.zeros((21, 21))
        a[:20, :20] = {"binary": w > 0, "raw": w, "log1p": np.log1p(w)}[weighting]
        loops = np.diag(a).copy()
        np.fill_diagonal(a, 0)
        lap = np.diag(a.sum(0) + a.sum(1)) - a - a.T
        x = np.linalg.lstsq(lap + alpha * np.eye(21), sign * (a.sum(0) - a.sum(1)), rcond=None)[0]
        if not alpha:
            x = x - np.array([x[part == p].mean() for p in part])
            a += np.diag([*loops])
            f = (a * (x[None] - x[:, None] - 1) ** 2).sum() / a.sum()
            assert abs(report[name]["incoherence"] - f) < 1e-8
        assert np.abs(got[name] - x).max() < 1e-8, name
    alone = levels(flow.springrank(edges, spark.range(21), 0.1, rtol=1e-12)[0])
    assert np.abs(np.array(alone) - got["springrank_log1p_a0.1"]).max() < 1e-8


def test_flow_block_makes_its_edges_once(spark):
    """What the edges come from, joins of whole tables perhaps, runs once, however often the block reads them."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (0, 2, 3)], "pre long, post long, w long").mapInPandas(rows, "pre long, post long, w long")
    flow.flow_block(edges, spark.range(3), maxiter=1)
    assert made.value == 3


def test_parts_tied_by_one_edge_meet_on_clusters(spark, monkeypatch):
    """Cliques in a row: the system on clusters carries what takes Jacobi steps alone 139 iterations. Two rows make two components."""
    monkeypatch.setattr(flow, "MOST_CLUSTERS", 90, raising=False)
    pairs = [(8 * c + a, 8 * c + b) for c in range(60) for a in range(8) for b in range(a)] + [(8 * c, 8 * c + 9) for c in range(59) if c != 30]
    edges, nodes = graph(spark, pairs, 480)
    systems = {"trophic_raw": ("raw", 1, 0.0), "springrank_raw_a1": ("raw", -1, 1.0)}
    out, status = flow.levels(edges, nodes, systems, rtol=1e-12)
    assert all(s["converged"] and s["iterations"] <= 100 for s in status.values()), status
    w = np.zeros((480, 480))
    w[tuple(np.array(pairs).T)] = 1
    got = out.toPandas().sort_values("id")
    for name, (_, sign, alpha) in systems.items():
        x = np.linalg.lstsq(np.diag(w.sum(0) + w.sum(1)) - w - w.T + alpha * np.eye(480), sign * (w.sum(0) - w.sum(1)), rcond=None)[0]
        if not alpha:
            x -= np.repeat([x[:248].mean(), x[248:].mean()], [248, 232])
        assert np.abs(got[name] - x).max() < 1e-8, name


def test_clusters_are_few_and_cover_all_nodes(spark):
    """A path, of which few nodes have a seed beside them, pairs that nothing ties together, and nodes without a pair."""
    path = [(i, i + 1) for i in range(200)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(50)]
    both = spark.createDataFrame([(a, b, 1.0) for p in path for a, b in (p, p[::-1])], "i long, j long, v double")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1100), 5000]], "i long")
    for most in (20, 70):
        found = clusters(both, nodes, most).collect()
        assert len(found) == 302 == len({r.i for r in found}) and {r.c for r in found} == set(range(max(r.c for r in found) + 1))
        assert most / 4 <= len({r.c for r in found}) <= most
    assert any(len({r.c for r in found if r.i in (i, i + 1)}) == 1 for i in range(200))
