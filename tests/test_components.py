import random

from compare import connect

from graftline import registry
from graftline.operators.components import components
from graftline.sources.graphs import G1_SQL


def test_against_union_find(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_graph_against_union_find(spark):
    sf, parent = "/root/testdata/sf0.001", {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in connect(sf).execute(f"SELECT pre, post FROM {G1_SQL}").fetchall():
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.component_id for r in registry.QUERIES["agg21_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in parent}
