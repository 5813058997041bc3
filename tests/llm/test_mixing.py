import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graftline.llm.mixing import mix, targets

SCHEMA = "doc_id long, text string, source string, size int, hash string"


def test_targets_cap_and_reshare():
    goal = targets({"a": 10, "b": 100, "c": 100, None: 0})
    assert goal["a"] == 30 and goal[None] == 0
    assert float(goal["b"]) == 120 and float(goal["c"]) == 60
    assert sum(goal.values()) == 210


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 91)), ["b", "a", None, "Z"][min(i % 10, 3)], 0, "x") for i in range(600)] + [(900, None, "a", 0, "x"), (901, "", "only-empty", 0, "x"), (950, "dup", "a", 0, "x"), (950, "dup", "a", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(7)).collect()))
    size = defaultdict(int)
    for i, t, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = targets(dict(size))
    taken, most, source = defaultdict(int), defaultdict(int), {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - float(goal[s])) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        most[s] = max(most[s], 2 * r["size"])
    for s in size:
        assert abs(taken[s] - goal[s]) <= most[s]


def level(sizes, weights):
    """The reshared targets by bisection: all open sources have one level a weight."""
    total, low, high = sum(sizes.values()), 0.0, 1.0 + sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weights[s], 3 * sizes[s]) for s in sizes) < total else (low, mid)
    return {s: min(high * weights[s], 3 * sizes[s]) for s in sizes}


def brute(table):
    """(id, size, taken, target) of (id, source, size, hash) rows: sorted by hash, a source's rows are taken once more while they fit its budget, and the next if that comes nearer."""
    sizes = defaultdict(int)
    for _, s, n, _ in table:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    goal = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    want = []
    for s in sizes:
        whole = int(goal[s] / sizes[s] + 1e-9) if sizes[s] else 0
        budget, spent, more = goal[s] - whole * sizes[s], 0, set()
        for h in sorted({r[3] for r in table if r[1] == s and r[2]}):
            n = sum(r[2] for r in table if r[1] == s and r[3] == h)
            if spent + n > budget + 1e-6:
                more |= {h} if spent + n - budget < budget - spent - 1e-6 else set()
                break
            spent += n
            more.add(h)
        want += [(i, n, n * (whole + (h in more)), goal[s]) for i, t, n, h in table if t == s]
    return want


def hashed(docs):
    """docs as rows for brute."""
    rows = docs.select("doc_id", "source", "text", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 4).alias("h")).collect()
    return [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.h) for r in rows]


def test_taken_rows_match_brute_force(spark):
    """Repeated ids go together."""
    rng = random.Random(8)
    rows = [(rng.randrange(700), " ".join(["w"] * rng.choice([0, 1, 2, 5, 40, 300])), rng.choice(["a", "b", "c", "D", "é", None, "tiny" if rng.random() < 0.05 else "a"]), 0, "x") for _ in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got, want = sorted((r.doc_id, r["size"], r.taken, r.target) for r in mix(docs).collect()), sorted(brute(hashed(docs)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-3 for g, w in zip(got, want, strict=True))


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr("graftline.llm.mixing.MOST_SOURCES", 3)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mix(docs)


def test_no_rows(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
