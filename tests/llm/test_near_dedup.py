import random
import re

import numpy as np
import pandas as pd

from graftline.llm.common import table
from graftline.llm.near_dedup import ROWS, WIDTH, WordHashes, _unit, near_dedup, shingle_set, signature

SCHEMA = "doc_id long, text string, bucket string, id int, comp int"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    shared = {}
    for ids in holders.values():
        for p, a in enumerate(ids):
            for b in ids[p + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = find(a), find(b)
            comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for k in range(90):  # a large group whose members drift from the base, and one that chains
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(120)] = f"v{k}"
        rows.append((10_000 + k, " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    rows += [(20_000 + k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(40)]
    rows += [(-1, None), (-2, ""), (-3, "\t \n"), (-4, "a b"), (-5, "A  B"), (-6, "a b c"), (-7, "z " * 30_000), (-8, "Z " * 20_000), (-9, "é É")]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect()}
    want = brute(rows)
    assert {i: (want[i], got[i]) for i in want if want[i] != got.get(i)} == {} and len(got) == len(rows)


def test_edges(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup(docs).collect()} == {(4, 4, True), (None, None, True), (9, 4, False)}


def test_buckets_of_many_components(spark, monkeypatch):
    """Many small groups that share most of their words, so that buckets hold many components, in blocks smaller than buckets: no link is lost."""
    monkeypatch.setattr("graftline.llm.near_dedup.BLOCK", 4)
    monkeypatch.setattr("graftline.llm.near_dedup.CHUNK", 8)
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    for g in range(40):  # likeness to the base and so to other groups is about 0.6 to 0.8
        own = list(base)
        for k in range(5):
            own[rng.randrange(200)] = f"g{g}_{k}"
        for _ in range(4):
            w = list(own)
            for k in range(rng.randrange(6)):
                w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) > 5 and {i: (want[i], got[i]) for i in want if want[i] != got[i]} == {}


def test_recall_of_random_pairs(spark):
    """Pairs spread over all likenesses from 0.75 on: each is found."""
    rng, rows = random.Random(5), []
    for g in range(400):
        w = [f"p{g}_{k}" for k in range(150)]
        rows.append((2 * g, " ".join(w)))
        for k in rng.sample(range(5, 145), rng.randrange(0, 4)):
            w[k] = "changed"
        rows.append((2 * g + 1, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, (_, c, _) in brute(rows).items() if i % 2 and c != i]
    assert len(linked) > 300 and [i for i in linked if got[i] != i - 1] == []


def test_texts_of_one_id_are_one_document(spark):
    """An id with two texts has the links of both; reruns agree."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    docs = spark.createDataFrame([(7, one), (7, two), (3, one), (9, two), (9, two), (8, three), (5, three + " more")], "doc_id long, text string")
    for df in (docs, docs.repartition(5)):
        assert sorted((r.doc_id, r.component_id) for r in near_dedup(df).collect()) == [(3, 3), (5, 5), (7, 3), (7, 3), (8, 5), (9, 3), (9, 3)]


def test_signature_estimates_likeness():
    cache, rng, errors = WordHashes(), random.Random(1), []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        a, b = shingle_set(" ".join(words[:300]), cache), shingle_set(" ".join(words[rng.randrange(200) :]), cache)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((signature(a) == signature(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 2 * 0.5 / WIDTH**0.5


def test_only_a_shared_bucket_counts_as_seen():
    """Low bytes agree in the first band, full coordinates do not, so the two have first met in the second."""
    a = np.arange(WIDTH, dtype=np.uint32) * 1000
    b = a.copy()
    b[0] += 256
    words = np.arange(100, dtype=np.uint64).tobytes()

    def unit(band):
        side = lambda i, s, left: {"band": band, "id": i, "n": 100, "sig": s.tobytes(), "low": s.astype(np.uint8).tobytes(), "comp": i, "shingles": words, "left": left}
        return _unit(pd.DataFrame([side(1, a, True), side(2, b, False)])).values.tolist()

    assert (a[:ROWS].astype(np.uint8) == b[:ROWS].astype(np.uint8)).all()
    assert unit(1) == [[1, 2]]
    assert unit(2) == []  # seen in the second band
