import hashlib
import random
import re
from collections import Counter

from graftline.llm.common import table
from graftline.llm.substring_dedup import WINDOW, factors, substring_dedup

SCHEMA = "doc_id long, text string, doc long, anchor string, id int"


def brute(rows, window=WINDOW):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window=WINDOW):
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, window=window).collect()), key=str)


def test_small_table_and_edges(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "w " * 9_000), (-5, "w " * 34), (-6, "W " * 35), (-7, "q " * 36), (None, "null id " + "k " * 20), (None, rows[0][1]), rows[3]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_random_overlaps_with_short_windows(spark):
    rng = random.Random(2)
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(3, 40))] for k in range(12)]
    rows = []
    for i in range(250):
        w = []
        for _ in range(rng.randrange(1, 7)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, 40)] if rng.random() < 0.7 else [rng.choice("ab") for _ in range(rng.randrange(15))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    for window in (10, 3):
        assert run(spark, rows, window) == brute(rows, window)


def test_null_and_repeated_ids_are_only_carried(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[k % 50 : k % 50 + 60] + [f"own{k}"]) for k in range(300)]
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(str(i) if i else None, t) for i, t in rows], "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()), key=str)
    assert got == sorted(((str(i) if i else None, *x) for i, *x in brute(rows)), key=str)


def test_factors_follow_the_reference():
    assert factors([(0, 2, 100), (2, 3, 102), (5, 1, 900), (7, 1, 902)]) == [[0, 5, 100], [5, 1, 900], [7, 1, 902]]
