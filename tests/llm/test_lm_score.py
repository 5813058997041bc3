import math
from collections import Counter
from itertools import pairwise, product

import numpy as np
import pytest

from graftline.llm.common import table
from graftline.llm.lm_score import fit, pack, pack_sorted, score, unpack, unpack_sorted

SCHEMA = "doc_id long, text string, key long, n int, word string"
ROWS = [(1, "a b a b c"), (2, "A c"), (3, None), (4, ""), (5, "x " * 3_000), (6, "b a"), (6, "b a"), (7, " \n")]
TARGET = {1, 6}


def split(text):
    return ["<s>", *(w.decode() for w in (text or "").encode().lower().split()), "</s>"]  # bytes know ASCII alone


def brute(rows, target, others=None):
    """Losses of others, or of the rows themselves, under models of all rows and of the target's, word by word."""
    vocabulary = {w for _, t in rows for w in split(t)} - {"<s>", "</s>"}
    out = [[] for _ in others or rows]
    for pick in (None, target):
        chosen = [split(t) for i, t in rows if pick is None or i in pick]
        pairs, single = Counter(p for ws in chosen for p in pairwise(ws)), Counter(w for ws in chosen for w in ws)
        size = sum(single.values()) - len(chosen) + len(vocabulary) + 2
        for at, (_, t) in enumerate(others or rows):
            ws, total = split(t), 0.0
            for v, w in pairwise(ws):
                base, prior = (single[w] + 1) / size, single[v] ** 0.75
                total -= math.log((pairs[v, w] + prior * base) / (single[v] + prior) if single[v] else base)
            out[at].append(total / (len(ws) - 1))
    return out


def test_losses_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in ROWS], SCHEMA)
    got = sorted((r.doc_id, r.n_tokens, r.background_loss, r.target_loss, r.score) for r in score(docs, fit(docs, spark.createDataFrame([(i,) for i in TARGET], "doc_id long"))).collect())
    want = sorted((i, len(split(t)) - 1, b, t_, t_ - b) for (i, t), (b, t_) in zip(ROWS, brute(ROWS, TARGET), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])


@pytest.mark.parametrize("words", [50, 1 << 21])
def test_whole_table_matches_brute_force(spark, monkeypatch, words):
    """Default parameters, and many batches and ranges, a document longer than a batch among them."""
    monkeypatch.setattr("graftline.llm.lm_score.BATCH", words)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    if words == 50:
        rows = [(i, (t or "")[:400]) for i, t in rows] + [(-1, "very long " * 300), (None, "no id"), (None, "no id")]
        docs = spark.createDataFrame(rows, docs.schema).repartition(3)
    target = {i for i, _ in rows if i is not None and i % 3 == 0}
    got = {r.doc_id: (r.background_loss, r.target_loss) for r in score(docs, fit(docs, docs.where("doc_id % 3 = 0").select("doc_id"))).collect()}
    want = {i: w for (i, _), w in zip(rows, brute(rows, target), strict=True)}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_numbers_are_packed_without_loss():
    for a in ([], [0], [0, 0], [255, 256, 1 << 63, (1 << 64) - 1], list(range(5000))):
        assert unpack(pack(np.array(a, np.uint64))).tolist() == a
        assert unpack_sorted(pack_sorted(np.array(a, np.uint64))).tolist() == a


def test_distributions_sum_to_one(spark):
    """What may follow a word, over all words, the end sign and one word never seen, by differences of whole losses."""
    rows = [(i, t) for i, t in ROWS if i != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [*sorted({w for _, t in rows for w in split(t)} - {"<s>", "</s>"}), "never"]
    asked = [(k, f"{first} {w}") for k, (first, w) in enumerate(product(words, words))] + [(-k, w) for k, w in enumerate(["", *words], 1)]
    pair = fit(docs, spark.createDataFrame([(i,) for i in TARGET], "doc_id long"))
    got = {r.doc_id: r for r in score(spark.createDataFrame(asked, docs.schema), pair).collect()}
    text = {t: got[k] for k, t in asked}
    for loss in ("target_loss", "background_loss"):
        whole = lambda t, c=loss: math.exp(-text[t][c] * text[t]["n_tokens"])  # noqa: E731  probability of the text and its end
        # P(first) P(end | first) is the text's own; P(first w) leaves P(w | first) P(end | w) in place of P(end | first)
        start = {w: brute_next(rows, "<s>", w, loss) for w in [*words, "</s>"]}
        assert math.isclose(sum(start.values()), 1, rel_tol=1e-9)
        for first in words:
            after = {w: whole(f"{first} {w}") / start[first] / brute_next(rows, w, "</s>", loss) for w in words}
            assert math.isclose(sum(after.values()) + whole(first) / start[first], 1, rel_tol=1e-9)


def brute_next(rows, v, w, loss):
    chosen = [split(t) for i, t in rows if loss == "background_loss" or i in TARGET]
    pairs, single = Counter(p for ws in chosen for p in pairwise(ws)), Counter(w for ws in chosen for w in ws)
    size = sum(single.values()) - len(chosen) + len({w for _, t in rows for w in split(t)})  # all words, the end sign and one never seen
    base, prior = (single[w] + 1) / size, single[v] ** 0.75
    return (pairs[v, w] + prior * base) / (single[v] + prior) if single[v] else base


def test_good_documents_score_lower(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    models = fit(docs, labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id"))
    rows = score(docs, models).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    mean = lambda q: np.mean([r.score for r in rows if r.quality == q])
    assert mean(1) < mean(0)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score(docs, fit(docs, docs.select("doc_id"))).count() == 0


def test_documents_that_the_models_have_not_seen(spark):
    rows = [(i, f"common w{i} w{i + 1} rare{i} common w{i % 7}") for i in range(60)]
    others = [(100, "common w3 never seen w4"), (101, None), (102, "rare5 common w5 rare5")]
    docs, targets = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    got = sorted((r.doc_id, r.background_loss, r.target_loss) for r in score(spark.createDataFrame(others, docs.schema), fit(docs, targets)).collect())
    assert np.allclose([g[1:] for g in got], brute(rows, set(range(0, 60, 3)), others))


def test_whole_corpus_tells_copies_apart(spark):
    """Documents that occur twice are told from ones that occur once, whatever their words' counts."""
    words = lambda k: " ".join(f"w{(k * 7919 + j * 104729) % 100_003}" for j in range(80))
    rows = [(k, words(k % 60)) for k in range(90)]  # 0-29 and 60-89 are pairs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(docs, fit(docs, docs.where("doc_id < 0").select("doc_id"))).collect()}
    assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 60))
