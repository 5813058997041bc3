import hashlib
import re

from pyspark.sql import functions as F

from graftline.llm.common import table
from graftline.llm.fingerprints import BINS, bin_minima, cut_keys, edited_fingerprints, fingerprint, likeness, neighbours, probe_order, shingle_hashes

SCHEMA = "doc_id long, text string, fingerprint string, slice int, guest int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t or "")
        yield i, n, (t or "")[: n - n // 3] + (after or "")[: n // 3], after or ""


def test_edits_and_likeness_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()] + [(-5, None), (-9, ""), (-7, " \t"), (10**12, "é" * 7), (10**12 + 1, "w " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    text, errors = dict(rows), []
    assert len(got) == len(rows)
    for i, n, edited, after in edits(rows):
        r, t = got[i], text[i] or ""
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= near <= 1 and abs(errors[-1]) < 0.3
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert {len(r.fingerprint) for r in got.values()} == {0, 2 * BINS} and got[-5].fingerprint == ""


def test_few_rows(spark):
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = edited_fingerprints(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c d " + b"a b").hexdigest()
    tied = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (None, None)], "doc_id long, text string")
    assert edited_fingerprints(tied).count() == 4


def test_shared_ids_are_cut_and_keep_their_order(spark):
    """A third of the rows share one id, a third have none: no task holds them all, and each row's next is the one that a plain order names."""
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"text {i} {i * i} of some words {i % 13}") for i in range(900)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h, r.t))
    want = sorted((r.doc_id or -1, r.t, n.t) for r, n in zip(order, order[1:] + order[:1], strict=True))
    found = neighbours(docs, "doc_id", "text")
    assert sorted((r.id or -1, r.text, r.next_text) for r in found.collect()) == want
    cuts, top = cut_keys(docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), 16)
    assert top == (order[0].doc_id, order[0].h) and len(cuts) == 15
    assert sum(c[0] is None for c in cuts) in (4, 5, 6) and sum(c[0] == 7 for c in cuts) in (4, 5, 6)


def test_minima_against_a_loop(spark):
    t = " ".join(f"w{i * i % 97}" for i in range(300))
    (r,) = spark.createDataFrame([(t,)], "t string").select(shingle_hashes(F.col("t")).alias("h"), bin_minima(shingle_hashes(F.col("t"))).alias("m"), fingerprint(F.col("t")).alias("f")).collect()
    assert len(set(r.h)) == len(shingles(t)) and len(r.m) == BINS
    filled = {}
    for h in r.h:
        filled.setdefault(h >> 57, []).append(h & ~1)
    minima = [min(filled[b - 64]) if b - 64 in filled else None for b in range(BINS)]
    assert [v if not v & 1 else None for v in r.m] == minima
    dense = [v if v is not None else next(minima[j] for j in probe_order(b) if minima[j] is not None) for b, v in enumerate(minima)]
    assert r.f == "".join(f"{v >> 1 & 255:02x}" for v in dense)


def test_empty_likeness(spark):
    (r,) = spark.range(1).select(likeness(F.lit(""), F.lit("")).alias("a"), likeness(F.lit(""), F.lit("00" * BINS)).alias("b")).collect()
    assert (r.a, r.b) == (1.0, 0.0)
