import math
import zlib

import pytest
import zstandard

from graftline.llm.common import table
from graftline.llm.quality import CompressionClassifier, classify, dictionary, fit, keep_good

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark, SF, "documents"), table(spark, SF, "labels"))


def auc(pairs):
    ranked = sorted(pairs)
    good, total, seen = sum(y for _, y in ranked), 0, 0
    for _, y in ranked:
        total, seen = (total + seen, seen) if y else (total, seen + 1)
    return total / (good * (len(ranked) - good))


def test_held_out_rows_are_told_apart(spark, model):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = classify(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert auc([(r.score, r.quality) for r in held]) > 0.98
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.96
    assert sum(r.predicted for r in held if r.quality) / sum(r.quality for r in held) > 0.99


def test_scores_match_a_plain_version(spark, model):
    """One monotone map of the size difference: sizes by a compressor of its own, order and map held against it."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    form = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def size(raw, known):
        squeeze = zstandard.ZstdCompressor(compression_params=form, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return sum(len(squeeze.compress(raw[i : i + 64])) for i in range(0, len(raw), 64))

    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    gain = {i: (size(t, model.bad) - size(t, model.good)) / len(t) if t else 0.0 for i, t in text.items()}
    want = {i: math.sqrt(g) if g > 0 else -math.sqrt(-g) for i, g in gain.items()}
    got = {r.doc_id: r.score for r in classify(docs, model).collect()}
    assert got.keys() == want.keys() and model.slope > 0
    assert all(math.isclose(math.log(got[i] / (1 - got[i])), min(30, max(-30, model.slope * want[i] + model.offset)), rel_tol=1e-6, abs_tol=1e-6) for i in want)


def test_dictionaries_hold_pieces_of_their_own_texts():
    texts = [f"text {i} " * 400 for i in range(400)]
    known, whole = dictionary(texts), [t.encode() for t in texts]
    assert len(known) == 262_144 and known == dictionary(texts[::-1])
    assert dictionary(["short"]) == b"short" and dictionary([]) == b""
    assert any(known[:200] in w for w in whole)


def test_edge_rows(spark, model):
    rows = [(1, None, 0.0, "a"), (2, "", 0.0, "a"), (3, "a" * 300_000, 0.0, "a"), (3, "a" * 300_000, 0.0, "a"), (None, "The and", 0.0, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, id string")
    got = {(r.doc_id, r.held_out, r.score) for r in classify(docs, model).collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for *_, s in got)
    assert len({s for i, _, s in got if i in (1, 2)}) == 1
    assert classify(docs.limit(0), model).count() == 0
    assert keep_good(docs, model).columns == docs.columns


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(docs, labels).score("anything") == 0.5
    assert CompressionClassifier(b"", b"").calibrate([], []).score("") == 0.5


def test_whole_texts_are_learnt_from(spark, monkeypatch):
    """A bound on bytes takes fewer rows, never a part of a text."""
    texts = {i: f"{i} " * 30_000 for i in range(1, 41)}
    taken = []
    monkeypatch.setattr("graftline.llm.quality.dictionary", lambda ts: taken.extend(ts) or b"")
    monkeypatch.setattr(CompressionClassifier, "calibrate", lambda self, ts, ys: taken.extend(ts) or self)
    docs, labels = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    fit(docs, labels)
    assert sorted(taken) == sorted(t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5)
    whole = len(taken)
    taken.clear()
    fit(docs, labels, fit_bytes=500_000)
    assert 0 < len(taken) < whole and set(taken) <= set(texts.values()) and sum(map(len, taken)) <= 500_000
