import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece
import zstandard
from test_mixing import brute as mix_brute
from test_mixing import hashed
from test_near_dedup import brute as near_brute

import corpus_pipeline
from graftline.llm.common import table
from graftline.llm.quality import fit

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def gain(raw, model):
    """Bytes saved by the good dictionary, by a compressor of its own, as a signed square root of their share."""
    form = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    size = []
    for known in (model.good, model.bad):
        squeeze = zstandard.ZstdCompressor(compression_params=form, **({"dict_data": zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if known else {}))
        size.append(sum(len(squeeze.compress(raw[i : i + 64])) for i in range(0, len(raw), 64)))
    saved = (size[1] - size[0]) / len(raw) if raw else 0
    return math.copysign(math.sqrt(abs(saved)), saved)


def test_each_stage_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (-3, "ab " * 200_000, "en", "src1", 600_000), (-3, "AB " * 200_000, "en", "src1", 600_000), (None, "One null id here. And the ation.", "en", "srcX", 32)], docs.schema)
    docs = docs.unionByName(odd).withColumn("keep_id", docs.doc_id)
    rows = lambda df: Counter(map(tuple, df.collect()))
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality classifier"](spark, docs, SF)
    model = fit(docs, table(spark, SF, "labels"))
    score = lambda t: 1 / (1 + math.exp(-model.slope * gain((t or "").encode(), model) - model.offset))
    assert good.columns == docs.columns and rows(good) == Counter({r: n for r, n in rows(docs).items() if score(r[1]) >= 0.3})

    exact = stages["exact dedup"](spark, docs, SF)
    best = {}
    for r in rows(docs):
        best[lower(r[1])] = max(best.get(lower(r[1]), -(10**9)), r[0] if r[0] is not None else -(10**8))
    got = rows(exact)
    assert exact.columns == docs.columns and set(got.values()) == {1} and not got - rows(docs)
    assert Counter((lower(r[1]), r[0] if r[0] is not None else -(10**8)) for r in got) == Counter(best.items())

    near = stages["near dedup"](spark, docs.dropDuplicates(["doc_id"]), SF)
    plain = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    kept = {i for i, (_, _, stays) in near_brute([r for r in plain if r[0] is not None]).items() if stays} | {None}
    assert near.columns == docs.columns and Counter(r.doc_id for r in near.collect()) == Counter(kept)

    once = docs.dropDuplicates(["doc_id"])
    mixed = stages["mixing"](spark, once, SF)
    want = {i: taken // n for i, n, taken, _ in mix_brute(hashed(once)) if taken}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(want)

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in once.collect()}
    for r in stages["sentencepiece"](spark, once, SF).collect():
        assert r.ids == sp.encode(text[r.doc_id] or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)


def test_whole_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_columns_with_helper_names_come_through(spark):
    """Columns named like helpers, nulls in any column and repeated rows."""
    docs = table(spark, SF, "documents").limit(60)
    odd = docs.selectExpr("*", "doc_id AS _id", "'x' AS _n", "'y' AS _sha", "'z' AS id", "CAST(NULL AS STRING) AS text_sha256", "1 AS kept", "2 AS taken")
    odd = odd.unionByName(odd.where("doc_id % 7 = 0"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs.unionByName(docs.where("doc_id % 7 = 0")), SF), stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain.collect()), name
        assert {(r._n, r._sha, r.id) for r in got.collect()} <= {("x", "y", "z")}
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
