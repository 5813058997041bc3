import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from graftline.llm.pieces import OffsetEncoder, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  spaces ", "Ab\tc\n", "ÉÈ ▁ literal", "x" * 100_000, "日本語 🙂", "\x00a", "same", "same"]


def test_rows_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i // 2, t, "clash", 1) for i, t in enumerate(TEXTS)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string, id int"), MODEL).collect()
    want = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert all(r.covered_bytes == r.n_bytes for r in got)
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_spans_tile_the_source(text):
    coder = _identity()
    ((ids, spans),) = coder.encode([text])
    assert ids.tolist() == coder.source.encode(text, add_bos=True, add_eos=True)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in spans) == raw
    assert coder.decode([ids.tolist()]) == [coder.source.decode(ids.tolist())]


_HELD = {}


def _identity():
    return _HELD.setdefault("identity", OffsetEncoder(MODEL))


def _mapped(tmp_path_factory):
    """The same pieces behind a compiled character map: the library's own NFKC rules with case folding."""
    if "mapped" not in _HELD:
        proto = pb.ModelProto()
        proto.ParseFromString(open(MODEL, "rb").read())
        rules = pb.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
        proto.normalizer_spec.name = "nmt_nfkc_cf"
        proto.normalizer_spec.remove_extra_whitespaces = True
        path = str(tmp_path_factory.mktemp("model") / "mapped.model")
        open(path, "wb").write(proto.SerializeToString())
        _HELD["mapped"] = OffsetEncoder(path)
    return _HELD["mapped"]


@pytest.mark.parametrize("text", ["", "   ", "Ｆｕｌｌ  ＷＩＤＴＨ ", "ﬁne ﬂow ㌔ ½", " A B　C", "é É", "ｶﾞ 한글 🙂", "tab\tnew\nline", "​zero"])
def test_longest_prefix_matches_the_library(tmp_path_factory, text):
    coder = _mapped(tmp_path_factory)
    assert coder.normalise(text)[0] == coder.source.normalize(text)
    ((ids, spans),) = coder.encode([text], begin=False, end=False)
    assert ids.tolist() == coder.source.encode(text)
    assert (np.diff(spans[:, 0]) >= 0).all() and (spans[:, 1] <= len(text.encode())).all()
