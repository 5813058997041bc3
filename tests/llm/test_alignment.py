import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql.types import LongType, StringType, StructType
from tokenizers import Tokenizer

from graftline.llm import alignment
from graftline.llm.alignment import Aligner, Bits, align, batches
from graftline.llm.queries import op11_token_alignment
from graftline.llm.token_counts import byte_alphabet

SF = "/root/testdata/sf0.001"
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
BYTE = {c: b for b, c in enumerate(byte_alphabet())}
ODD = [None, "", " ", "   ", "a", "  two  spaces ", "tab\t x\n y \n", "<|endoftext|> <s></s> <unk> <0x41>", "with ▁ in it", "▁", "naïve café 日本語 👩‍👩‍👧", "\x1c \x85 \xa0 x", "x" * 3000, "it's  'tis\n\n\n  end", "  wide  space", "don't <|endoftext|>"]


def piece_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(texts):
    """The contract by spans: ends as sets, links by comparing ranges."""
    rows, holds = [], collections.Counter()
    for t in texts:
        a = A.encode(" " + t, add_special_tokens=False).ids if t else []
        b = B.encode(t) if t else []
        ba, bb = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a], [piece_bytes(i) for i in b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            for u in range(i, x):
                for v in range(j, y):
                    if max(ea[u] - len(ba[u]), eb[v] - len(bb[v])) < min(ea[u], eb[v]):
                        links.append((a[u], b[v]))
            i, j = x, y
        holds.update(set(links))
        rows.append((a, b, groups, links))
    most = collections.defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in rows:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(holds[k] == most[k[0]] for k in links), sum(holds[k] for k in links), sha))
    return out


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_bits_count_and_find():
    rng = random.Random(3)
    for n in (1, 63, 64, 65, 500):
        on = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        bits = Bits.of(np.array(on), n)
        assert bits.places().tolist() == on
        assert bits.rank(np.arange(n + 1)).tolist() == [sum(o < k for o in on) for k in range(n + 1)]


def test_query_equals_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs]), strict=True))
    got = op11_token_alignment(spark, SF)
    assert dict(zip([r.doc_id for r in got.collect()], rows(got), strict=True)) == want


def test_odd_texts_in_small_batches(spark, monkeypatch):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é\n\t▁ \xa0'.1 ") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain([t or "" for t in texts])
    got = align(df, *FILES).orderBy("doc_id")
    assert rows(got) == want
    assert [len(t) for _, t in batches(iter(df.limit(40).selectExpr("doc_id AS id", "text").toArrow().to_batches()), 30)] != [40]


def test_whole_texts_where_no_cut_is_known():
    coder = Aligner(*FILES)
    texts = [t for t in ODD if t]
    cut = [alignment.aligned_batch(coder, texts)[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
    sha = alignment.aligned_batch(coder, texts)["groups_sha256"]
    assert coder.cuts
    coder.cuts = False
    whole = alignment.aligned_batch(coder, texts)
    assert [w.tolist() for w in cut] == [whole[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")]
    assert sha == whole["groups_sha256"]


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("batch", StringType()).add("Key", StringType())
    df = spark.createDataFrame([(1, None, "x", "y"), (1, "one two", "x", "y"), (None, "one two", "x", "y"), (2, "one ▁ two", None, None), (1, "one two", None, None)], schema)
    got = sorted(rows(align(df, *FILES)))
    assert got == sorted(plain(["", "one two", "one two", "one ▁ two", "one two"]))
    assert align(df.limit(0), *FILES).collect() == []
    assert rows(align(df.where("text IS NULL OR text LIKE '%▁%'"), *FILES)) == [(0, 0, 0, 0, 0, 0, "")] * 2
