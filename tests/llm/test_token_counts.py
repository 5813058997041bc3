import random

import numpy as np
import public_tokenizers as P
from pyspark.sql.types import LongType, StringType, StructType
from tokenizers import Tokenizer

from graftline.llm.queries import op12_token_counts
from graftline.llm.token_counts import RankMerger, batches, byte_alphabet, counter, token_counts

SF = "/root/testdata/sf0.001"
FILE = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
ODD = ["", "  \n", "a" * 5000, "<|endoftext|>x<|startoftext|><|endoftext|>", "A<|ENDOFTEXT|> <|endoftext", "Σίσυφος ΟΔΟΣ", "é ́a", "\x1c\x1d a\x85b\xa0c d", "it's we'll 'S", "日本語テキスト", "½ⅷ12٣", "aaa aaaa aaaaa", "İstanbul ŉ ß"]


def library(texts):
    return [len(e) for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_odd_and_random_texts_have_the_librarys_counts():
    rng = random.Random(1)
    kinds = ((1, 0xD800), (1, 0x250), (32, 127), (0xE000, 0x20000))
    texts = ODD + ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts.append("".join(rng.choice("abcdefghij") for _ in range(20000)))  # one pre-token
    assert counter(FILE).counts(texts).tolist() == library(texts)


def test_every_low_character_in_every_place():
    texts = [f"a{chr(k)}b {chr(k)} {chr(k)}{chr(k)}1{chr(k)}s'{chr(k)}" for k in range(1, 0x3400)]
    assert counter(FILE).counts(texts).tolist() == library(texts)


def merged_one_by_one(word, vocab, merges):
    """Applies the lowest-rank pair, its first place, until there is none."""
    rank = {pair: i for i, pair in enumerate(merges)}
    parts = [*word[:-1], word[-1] + "</w>"]
    while True:
        best = min((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank) if any(p in rank for p in zip(parts, parts[1:], strict=False)) else None
        if best is None:
            return len(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_one_by_one_in_and_out_of_order():
    """Also for merges whose parts are made later, where only the first place of a pair may merge in a round."""
    rng = random.Random(2)
    ordered = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aa"), ("ab", "ab"), ("b", "b</w>"), ("aa", "aa"), ("aaaa", "b</w>")]
    for merges, in_order in ((ordered, True), (ordered[::-1], False)):
        vocab = {t: i for i, t in enumerate([*byte_alphabet(), *(c + "</w>" for c in byte_alphabet()), *dict.fromkeys(a + b for a, b in merges)])}
        merger = RankMerger({"vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"})
        assert merger.ordered == in_order
        words = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 25))) for _ in range(500)]
        assert merger.counts([w.encode() for w in words]).tolist() == [merged_one_by_one(w, vocab, merges) for w in words]
    assert merger.counts([]).tolist() == []


def test_batches_and_memory_of_words_change_nothing(monkeypatch):
    texts = [f"word{i} Other{i % 7}, end." for i in range(300)]
    monkeypatch.setattr("graftline.llm.token_counts.MOST_KNOWN", 50)
    got = np.concatenate([counter(FILE).counts(part) for part in batches(texts, 200)])
    assert got.tolist() == library(texts)


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_token_counts(spark, SF).collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == {k: (len(t.encode()), want[k], want[k] > 2048) for k, t in texts.items()}


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("n_tokens", StringType()).add("ID", StringType())
    df = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", "y"), (None, "one two", "x", "y"), (2, "one two", None, None), (2, "one two", None, None)], schema)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, FILE, limit=1).collect())
    assert got == [(0, 7, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 7, 2, True), (2, 7, 2, True)]
    assert token_counts(df.limit(0), FILE).collect() == []
