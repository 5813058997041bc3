"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary (every word of all documents), every bigram and one smoothing: a bigram's
probability is (count + m * base) / (count of its first word + m), base being the smoothed share of its second word and m the first word's count
to the power HEAPS, about as many kinds of followers as Heaps' law expects. A document's score is its loss per token under the target model
less that under the background model: the lower, the more it reads like the target.

Nothing is cut off and no model is ever in one place. Documents are packed in batches. A batch asks once for each word and bigram that it has, in one exchange by ranges of their
hashes; each range adds up what all batches have of it and answers each batch. So a word that every document has costs one number a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import keyed, stored
from graftline.llm.exact_dedup import probe
from graftline.llm.near_dedup import WordHashes, _mix

#: Words of a batch, or one document; words of a hash range, and the bits of a hash that tell ranges apart at least.
BATCH, RANGE_WORDS, RANGE_BITS = 1 << 20, 1 << 20, 7
#: Prior weight of a word's followers: its count to this power.
HEAPS = 0.75
#: What a batch's words are counted for.
NOTHING, BACKGROUND, TARGET = 0, 1, 2
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as their byte planes, zeros left out, compressed."""
    flat = np.ascontiguousarray(numbers, np.uint64)
    width = int(flat.max()).bit_length() // 8 + 1 if len(flat) else 0
    planes = flat.view(np.uint8).reshape(-1, 8)[:, : min(width, 8)].T
    return bytes([min(width, 8)]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    if not width:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def batches(docs: DataFrame, counted: int) -> DataFrame:
    """docs (id, text) in rows (batch, counted, n_docs, n_words, ids, lengths, words, tokens): the distinct words' sorted hashes, and of each token its word's place."""

    def row(ids: list, hashes: list, batch: int) -> pd.DataFrame:
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        lengths = [len(h) for h in hashes]
        made = {"n_docs": len(ids), "n_words": len(tokens), "lengths": pack(np.array(lengths)), "words": pack_sorted(words), "tokens": pack(tokens)}
        return pd.DataFrame([{"batch": batch, "counted": counted, "ids": ids} | made])[["batch", "counted", "n_docs", "n_words", "ids", "lengths", "words", "tokens"]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, ids, hashes, size = WordHashes(), [], [], 0
        batch = (counted << 56) + (TaskContext.get().partitionId() << 32)
        for p in parts:
            for i, text in zip(p["id"].tolist(), p["text"].tolist(), strict=True):
                words = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(i)
                hashes.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                size += len(words)
                if size >= BATCH or len(ids) >= BATCH:
                    yield row(ids, hashes, batch)
                    batch, ids, hashes, size = batch + 1, [], [], 0
        if ids:
            yield row(ids, hashes, batch)

    kind = docs.schema["id"].dataType.simpleString()
    asked = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.col("id").cast("string"))  # as text, so that a null stays one
    made = asked.mapInPandas(run, "batch long, counted int, n_docs long, n_words long, ids array<string>, lengths binary, words binary, tokens binary")
    return made.withColumn("ids", F.col("ids").cast(f"array<{kind}>"))


def _bigrams(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the first word, place of the second, first bigram of each document) of all bigrams; len(words) is the place of a document's start and end."""
    n, edge = lengths + 1, len(words)
    starts = np.cumsum(n) - n
    second = np.full(int(n.sum()), edge, np.int64)
    inner = np.ones(len(second), bool)
    inner[starts + lengths] = False
    second[inner] = tokens
    first = np.concatenate([[edge], second[:-1]]) if len(second) else second
    first[starts] = edge
    before, after = np.append(words, START), np.append(words, END)
    return _mix(before[first] * np.uint64(0x9E3779B97F4A7C15) + _mix(after[second])), first, second, starts


def _contents(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(r.words), unpack(r.tokens).astype(np.int64), unpack(r.lengths).astype(np.int64)


def _ranges(keys: np.ndarray, bits: int) -> dict[int, slice]:
    """The part of sorted keys in each hash range that has some."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(top, prepend=-1))
    return {int(top[a]): slice(a, b) for a, b in zip(first, np.append(first, len(keys))[1:], strict=True)}


def requests(packed: DataFrame, bits: int) -> DataFrame:
    """(part, batch, counted, bigrams, bigram_n, words, word_n): what a batch has in a hash range, and how often."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                words, tokens, lengths = _contents(r)
                keys, n = np.unique(_bigrams(words, tokens, lengths)[0], return_counts=True)
                word_n = np.bincount(tokens, minlength=len(words))
                at, word_at, none = _ranges(keys, bits), _ranges(words, bits), slice(0, 0)
                out = []
                for k in sorted(at.keys() | word_at.keys()):
                    a, b = at.get(k, none), word_at.get(k, none)
                    out.append((k, r.batch, r.counted, pack_sorted(keys[a]), pack(n[a]), pack_sorted(words[b]), pack(word_n[b])))
                yield pd.DataFrame(out, columns=["part", "batch", "counted", "bigrams", "bigram_n", "words", "word_n"])

    return packed.mapInPandas(run, "part int, batch long, counted int, bigrams binary, bigram_n binary, words binary, word_n binary")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray], counted: np.ndarray) -> tuple[list[list[np.ndarray]], int]:
    """For each list of keys the background and the target count of each, over all lists, and the number of distinct counted keys."""
    flat, sizes = np.concatenate(keys), [len(k) for k in keys]
    distinct, place = np.unique(flat, return_inverse=True)
    n, of = np.concatenate(counts).astype(np.int64), np.repeat(counted, sizes)
    both, seen = [], np.zeros(len(distinct), bool)
    for kind in (BACKGROUND, TARGET):
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place[of == kind], n[of == kind])
        seen |= total > 0
        both.append(np.split(total[place], np.cumsum(sizes)[:-1]))
    return both, int(seen.sum())


def answers(asked: DataFrame) -> DataFrame:
    """(batch, part, kinds, bigram_n, bigram_t, word_n, word_t): the counts of what the batch has in the range; kinds, the range's words, is told to one batch."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("batch", ignore_index=True)  # another attempt gives the same answer
        counted = group["counted"].to_numpy()
        (bn, bt), _ = _summed([unpack_sorted(x) for x in group["bigrams"]], [unpack(x) for x in group["bigram_n"]], counted)
        (wn, wt), kinds = _summed([unpack_sorted(x) for x in group["words"]], [unpack(x) for x in group["word_n"]], counted)
        packed = {c: [pack(x) for x in v] for c, v in (("bigram_n", bn), ("bigram_t", bt), ("word_n", wn), ("word_t", wt))}
        out = pd.DataFrame({"batch": group["batch"], "part": group["part"], "kinds": np.where(np.arange(len(group)) == 0, kinds, 0)} | packed)
        return out[counted != TARGET] if (counted != TARGET).any() else out.iloc[:1]

    return asked.groupBy("part").applyInPandas(run, "batch long, part int, kinds long, bigram_n binary, bigram_t binary, word_n binary, word_t binary")


@dataclass
class Pair:
    """The documents of both models; the models themselves are made range by range while documents are scored."""

    docs: DataFrame
    background: DataFrame
    target: DataFrame


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Pair:
    """Models of all docs and of those whose id is in target_ids (one column). Null texts count as empty; a null id is in no target; rows that repeat an id are all in
    the target or none."""
    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    wanted = stored(target_ids.toDF("digest").distinct(), "lm-target")
    # one plan at every size: the bitmap keeps other texts from being moved, whatever the number of ids
    target = probe(slim.withColumn("digest", F.col("id")), wanted).join(wanted.hint("merge"), "digest", "left_semi").select("id", "text")
    return Pair(docs, slim, target)


def score(docs: DataFrame, models: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens (words and the end sign), target_loss, background_loss (nats per token), score
    (target_loss - background_loss).

    Words are A-Z lower-cased and told apart by 64-bit hashes, as bigrams are. A word that the models have never seen counts as a kind seen nowhere. Null, empty and white texts have the
    end sign alone. Texts are read whole; repeated rows score alike; other columns are not read; no row gives no row.
    """
    own = docs is models.docs
    packed = batches(models.background, BACKGROUND).unionByName(batches(models.target, TARGET))
    if not own:
        packed = packed.unionByName(batches(keyed(docs, id_col, text_col).toDF("id", "text"), NOTHING))
    packed = stored(packed, "lm-batches")
    sums = {r["counted"]: r for r in packed.groupBy("counted").agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).collect()}
    bits = max(RANGE_BITS, (sum(r["words"] for r in sums.values()) // RANGE_WORDS).bit_length())
    told = stored(answers(requests(packed, bits)), "lm-answers")
    kinds = told.agg(F.sum("kinds")).first()[0] or 0
    of = lambda k: (sums[k]["docs"], sums[k]["words"]) if k in sums else (0, 0)
    # the end sign and a word never seen are kinds too
    ends, sizes = zip(*((d, d + w + kinds + 2) for d, w in map(of, (BACKGROUND, TARGET))), strict=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                words, tokens, lengths = _contents(r)
                keys, first, second, starts = _bigrams(words, tokens, lengths)
                place = np.unique(keys, return_inverse=True)[1]
                told = sorted(r.told, key=lambda x: x["part"])
                loss = []
                for m, kind in enumerate("nt"):
                    count = np.concatenate([unpack(x[f"bigram_{kind}"]) for x in told]).astype(float)[place]
                    seen = np.append(np.concatenate([unpack(x[f"word_{kind}"]) for x in told]).astype(float), ends[m])
                    base, prior = (seen + 1) / sizes[m], seen**HEAPS
                    p1, weight, total = base[second], prior[first], seen[first]
                    log = np.log(np.where(total > 0, (count + weight * p1) / np.maximum(total + weight, 1), p1))
                    loss.append(-np.add.reduceat(log, starts) / (lengths + 1))
                yield pd.DataFrame({"id": list(r.ids), "n_tokens": lengths + 1, "target_loss": loss[1], "background_loss": loss[0]}).astype({"id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    fields = F.struct("part", "bigram_n", "bigram_t", "word_n", "word_t")
    replies = told.groupBy("batch").agg(F.collect_list(fields).alias("told"))
    mine = packed.where(F.col("counted") == (BACKGROUND if own else NOTHING)).select("batch", F.col("ids").cast("array<string>").alias("ids"), "lengths", "words", "tokens")
    out = mine.join(replies, "batch").mapInPandas(run, "id string, n_tokens long, target_loss double, background_loss double")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
