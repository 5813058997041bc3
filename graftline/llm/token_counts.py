"""Token counts of a byte-level BPE tokenizer file by rank-synchronous merging of ragged arrays.

White space always parts tokens, so a batch of texts is known by its distinct words; a word goes through the file's own
normaliser and pre-tokeniser. The pre-tokens of all words lie end to end in one array of symbols. Each round finds every
sequence's lowest-rank pair and applies it in all sequences at once; sequences with nothing left to merge leave the array.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from graftline.llm.common import WORD, keyed

#: Texts are counted in batches of so many characters, or one text if that is longer.
BATCH_CHARS = 1 << 24
#: So many words at most, of 64 characters at most, are remembered with their counts from batch to batch.
MOST_KNOWN = 1 << 19
#: Steps of a tokenizer file that need no library for words of the characters PLAIN, which they only lower-case and split. Fixed values of the file format.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PLAIN_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PLAIN = re.compile("[!-~\u00a1-\u024f]+")
#: The rank of a pair that no merge has.
NEVER = np.iinfo(np.int32).max


class Numbers(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def ragged_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the runs, of the given sizes, that values is made of; an empty run has 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(sizes, dtype=np.int64)
    return total[end] - total[end - sizes]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next one from U+0100 on."""
    spare = itertools.count(256)
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts of the symbols that are left of byte-level pre-tokens under a list of merges."""

    def __init__(self, model: dict):
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain merges are known here")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int32)
        self.final = np.array([vocab[c + suffix] for c in alphabet], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array([vocab[s] for s in part], dtype=np.int64) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.width = len(vocab)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = made.astype(np.int32)
        known = np.full(self.width, -1, np.int64)
        np.maximum.at(known, made, np.arange(len(made)))
        #: Whether a merge's parts are made by earlier merges alone: then all places of a pair may merge in one round.
        self.ordered = bool((np.maximum(known[left], known[right]) < np.arange(len(made))).all()) and len(np.unique(key)) == len(key)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each pre-token (not empty) has. Rounds: the largest number of distinct pairs merged in a word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        if not len(words):
            return out
        code = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(sizes) - 1
        sym = self.inner[code]
        sym[last] = self.final[code[last]]
        word = np.arange(len(words))  # the words that still have pairs, and the sizes of their runs of symbols
        rank = np.full(len(sym), NEVER, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[last] = NEVER
        while True:
            start = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, start)
            live = least < NEVER
            if not live.all():
                out[word[~live]] = sizes[~live]
                keep = np.repeat(live, sizes)
                sym, rank, word, sizes, least = sym[keep], rank[keep], word[live], sizes[live], least[live]
                if not len(word):
                    return out
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            new = np.r_[True, np.diff(hit) > 1]  # the first of neighbouring places; of x x x the first two merge
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
            owner = np.repeat(np.arange(len(word)), sizes)[hit]
            if not self.ordered:
                hit, owner = hit[np.r_[True, np.diff(owner) > 0]], np.unique(owner)
            sym[hit] = self.made[rank[hit]]
            sizes = sizes - np.bincount(owner, minlength=len(word))
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit -= np.arange(len(hit))
            sym, rank = sym[keep], rank[keep]
            stop = np.zeros(len(sym), bool)
            stop[np.cumsum(sizes) - 1] = True
            for at in (hit, hit[hit > 0] - 1):
                at = at[~stop[at]]
                rank[at] = self.ranks(sym[at], sym[at + 1])
            rank[stop] = NEVER


class TokenCounter:
    """A tokenizers file whose tokens are counted: special strings as the library handles them, no other special tokens."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings without white space")
        source = Tokenizer.from_file(file)
        self.normalise, self.split = source.normalizer.normalize_str, source.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.pattern = regex.compile(PLAIN_PATTERN) if (spec["normalizer"], spec["pre_tokenizer"]) == (PLAIN_NORMALIZER, PLAIN_SPLIT) else None
        special = [t["content"] for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.lead = os.path.commonprefix(special)
        self.merger = RankMerger(spec["model"])
        self.word = re.compile(WORD)
        self.known: dict[str, int] = {}

    def pieces(self, word: str) -> list[bytes]:
        """The pre-tokens of a word without special strings, as bytes."""
        if self.pattern and PLAIN.fullmatch(word):
            return [p.encode() for p in self.pattern.findall(word.lower())]
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.split(self.normalise(word)) if p]

    def word_counts(self, words: list[str]) -> list[int]:
        """The tokens of each word, special strings in it counted as one each."""
        pieces, of_word, each, fixed = Numbers(), [], [], []
        for w in words:
            parts, n = self.special.split(w) if self.special and self.lead in w else (w,), len(of_word)
            for part in parts:
                if part:
                    of_word += map(pieces.__getitem__, self.pieces(part))
            fixed.append(len(parts) - 1)
            each.append(len(of_word) - n)
        per_piece = self.merger.counts(list(pieces))
        return (ragged_sums(per_piece[np.array(of_word, dtype=np.int64)], np.array(each, dtype=np.int64)) + np.array(fixed, dtype=np.int64)).tolist()

    def counts(self, texts: list[str]) -> np.ndarray:
        words, found, sizes = Numbers(), [], []
        for t in texts:
            found += map(words.__getitem__, self.word.findall(t))
            sizes.append(len(found))
        of_word = np.array(found, dtype=np.int64)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known, new = {}, list(words)
        fresh = dict(zip(new, self.word_counts(new), strict=True))
        per_word = np.array([self.known[w] if w in self.known else fresh[w] for w in words], dtype=np.int64)
        if len(fresh) <= MOST_KNOWN:
            self.known |= {w: n for w, n in fresh.items() if len(w) <= 64}
        return ragged_sums(per_word[of_word], np.diff(np.array([0, *sizes], dtype=np.int64)))


_LOADED: dict[str, TokenCounter] = {}


def counter(file: str) -> TokenCounter:
    """One counter for each file and process."""
    if file not in _LOADED:
        _LOADED[file] = TokenCounter(file)
    return _LOADED[file]


def batches(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, and over_limit, whether n_tokens is above the limit.

    A null text counts as empty and has no tokens, as a text of white space has. Repeated rows, null and repeated ids each
    give their row; an empty table gives none; other columns are not read. Texts are counted whole, however long. The file
    must exist at that path on every executor.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(file).counts
        for frame in frames:
            at = 0
            for part in batches([t or "" for t in frame["text"].where(frame["text"].notna(), "")]):
                n = count(part)
                yield pd.DataFrame({"id": frame["id"].iloc[at : at + len(part)].values, "n_bytes": [len(t.encode()) for t in part], "n_tokens": n, "over_limit": n > limit})
                at += len(part)

    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return slim.mapInPandas(run, schema).withColumnRenamed("id", id_col)
