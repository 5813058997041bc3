"""Substring deduplication by relative Lempel-Ziv parsing against every document as a reference block.

The reference index is spread over the cluster by anchors: the leftmost least hash among a window's runs of GRAM words is the
same in every copy of the window, so copies meet under one key. Consecutive windows with one anchor form a unit. Where all units of
an anchor are equal, each is a factor of the others; where they differ, at the boundaries of a longer match, their single windows
are looked up. Documents are then factored greedily: a factor goes on while the reference goes on with it, and every window at
a factor's boundary has been checked by itself, so the factors of WINDOW words or more cover exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import keyed, stored
from graftline.llm.exact_dedup import probe
from graftline.llm.near_dedup import WordHashes, _mix

WINDOW = 35
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    down = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 15, 1 << n.bit_length()))


class Parsed:
    """A text's words, their hashes and the hashes of any of its word ranges."""

    def __init__(self, text: str | None, cache: WordHashes):
        self.words = (text or "").encode("utf-8", "replace").split()  # splits at ASCII white space alone
        n = len(self.words)
        self.hashes = np.fromiter(map(cache.__getitem__, self.words), np.uint64, n)
        digest = xxhash.xxh3_64_intdigest(self.hashes.tobytes())
        self.doc = digest - (1 << 63)
        up, self.down = powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:n], dtype=np.uint64)])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def units(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: its hash, the hash of the words its windows cover, its first window and their number."""
        n = len(self.words)
        if n < window:
            none = np.empty(0, np.int64)
            return none, none, none, none
        gram = min(GRAM, window)
        at = np.arange(n - gram + 1)
        grams = self.ranges(at, at + gram)
        span = window - gram + 1
        anchor = np.arange(n - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        return grams[anchor[first]].view(np.int64), self.ranges(first, first + count - 1 + window).view(np.int64), first, count

    def kept(self, spans: list[tuple[int, int]]) -> tuple[int, str]:
        """Words in a span, and the digest of the others."""
        gone = np.zeros(len(self.words) + 1, np.int64)
        for a, b in spans:
            gone[a] += 1
            gone[b] -= 1
        out = np.cumsum(gone)[:-1] > 0
        return int(out.sum()), hashlib.sha256(b" ".join(w for w, x in zip(self.words, out, strict=True) if not x)).hexdigest()


def location(doc: Column, place: Column) -> Column:
    """A place in all documents: 62 bits of the document's hash, and as many places on as the word has in it."""
    return F.shiftright(doc, 2) + place.cast("long")


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (id, text, raw) as (id, raw, doc, n_words, sha, anchors, units, starts, counts): doc is a hash of the word sequence, sha of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            for at in range(0, len(b), 250):
                part, rows = b.iloc[at : at + 250], []
                for i, t, raw in zip(part["id"], part["text"], part["raw"], strict=True):
                    p = Parsed(t, cache)
                    rows.append((i, raw, p.doc, len(p.words), hashlib.sha256(b" ".join(p.words)).hexdigest(), *p.units(window)))
                yield pd.DataFrame(rows, columns=["id", "raw", "doc", "n_words", "sha", "anchors", "units", "starts", "counts"])

    return docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, raw binary, doc long, n_words long, sha string, anchors array<long>, units array<long>, starts array<int>, counts array<int>")


def _windows(joined: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, doc, start) of each window under the anchors listed with a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            for at in range(0, len(b), 250):
                part, out = b.iloc[at : at + 250], []
                for doc, text, anchor, start, count in part[["doc", "text", "anchor", "start", "count"]].itertuples(index=False):
                    p = Parsed(text, cache)
                    if p.doc != doc:
                        raise ValueError("two texts of one hash")
                    start, count = np.asarray(start, np.int64), np.asarray(count, np.int64)
                    places = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    out.append(pd.DataFrame({"anchor": np.repeat(np.asarray(anchor, np.int64), count), "hash": p.ranges(places, places + window).view(np.int64), "doc": doc, "start": places.astype(np.int32)}))
                if out:
                    yield pd.concat(out)

    return joined.mapInPandas(run, "anchor long, hash long, doc long, start int")


def factors(spans: np.ndarray) -> list[list[int]]:
    """Greedy factors [first window, windows, reference] of (start, count, reference) rows in order of start: a factor goes
    on while the next row continues both the document and the reference."""
    out: list[list[int]] = []
    for start, count, ref in spans:
        if out and start == out[-1][0] + out[-1][1] and ref == out[-1][2] + out[-1][1]:
            out[-1][1] += count
        else:
            out.append([int(start), int(count), int(ref)])
    return out


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (of one document each) with the text that has the hash raw. Equal texts are one before they are moved, whatever their ids; a filter keeps most others from being moved."""
    wanted = rows.select(F.col("raw").alias("digest"))
    near = probe(docs.select(F.col("raw").alias("digest"), "text"), wanted).groupBy(F.col("digest").alias("raw")).agg(F.first("text").alias("text"))
    return rows.join(near, "raw")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), n_factors.

    A word is removed when a window of so many consecutive words of its document covers it whose sequence also starts
    anywhere else, in this or another row. Windows are judged on the input. Texts with fewer words lose none; null and empty texts have no
    word. Rows of one word sequence, repeated rows too, are copies of one another and lose all words if they have a window.
    Ids are only carried along: null and repeated ones cost nothing more. Other columns are not read; no row gives no row. Very long texts
    are read whole.
    """
    slim = keyed(docs, id_col, text_col).toDF("id", "text").select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("raw", F.unhex(F.md5(F.col("text").cast("binary"))))
    parsed = stored(parse(slim, window), "rlz-parse")
    classes = stored(parsed.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"), F.min("raw").alias("raw")), "rlz-classes")
    units = parsed.select("doc", F.inline(F.arrays_zip("anchors", "units", "starts", "counts"))).toDF("doc", "anchor", "unit", "start", "count")
    at = location(F.col("doc"), F.col("start"))
    index = units.groupBy("anchor").agg(F.min("unit").alias("u0"), F.max("unit").alias("u1"), F.min(at).alias("low"), F.max(at).alias("high"))
    index = stored(index.where("low <> high").select("anchor", (F.col("u0") == F.col("u1")).alias("same"), "low", "high"), "rlz-index")

    hits = probe(units.withColumn("digest", F.col("anchor")), index.select(F.col("anchor").alias("digest"))).drop("digest", "unit")
    hits = stored(hits.join(index, "anchor"), "rlz-hits")
    ref = F.when(F.col("low") == at, F.col("high")).otherwise(F.col("low"))
    whole = hits.where("same").select("doc", "start", "count", ref.alias("ref"))

    mixed = hits.where("not same").select("doc", "anchor", "start", "count").distinct()
    mixed = mixed.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("m")).join(classes, "doc")
    mixed = stored(mixed.select("raw", "doc", F.col("m.anchor").alias("anchor"), F.col("m.start").alias("start"), F.col("m.count").alias("count")), "rlz-mixed")
    windows = stored(_windows(_with_text(slim, mixed), window), "rlz-windows")
    met = windows.groupBy("anchor", "hash").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    met = stored(met.where("low <> high"), "rlz-met")
    single = windows.join(met, ["anchor", "hash"]).select("doc", "start", F.lit(1).alias("count"), ref.alias("ref"))

    lone = classes.where("copies = 1")
    spans = whole.unionByName(single).groupBy("doc").agg(F.collect_set(F.struct("start", "count", "ref")).alias("spans"))
    spans = stored(spans.join(lone, "doc").select("raw", "doc", "spans"), "rlz-spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            out = []
            for doc, text, found in b[["doc", "text", "spans"]].itertuples(index=False):
                p = Parsed(text, cache)
                if p.doc != doc:
                    raise ValueError("two texts of one hash")
                parts = factors(sorted((s["start"], s["count"], s["ref"]) for s in found))
                out.append((doc, *p.kept([(a, a + n - 1 + window) for a, n, _ in parts]), len(parts)))
            yield pd.DataFrame(out, columns=["doc", "n_removed", "sha", "n_factors"])

    done = stored(_with_text(slim, spans).mapInPandas(cut, "doc long, n_removed long, sha string, n_factors long"), "rlz-cut")
    fates = stored(classes.drop("raw").join(done, "doc", "left"), "rlz-fates")  # so that one plain join meets a class of many copies
    told = parsed.select("id", "doc", "n_words", F.col("sha").alias("all_sha")).join(fates, "doc")
    copy = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return told.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "all_sha")).alias("kept_sha256"),
        F.when(copy, 1).otherwise(F.coalesce("n_factors", F.lit(0))).cast("long").alias("n_factors"),
    )
