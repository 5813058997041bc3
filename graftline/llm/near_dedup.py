"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: one scatters a document's shingles over a circle, the other ranks the places of
the circle, and coordinate k is the least rank among the shingles' places moved on by k. Signatures are cut into bands;
documents that share a band are candidates, and every link is confirmed on the full shingle sets.

Equal sets are one class from the start, whatever their number. Of a band's bucket only links that can still join two
components are worth a check: first all members against one pivot, then members outside the bucket's largest component
against those of other components, in bounded blocks, so that no candidate pair between two components is left out. Blocks
are screened by signatures; only rows that have a likely partner in a block bring their sets there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import keyed, stored
from graftline.llm.exact_dedup import probe
from graftline.operators.components import components

WORDS = 5
BANDS, ROWS = 32, 4
WIDTH = BANDS * ROWS
#: Places on the circle.
CIRCLE = 1 << 20
#: Rows of a block that are held against CHUNK others in one unit of work.
BLOCK, CHUNK = 256, 512
#: Candidates whose signatures agree on less than this share of coordinates have a likeness under 0.75 but for odds of
#: about one in 30,000, as bands have of missing a pair (0.75: share 0.75 +- 0.04).
LEAST_SHARE = 0.6

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """Hash of a word, held for the most recent kinds of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, cache: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text, A-Z lower-cased; bytes.split() and bytes.lower()
    know ASCII alone, as the rule for words does."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, tokens), np.uint64, n)
    if n < words:
        return _mix(np.array([(w * _MULTIPLIERS[:n]).sum() + np.uint64(n)], np.uint64))
    h = w[: n - words + 1] * _MULTIPLIERS[0]
    for k in range(1, words):
        h = h + w[k : n - words + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mix(h))


@lru_cache(maxsize=1)
def _ranks() -> np.ndarray:
    """The ranks of places, WIDTH of them from every place on."""
    ranks = np.random.default_rng(20220).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: WIDTH - 1]]), WIDTH)


def signature(shingles: np.ndarray) -> np.ndarray:
    """WIDTH coordinates from the two permutations; shingles are taken in slices, so memory stays bounded."""
    places = (_mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full(WIDTH, CIRCLE, np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(out, _ranks()[places[at : at + 2048]].min(axis=0), out=out)
    return out


def buckets(sig: np.ndarray) -> list[int]:
    """One 64-bit key a band."""
    raw = sig.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], seed=b) - (1 << 63) for b in range(BANDS)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest of the set, signature) of every row; rows without words have no digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                sets = [shingle_set(t, cache) for t in part["text"].where(part["text"].notna(), "")]
                yield pd.DataFrame({
                    "id": part["id"].values,
                    "n": [len(s) for s in sets],
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "sig": [signature(s).tobytes() if len(s) else None for s in sets],
                })

    slim = keyed(docs, id_col, text_col).toDF("id", "text")
    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, n long, digest binary, sig binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    """(id, n, band, bucket) of every band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                keys = [buckets(np.frombuffer(s, np.uint32)) for s in part["sig"]]
                yield pd.DataFrame({"id": part["id"].values, "buckets": keys, "n": part["n"].values})

    rows = classes.mapInPandas(run, "id long, buckets array<long>, n long")
    return rows.select("id", "n", F.posexplode("buckets").alias("band", "bucket"))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of which size and signature allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            a, b = (np.frombuffer(b"".join(p[c]), np.uint32).reshape(len(p), WIDTH) for c in ("sig_a", "sig_b"))
            small, large = np.minimum(p["n_a"], p["n_b"]), np.maximum(p["n_a"], p["n_b"])
            yield p.loc[((a == b).mean(axis=1) >= LEAST_SHARE) & (100 * small >= 75 * large), ["a", "b"]]

    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = []
            for x, y in zip(p["set_a"], p["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield p.loc[keep, ["a", "b"]]

    side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted classes at least: a filter keeps most other texts from being moved. Rows that repeat an id with another text are classes of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            for at in range(0, len(b), 500):
                sets = [shingle_set(t, cache).tobytes() for t in b["text"].iloc[at : at + 500]]
                yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets})

    owners = stored(classes.join(wanted, "id", "left_semi").select(F.col("rep").alias("digest")).distinct(), "near-owners")
    near = probe(docs.where("text is not null").withColumn("digest", F.col("id")), owners).select("id", "text", F.xxhash64("text").alias("h"))
    found = near.dropDuplicates(["id", "h"]).select("text").mapInPandas(run, "digest binary, shingles binary")
    return found.select(F.xxhash64("digest").alias("id"), "shingles")


def _across(rows: DataFrame, comp: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) between components that meet in a bucket, or None where no bucket holds two components.

    In each such bucket, rows outside its largest component meet all rows of other components, in units of BLOCK by CHUNK rows. First
    signatures alone meet; rows with a likely partner in a unit then bring their sets to it. A pair is looked at in the first band of which it shares the bucket, and a unit tells only the links that join
    two of its components, so what it returns is less than its rows.
    """
    known = stored(rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id"), "near-rows")
    kinds = known.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    stats = kinds.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("largest"), F.sum("c").alias("n_all"), F.count(F.lit(1)).alias("kinds"))
    stats = stats.where("kinds > 1").select("bucket", F.col("largest.comp").alias("main"), "n_all", (F.col("n_all") - F.col("largest.c")).alias("n_out"))
    stats = stored(stats, "near-open")
    if stats.isEmpty():
        return None
    met = known.join(stats, "bucket").join(classes.select("id", "sig"), "id")
    blocks, parts = F.ceil(F.col("n_out") / BLOCK), F.ceil(F.col("n_all") / CHUNK)
    own_block, own_part = F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64("id", F.lit(1)), parts)
    unit = lambda k, r, left: F.struct(k.alias("k"), r.alias("r"), F.lit(left).alias("left"))
    right = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: unit(k, own_part, False))
    left = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda r: unit(own_block, r, True))
    dealt = F.when(F.col("comp") == F.col("main"), right).otherwise(F.concat(right, left))
    units = met.select("bucket", "band", "id", "n", "sig", "comp", F.inline(dealt))
    likely_rows = units.groupBy("bucket", "k", "r").applyInPandas(_screen, units.schema)
    brought = stored(likely_rows, "near-screened").join(sets, "id")
    return brought.groupBy("bucket", "k", "r").applyInPandas(_unit, "a long, b long").distinct()


def _fits(i: int, xs: np.ndarray, zs: np.ndarray, n: int, others: np.ndarray, band: int) -> np.ndarray:
    """Which of the signatures zs, of sets of other sizes, may be linked with row i of xs and share no bucket of an earlier band."""
    equal = xs[i] == zs
    seen = equal[:, : ROWS * band].reshape(len(zs), -1, ROWS).all(axis=2).any(axis=1)
    return (equal.mean(axis=1) >= LEAST_SHARE) & ~seen & (100 * np.minimum(n, others) >= 75 * np.maximum(n, others))


def _sides(group: pd.DataFrame) -> tuple:
    x, y = group[group["left"]], group[~group["left"]]
    xs, zs = (np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), WIDTH) for g in (x, y))
    return x, y, xs, zs, int(group["band"].iloc[0])


def _screen(group: pd.DataFrame) -> pd.DataFrame:
    """A unit's rows that have a likely partner of another component in it."""
    x, y, xs, zs, band = _sides(group)
    left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
    xn, yn, xc, yc = x["n"].values, y["n"].values, x["comp"].values, y["comp"].values
    for i in range(len(x) if len(y) else 0):
        fits = _fits(i, xs, zs, xn[i], yn, band) & (yc != xc[i])
        left[i] = fits.any()
        right |= fits
    return pd.concat([x[left], y[right]])


def _unit(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one unit's left rows with its right rows."""
    x, y, xs, zs, band = _sides(group)
    found: list[tuple[int, int]] = []
    if len(x) and len(y):
        xn, yn, xi, yi = x["n"].values, y["n"].values, x["id"].values, y["id"].values
        ys = [np.frombuffer(s, np.uint64) for s in y["shingles"]]
        known = pd.factorize(np.concatenate([x["comp"].values, y["comp"].values]))[0]
        own, other = known[: len(x)], known[len(x) :].copy()
        for i in range(len(x)):
            hits = np.flatnonzero(_fits(i, xs, zs, xn[i], yn, band) & (other != own[i]))
            if not len(hits):
                continue
            mine = np.frombuffer(x["shingles"].iloc[i], np.uint64)
            for at in range(0, len(hits), 128):
                part = hits[at : at + 128]
                lengths = np.array([len(ys[j]) for j in part])
                flat = np.concatenate([ys[j] for j in part])
                place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                for j in part[100 * both >= 75 * (len(mine) + lengths - both)]:
                    if other[j] != own[i]:
                        found.append((min(xi[i], yi[j]), max(xi[i], yi[j])))
                        gone, stays = other[j], own[i]  # one component from here on
                        own[own == gone], other[other == gone] = stays, stays
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included), kept
    (id = component_id).

    Two rows are linked when 100 * |A and B| >= 75 * |A or B| over their sets of distinct five-word shingles. A text of fewer
    words is one shingle; null, empty and white texts have no shingle and no link, and are kept. Equal sets are one class, known by a hash of the set. Rows
    that repeat an id are one document, with the links of each of their texts. A null id is linked with nothing: its component_id is null and it is kept. Texts of any length
    are read whole; other columns are not read; no row gives no row. Ids are integers.
    """
    slim = keyed(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    sigs = stored(signatures(slim, "id", "text").withColumn("class", F.xxhash64("digest")), "near-signatures")
    held = sigs.where("digest is not null and id is not null")
    classes = stored(held.groupBy(F.col("class").alias("id")).agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    comp = _link(slim, classes, held)
    own = stored(classes.select(F.col("id").alias("class"), "rep").join(comp, F.col("class") == F.col("id"), "left").select("class", F.coalesce("component_id", "class").alias("comp"), "rep"), "near-membership")
    least = own.groupBy("comp").agg(F.min("rep").alias("component_id"))
    own = stored(own.join(least, "comp").select("class", "component_id"), "near-membership")
    told = sigs.select("id", "n", F.when(F.col("digest").isNotNull(), F.col("class")).alias("class")).join(own, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _link(docs: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """(id, component_id) of the classes that have a link."""
    rows = _band_rows(classes)
    keys = rows.select("bucket", "id", F.xxhash64("id", F.pmod(F.col("bucket"), F.lit(2))).alias("draw"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("draw", "id")).alias("pivot"))
    shared = stored(shared.where("c > 1").select("bucket", F.col("pivot.id").alias("pivot")), "near-buckets")
    rows = stored(rows.join(shared, "bucket"), "near-candidates")
    pairs = rows.where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    sets = stored(_sets(docs, classes, rows.select("id").distinct()), "near-sets")
    links = confirmed(stored(likely(pairs, classes), "near-likely"), sets)
    twice = held.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("id", "a")
    same = held.join(twice, "id").select("a", F.col("class").alias("b")).where("a <> b").distinct()  # texts of one id
    links = stored(links.unionByName(same), "near-links")
    comp = stored(components(links), "near-components")
    more = _across(rows.where("id <> pivot").drop("pivot"), comp, sets, classes)
    return comp if more is None else components(links.unionByName(stored(more, "near-links")))
