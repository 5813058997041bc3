"""Exact deduplication by a log-structured merge index, in DataFrame operations alone.

A memtable is one input partition: its digests are sorted and flushed as a run of (digest, id). Compaction merges FAN neighbouring
runs of a level to one of the next, which keeps the best id and the number of rows of each digest, until one run is left. Every
run has a filter, a bitmap of digest slots sized by its number of keys, that a probe meets first, so that only possible hits
fetch their text. Hits are then verified byte by byte, and digests under which different bytes meet are split by the bytes
themselves, so a digest collision never merges two texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import ascii_lower, keyed, stored

#: Bits of a filter for each key, and the least and most bits of a filter as powers of two; it is broadcast as 64-bit words, so 2**26 bits are at most a million
#: rows of 16 bytes. A filter that has too few bits lets more rows through, never fewer.
KEY_BITS, LEAST_BITS, MOST_BITS = 8, 16, 26
#: Runs that are merged to one, as a power of two.
FAN_BITS = 5
BEST = {"smallest": F.min, "largest": F.max}


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flush(docs: DataFrame, id_col: str, text: Column, digest=digest_of) -> DataFrame:
    """Each partition's rows as a sorted run: (run, digest, id)."""
    run = docs.select(F.spark_partition_id().alias("run"), digest(text).alias("digest"), F.col(f"`{id_col}`").alias("id"))
    return stored(run.sortWithinPartitions("digest", "id"), "lsm-run")


def merged(runs: DataFrame, keep: str, fan_bits: int = FAN_BITS) -> DataFrame:
    """The next level: of each digest of neighbouring runs the id that stays and the number of rows."""
    run = F.shiftright("run", fan_bits).alias("run")
    return runs.groupBy(run, "digest").agg(BEST[keep]("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).sortWithinPartitions("run", "digest")


def compact(runs: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS) -> DataFrame:
    """Runs merged level by level to the last one: (digest, keep_id, group_size). A hot digest is one row a run from the first level on."""
    level = runs.select("run", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    last = runs.agg(F.max("run")).first()[0] or 0
    while True:
        level, last = stored(merged(level, keep, fan_bits), "lsm-level"), last >> fan_bits
        if not last:
            return level.drop("run")


def slot(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def filter_bits(keys: int) -> int:
    """Bits of the filter of so many keys."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * keys).bit_length()))


def filter_of(digests: DataFrame, bits: int) -> DataFrame:
    """The bitmap of the digests' slots: (word, bits), bits / 64 rows at most."""
    s = slot(F.col("digest"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))
    return digests.select(F.shiftright(s, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_hit(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """rows whose digest's slot is set; false hits are possible, misses are not."""
    s = slot(F.col("digest"), bits)
    at = rows.withColumn("_word", F.shiftright(s, 6)).withColumn("_at", F.pmod(s, F.lit(64)).cast("int"))
    hit = at.join(F.broadcast(bitmap), F.col("_word") == F.col("word"))
    return hit.where(F.expr("getbit(bits, _at)") == 1).select(*rows.columns)


def probe(rows: DataFrame, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """rows whose digest may be among the keys (digest), by a filter of their number's size."""
    bits = bits or filter_bits(keys.count())
    return may_hit(rows, filter_of(keys, bits), bits)


@dataclass
class MergeIndex:
    """An index over batches of documents: one run a batch on the first level, FAN runs of a level become one of the next."""

    keep: str = "smallest"
    fan_bits: int = FAN_BITS
    levels: list[list[DataFrame]] = field(default_factory=lambda: [[]])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower) -> None:
        """Flushes a batch (its own memtables merged) and compacts every level that is full."""
        text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        self.levels[0].append(compact(flush(keyed(docs, id_col, text_col), id_col, text), self.keep, self.fan_bits))
        for at, level in enumerate(self.levels):
            if len(level) >> self.fan_bits:
                runs = level[0].withColumn("run", F.lit(0))
                for run in level[1:]:
                    runs = runs.unionByName(run.withColumn("run", F.lit(0)))
                level.clear()
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(stored(merged(runs, self.keep, self.fan_bits).drop("run"), "lsm-level"))

    def find(self, rows: DataFrame) -> DataFrame:
        """rows (with a digest column) that some run holds, with keep_id and group_size over all runs. Each run is asked through its filter."""
        keys = rows.select("digest").distinct()
        found = None
        for run in (r for level in self.levels for r in level):
            met = probe(keys, run).join(run, "digest")
            found = met if found is None else found.unionByName(met)
        if found is None:
            return rows.limit(0).withColumns({"keep_id": F.lit(None), "group_size": F.lit(0)})
        best = found.groupBy("digest").agg(BEST[self.keep]("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return rows.join(best, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=ascii_lower, digest=digest_of, bits: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per input row: id, keep_id (of the equal text that stays), group_size (rows of equal text), kept, text_sha256.

    Texts are equal when their normalised bytes are (A-Z lower-cased by default). A null text counts as empty, and empty
    texts equal one another. Rows that repeat an id share its fate: all are kept or none. A null id sorts below all others
    and stays only if its group has no other (kept is then true). No row gives no row; other columns are not read.
    """
    slim = keyed(docs, id_col, text_col)
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    run = flush(slim, id_col, text, digest)
    index = compact(run, keep, fan_bits)
    hits = index.where("group_size > 1")
    fetched = probe(slim.select(digest(text).alias("digest"), text.alias("bytes"), F.col(f"`{id_col}`").alias("id")), hits, bits)
    spans = fetched.groupBy("digest").agg((F.min("bytes") != F.max("bytes")).alias("differ"))
    clash = stored(spans.where("differ").select("digest"), "lsm-clash")
    if not clash.isEmpty():
        split = fetched.join(clash, "digest", "left_semi")
        own = split.groupBy("digest", "bytes").agg(BEST[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first(F.sha2(F.col("bytes").cast("binary"), 256)).alias("sha"))
        index = index.join(clash, "digest", "left_anti").withColumn("sha", F.lit(None).cast("string")).unionByName(own.drop("bytes"))
        # ids under a clashing digest carry the full text's own digest, by which the split classes tell them apart
        whole = slim.select(digest(text).alias("digest"), F.col(f"`{id_col}`").alias("id"), F.sha2(text.cast("binary"), 256).alias("row_sha"))
        joined = whole.join(index, "digest").where(F.col("sha").isNull() | (F.col("sha") == F.col("row_sha")))
        return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("row_sha").alias("text_sha256"))
    joined = run.join(index, "digest")
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
