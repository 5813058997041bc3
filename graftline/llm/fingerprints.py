"""Document fingerprints by one-permutation MinHash, in DataFrame operations alone.

Every word shingle is hashed once. The hash's top bits name its bin and a bin keeps its smallest hash. A bin without a shingle
takes the value of the first filled bin on a probe order of its own (optimal densification: each empty bin draws its donor
independently). Of each bin's value the low-order bits are packed into a hexadecimal string. The share of equal bins, less
what b bits agree on by chance, estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.common import keyed

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Low-order bits kept of each bin; two hexadecimal digits.
KEPT_BITS = 8


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def constant(values: list, kind: str) -> Column:
    """A constant array; as one text that is folded once it costs the planner one node instead of thousands."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's word shingles; with fewer words, of the whole sequence; without words, none. A null is empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    tokens = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of(h: Column) -> Column:  # a shingle reaches past the last word only where there are fewer words; nulls are not hashed
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    return F.coalesce(let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.when(h.isNotNull(), of(h))), F.array().cast("array<bigint>"))


def probe_order(bin_: int, bins: int = BINS) -> list[int]:
    """The order in which an empty bin looks for a filled one."""
    return sorted((j for j in range(bins) if j != bin_), key=lambda j: hashlib.md5(f"{bin_}>{j}".encode()).digest())


def bin_minima(hashes: Column, bits: int = BIN_BITS) -> Column:
    """An array of 2**bits values by bin; an odd value marks an empty bin.

    Each bin gets one odd sentinel above all its even hashes, so after one sort the first value of each bin is its minimum.
    """
    shift = 64 - bits
    top = constant([((b - (1 << bits - 1)) << shift) | ((1 << shift) - 1) for b in range(1 << bits)], "array<bigint>")
    even = F.transform(hashes, lambda h: h.bitwiseAND(F.lit(-2)))
    ordered = F.sort_array(F.concat(even, top))
    return let(ordered, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(a, i - 1), shift))))


def densify(minima: Column, bits: int = BIN_BITS) -> Column:
    bins = 1 << bits
    probes = constant([probe_order(b, bins) for b in range(bins)], "array<array<int>>")
    odd = lambda v: v.bitwiseAND(F.lit(1)) == 1

    def fill(a: Column) -> Column:
        donor = lambda i: F.get(F.filter(F.get(probes, i), lambda j: ~odd(F.get(a, j))), F.lit(0))
        return F.transform(a, lambda v, i: F.when(odd(v), F.get(a, donor(i))).otherwise(v))

    return F.when(F.exists(minima, lambda v: ~odd(v)), F.when(F.exists(minima, odd), let(minima, fill)).otherwise(minima))


def fingerprint(text: Column, words: int = WORDS, bits: int = BIN_BITS) -> Column:
    """Packed low-order bits, two hexadecimal digits a bin; the empty string for a text without words."""
    filled = let(bin_minima(shingle_hashes(text, words), bits), lambda m: densify(m, bits))
    low = F.transform(filled, lambda v: F.lpad(F.hex(F.shiftright(v, 1).bitwiseAND(F.lit(255))), 2, "0"))
    return F.coalesce(F.lower(F.array_join(low, "")), F.lit(""))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The Jaccard estimate of two fingerprints, from 0 to 1: the share of equal bins corrected for chance agreement.
    Two empty ones are alike (1), an empty and another are not (0)."""
    at = F.sequence(F.lit(0), F.lit(bins - 1))
    two = lambda f, i: F.substring(f, i * 2 + 1, F.lit(2))
    share = F.size(F.filter(at, lambda i: two(a, i) == two(b, i))) / F.lit(float(bins))
    chance = 2.0**-KEPT_BITS
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def cut_keys(slim: DataFrame, slices: int) -> tuple[list[tuple], tuple | None]:
    """(cuts, top): at most slices - 1 keys (id, h) of rows, in ascending order, that part the rows evenly, and the largest key (None without rows).

    Cuts come from a random sample of some 20 rows a slice, so their number is bounded by the slices whatever the table. A null is the least id.
    """
    rows, top_id = slim.agg(F.count(F.lit(1)), F.max("id")).first()
    if not rows:
        return [], None
    top = slim.where(F.col("id").eqNullSafe(F.lit(top_id).cast(slim.schema["id"].dataType))).agg(F.max("h")).first()[0]
    rank = lambda k: (k[0] is not None, k[0] or 0, k[1])
    share = min(1.0, 20 * slices / rows)
    drawn = sorted((tuple(r) for r in (slim if share == 1 else slim.sample(share, seed=1)).select("id", "h").collect()), key=rank)
    cuts = {drawn[len(drawn) * i // slices] for i in range(1, slices)} if drawn else set()
    return sorted(cuts - {(top_id, top)}, key=rank), (top_id, top)


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, print, next_text, next_print), print being the fingerprint and next the row after it by descending id, or
    the first after the last; null texts are empty. Rows of one id follow one another by descending hash of the text, null ids come last.

    Rows are cut at sampled keys, of id and hash, into slices of about equal size, a few for each shuffle partition, so that an id that many rows share is cut as
    well. A cut is itself a row's key, the largest of its slice, and that row is also sent as a guest to the slice above, whose last row it follows; the row of the
    largest key is sent as a guest behind the lowest slice. So every row finds its neighbour in its slice, after one exchange of the
    texts, and only the cuts reach the driver.
    """
    spark = docs.sparkSession
    slim = keyed(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, top = cut_keys(slim, slices)
    kind = f"struct<id:{slim.schema['id'].dataType.simpleString()},h:bigint>"
    key, step = F.struct("id", "h"), max(1, math.isqrt(len(cuts)))
    as_rows = lambda keys: constant([{"id": i, "h": h} for i, h in keys], f"array<{kind}>")
    bounds, below = as_rows(cuts), lambda c: c < key
    whole = F.size(F.filter(as_rows(cuts[step - 1 :: step]), below)) * step  # cuts in the stretches that lie below as a whole
    own = whole + F.size(F.filter(F.slice(bounds, whole + 1, F.lit(step)), below))
    place = lambda at, guest: F.struct(at.alias("slice"), F.lit(guest).alias("guest"))
    last, wraps = F.get(bounds, F.col("own")) == key, key == F.from_json(F.lit(json.dumps(dict(zip(("id", "h"), top or (None, None), strict=True)))), kind)
    copies = F.filter(F.array(place(F.col("own"), 0), F.when(last, place(F.col("own") + 1, 1)), F.when(wraps, place(F.lit(0), 2))), lambda p: p.isNotNull())
    dealt = slim.withColumn("own", own).select("id", "h", "text", F.inline(copies)).repartition(slices // 4, "slice").withColumn("print", fingerprint(F.col("text")))
    order = Window.partitionBy("slice").orderBy("guest", F.col("id").desc_nulls_last(), F.col("h").desc(), "text")
    after = {f"next_{c}": F.coalesce(F.lead(c).over(order), F.col(c)) for c in ("text", "print")}
    return dealt.withColumns(after).where("guest = 0").drop("slice", "guest", "h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next row's text by descending id; after the row of smallest id comes that of the largest, and a single row is its own next. Equal
    texts have equal fingerprints; a null or empty text, or one of white space, has the empty fingerprint. Rows that repeat an id follow one
    another by descending hash of their text, null ids come last of all. Rows equal in id and text lie in one slice. Whole texts of any length are read.
    """
    rows = neighbours(docs, id_col, text_col)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    made = rows.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("print").alias("fingerprint"), "next_print")
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    printed = made.select(id_col, "n_chars", digest.alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_print"))}
    return printed.withColumns(near).drop("next_print")
