import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graftline.llm.exact_dedup import FAN_BITS, MOST_BITS, MergeIndex, compact, exact_dedup, filter_bits, filter_of, flush, probe

SCHEMA = "doc_id long, text string, digest string, id int"
TEXTS = ["Ab c", "aB C", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "solo", "Ab c"]


def expected(rows, best=max):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted((i, best(groups[norm(t)]), len(groups[norm(t)]), i == best(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest_bits", [None, 1])
def test_groups_match_a_dict(spark, keep, best, digest_bits):
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    extra = {} if digest_bits is None else {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))}
    got = exact_dedup(docs, keep=keep, **extra).collect()
    assert sorted(map(tuple, got)) == expected(rows, best)


def test_empty_table_and_repeated_ids(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep="largest").collect()}
    assert got == {(5, 5, 3, True), (None, 5, 3, False), (None, None, 1, True)}


def test_levels_merge_to_one_run(spark):
    """Forty memtables, by twos and by the default, give what one dict does."""
    docs = spark.createDataFrame([(i, f"text {i % 70}") for i in range(400)], "doc_id long, text string").repartition(40)
    run = flush(docs, "doc_id", F.col("text"))
    assert run.select("run").distinct().count() > 1 << FAN_BITS
    want = sorted((min(range(k, 400, 70)), len(range(k, 400, 70))) for k in range(70))
    for fan_bits in (1, FAN_BITS):
        assert sorted((r.keep_id, r.group_size) for r in compact(run, fan_bits=fan_bits).collect()) == want


def test_filters_miss_nothing_at_any_size(spark):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    keys = rows.where("id % 5 = 0")
    for bits in (64, 1 << 12, None):
        found = {r.id for r in probe(rows, keys, bits).collect()}
        assert found >= set(range(0, 2000, 5))
    assert len(found) < 420 and probe(rows, keys.limit(0)).count() == 0
    assert filter_bits(0) <= filter_bits(10**6) < filter_bits(10**7) <= filter_bits(10**15) == 1 << MOST_BITS
    assert filter_of(keys, 1 << 16).count() <= 1024


def test_index_of_batches(spark):
    """Batches are found by probing each run, before and after compaction."""
    index, seen = MergeIndex(fan_bits=1), {}
    for batch in range(5):
        rows = [(100 * batch + i, f"Text {(7 * batch + i) % 23}") for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        asked = flush(docs, "doc_id", F.lower("text")).select("digest", "id")
        got = {r.id: (r.keep_id, r.group_size) for r in index.find(asked).collect()}
        assert got == {i: (min(seen[t]), len(seen[t])) for i, t in rows if t in seen}
        index.add(docs)
        for i, t in rows:
            seen.setdefault(t, []).append(i)
    assert [len(level) for level in index.levels] == [1, 0, 1]
