from pathlib import Path

from graftline.plans import storage
from graftline.plans.ordered import running_sums


def test_stored_tables_are_read_back_and_discarded(spark):
    storage.discard(spark)
    df = storage.stored(spark.range(5), "five")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    assert df.count() == 5 and list(folder.glob("five-*"))
    assert storage.discard(spark) == 1 and not list(folder.glob("five-*"))


def test_running_sums_over_ranges_and_groups(spark):
    rows = [(i * 37 % 101, "ab"[i % 2] if i % 7 else None, 1 + i % 3) for i in range(101)]
    df = spark.createDataFrame(rows, "v long, g string, n long")
    got = {(r.v, r.g): r.s for r in running_sums(df, "v", {"s": "n"}, ("g",), descending=True).collect()}
    assert got == {(v, g): sum(n for w, h, n in rows if h == g and w >= v) for v, g, _ in rows}
    assert running_sums(df.limit(0), "v", {"s": "n"}).count() == 0
