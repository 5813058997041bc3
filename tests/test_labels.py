import pytest
from pyspark.sql import functions as F

from graftline.functions import labels as L

CASES = [
    ("acetylcholine; sNPF; acetylcholine, sNPF", "acetylcholine", ["acetylcholine"], False),
    ("gaba-negative", None, [], False),
    ("tyramine", None, [], False),
    ("GABA ; gaba", "gaba", ["gaba"], True),
    ("gaba, glutamate", None, ["gaba", "glutamate"], False),
    ("gaba; tyramine", "gaba", ["gaba"], False),
    ("gaba; mystery", "gaba", ["gaba"], True),
    (" ;, ", None, [], False),
    (None, None, [], False),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    for r in df.select("i", L.parse_label(F.col("t")).alias("p")).collect():
        assert (r.p.single, r.p.mentioned, r.p.clean) == CASES[r.i][1:]
    assert {(r.token, r.cells) for r in L.audit_tokens(df.unionByName(df), "t").collect()} == {("mystery", 1)}


def test_raw_text_decides_what_is_out_of_scope(spark):
    df = spark.createDataFrame([("tyramine-negative", "gaba", 0.5), ("histamine; gaba", "gaba", 0.5), (None, "gaba", 0.5)], "k string, p string, c double")
    got = [(r.nt_train, r.nt_train_source, r.nt_conf) for r in L.derive_label(df, "k", "p", "c").collect()]
    assert got == [(None, None, None), ("histamine", "known", None), ("gaba", "predicted", 0.5)]


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    assert [r.o for r in L.mapped(df.where("c IS NULL OR c = 'a'"), "c", {"a": None}, "o").collect()] == [None, None]
    with pytest.raises(Exception, match="no entry"):
        L.mapped(df, "c", {"a": "b"}, "o").collect()
    for f in (lambda: L.in_scope("x"), lambda: L.scope_mask("x"), lambda: L.weighted("x", F.lit(1))):
        with pytest.raises(ValueError):
            f()
    assert [r[0] for r in spark.createDataFrame([(13390.0,), (1.5,), (None,)], "v double").select(L.label_string(F.col("v"))).collect()] == ["13390", "1.5", None]
