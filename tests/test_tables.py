import os

import pyarrow as pa
import pyarrow.feather
import pytest

from graftline.sources import tables as T


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.5)], "id long, probe_target string, v double")
    T.write_table(df.selectExpr("id", "'t' AS probe_target", "'w' AS `where`", "v"), f"{tmp_path}/p", ("probe_target", "where"))
    rows = T.predictions(spark, f"{tmp_path}/p", "t", "w", ["id", "v"])
    assert "PartitionFilters: [isnotnull" in rows._jdf.queryExecution().toString() and rows.count() == 2
    T.write_csv(df, f"{tmp_path}/c", "\t")
    assert T.annotations(spark, f"{tmp_path}/c", "id long, probe_target string, v double", ["id"]).count() == 2
    with pytest.raises(FileNotFoundError, match="intake"):
        T.required(spark, f"{tmp_path}/none", "intake")
    assert T.markdown(df) == "| id | probe_target | v |\n|---|---|---|\n| 1 | a | 2.000 |\n| 2 |  | 3.500 |"
    with pytest.raises(ValueError):
        T.markdown(df, 1)
    assert T.report(df, f"{tmp_path}/r").count("\n") == 1
    edges = spark.createDataFrame([(1, 2, 3, 9)], "a long, b long, n long, other long")
    edges.write.parquet(f"{tmp_path}/e")
    scan = T.edge_table(spark, f"{tmp_path}/e", "a", "b", "n")
    assert scan.columns == ["pre", "post", "w"] and "other" not in scan._jdf.queryExecution().executedPlan().toString()


def test_feather_vectors_probes_and_resume(spark, tmp_path):
    pyarrow.feather.write_feather(pa.table({"x": [1, 2], "y": ["a", None]}), f"{tmp_path}/f")
    assert [tuple(r) for r in T.feather(spark, f"{tmp_path}/f", ["y"]).collect()] == [("a",), (None,)]
    vec = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "e array<double>")
    assert T.checked_vectors(vec, "e", 2).dtypes == [("e", "array<float>")]
    with pytest.raises(ValueError):
        T.checked_vectors(vec, "e", 3)
    with pytest.raises(ValueError):
        T.checked_tokens(vec, 1, "e")
    T.write_probes(vec, {"k": 5}, f"{tmp_path}/b")
    assert T.read_probes(spark, f"{tmp_path}/b")[1] == {"k": 5}
    blocks = spark.range(4).toDF("block")
    done = []
    for n in (2, 4):
        out = T.resume(blocks.where(f"block < {n}"), spark, f"{tmp_path}/blocks", lambda b: (done.append(b.count()), b)[1])
        assert out.count() == n
    assert done == [2, 2]


def test_feather_files_of_a_folder(spark, tmp_path):
    for k in range(3):
        pyarrow.feather.write_feather(pa.table({"pre": [k, k + 1], "w": pa.array([1, None], pa.int32()), "name": ["x", None]}), tmp_path / f"{k}.feather", compression="lz4")
    got = T.feather(spark, str(tmp_path))
    assert dict(got.dtypes) == {"pre": "bigint", "w": "int", "name": "string"} and got.count() == 6
    assert sorted(r.pre for r in T.feather(spark, str(tmp_path), ["pre"]).collect()) == [0, 1, 1, 2, 2, 3]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    T.write_table(spark.range(5), path)
    T.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    with pytest.raises(Exception):
        T.write_table(spark.range(9).selectExpr("raise_error('no') AS x"), path)
    assert spark.read.parquet(path).count() == 7
    T.write_table(spark.read.parquet(path).where("id < 3"), path)  # from the table that it replaces
    assert spark.read.parquet(path).count() == 3
    assert [f for f in os.listdir(tmp_path) if f.startswith("t.old")] == []
