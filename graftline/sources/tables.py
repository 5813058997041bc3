"""Sources and sinks (SRC1-14, SNK1-9): projections reach the scan, keys replace row order, commits are all or nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def edge_table(spark: SparkSession, path: str, pre: str, post: str, weight: str) -> DataFrame:
    """SRC1/SRC2: three columns of a Parquet edge table, under their common names; no other column is read."""
    return spark.read.parquet(path).select(F.col(pre).alias("pre"), F.col(post).alias("post"), F.col(weight).alias("w"))


def feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC5: Arrow (Feather) files, read whole file by whole file in the executors from any store that Spark reads; only the first file's schema reaches the driver."""
    import pyarrow as pa
    import pyarrow.feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def schemas(batches):
        for b in batches:
            for content in b.column("content"):
                yield pa.RecordBatch.from_pydict({"schema": [pa.feather.read_table(pa.BufferReader(content.as_buffer()), columns=columns, memory_map=False).schema.remove_metadata().serialize().to_pybytes()]})

    def rows(batches):
        for b in batches:
            for content in b.column("content"):
                yield from pa.feather.read_table(pa.BufferReader(content.as_buffer()), columns=columns, memory_map=False).to_batches(max_chunksize=65_536)

    first = files.limit(1).mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise FileNotFoundError(path)
    return files.mapInArrow(rows, from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(first[0])))))


def annotations(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """SRC3/SRC4: tab-separated text under a stated schema."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return df.select(*columns) if columns else df


def required(spark: SparkSession, path: str, how: str) -> DataFrame:
    """SRC6/SRC7: a table that must be there; how says what writes it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path} is missing; {how} writes it") from missing


def checked_vectors(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """SRC9/SRC10: fails unless the arrays have one length, and the table so many rows."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high or (rows is not None and n != rows):
        raise ValueError(f"{column}: {n} rows of {low} to {high} values")
    return df.withColumn(column, F.col(column).cast("array<float>"))


def checked_tokens(df: DataFrame, k: int, column: str = "tokens") -> DataFrame:
    """SRC9: fails where a node has more than k tokens."""
    (most,) = df.agg(F.max(F.size(column))).first()
    if most is not None and most > k:
        raise ValueError(f"{column}: {most} tokens, {k} at most")
    return df


def predictions(spark: SparkSession, path: str, target: str, where: str, columns: list[str]) -> DataFrame:
    """SRC13: rows of one target and place; on a table written by partitions they are all that is read."""
    df = spark.read.parquet(path)
    return df.where((F.col("probe_target") == target) & (F.col("where") == where)).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """SNK1/SNK2: a Parquet table, there as a whole or not at all: written beside its place and moved there, so that the table it replaces goes only when the new one is complete."""
    spark, path = df.sparkSession, path.rstrip("/")
    aside, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.partitionBy(*partition_by).parquet(aside)
    of = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(of(path)):
        fs.rename(of(path), of(old))
    if not fs.rename(of(aside), of(path)):
        raise OSError(f"{aside} could not be moved to {path}")
    fs.delete(of(old), True)
    spark.catalog.refreshByPath(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """SNK3/SNK7: compressed text with a header."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, compression="gzip")


def report(row_source: DataFrame, path: str | None = None) -> str:
    """SNK4: a report of few rows as JSON lines; written as text if a path is given."""
    lines = row_source.select(F.to_json(F.struct("*")).alias("value"))
    if path:
        lines.write.mode("overwrite").text(path)
    return "\n".join(r.value for r in lines.collect())


def markdown(df: DataFrame, most: int = 1000) -> str:
    """SNK6: a small table as markdown, floats to three places; more than most rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def resume(blocks: DataFrame, spark: SparkSession, path: str, compute, key: str = "block") -> DataFrame:
    """SNK8: computes and appends the blocks that the table lacks, and returns the whole table."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
        blocks = blocks.join(done, key, "left_anti")
    except AnalysisException:
        pass
    compute(blocks).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_probes(df: DataFrame, meta: dict, path: str) -> None:
    """SNK5/SRC12: a probe's arrays beside its description."""
    df.withColumn("meta", F.lit(json.dumps(meta, sort_keys=True))).write.mode("overwrite").parquet(path)


def read_probes(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    df = required(spark, path, "write_probes")
    meta = df.select("meta").first()
    return df.drop("meta"), json.loads(meta[0]) if meta else {}
