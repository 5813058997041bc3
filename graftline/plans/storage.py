"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has stored and not discarded.
_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session names none (tests), one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, stored; the tables that it has stored on the way are deleted."""
    begin = len(_KEPT)
    out = stored(make(), name)
    path = _KEPT.pop()
    discard(spark, begin)
    _KEPT.append(path)
    return out


def discard(spark: SparkSession, but: int = 0) -> int:
    """Deletes the stored tables of this process, but for so many of the first; results that read them must have been written. Returns their number."""
    n, conf = len(_KEPT) - but, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_KEPT) > but:
        path = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        discard(spark)
