"""What several operators share: word rules, shared storage and input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.plans.storage import shared_dir, stored  # noqa: F401  for the operators

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched; null stays null. Pure ASCII takes the vectorised path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of the input, whatever their names, cannot clash."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def sample_by_hash(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows of smallest hash of a column (ties by the column itself), or all rows if there are no more: a hash
    threshold leaves about twice as many, so that what is ordered doesn't grow with the table."""
    total = rows.count()
    h = F.xxhash64(column)
    if total > 2 * n:
        rows = rows.where(F.shiftrightunsigned(h, 32) < int(2**32 * 2 * n / total))
    return rows.orderBy(h, column).limit(n)
