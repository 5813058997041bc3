"""The corpus pipeline: quality, exact copies, near copies, source mix, tokens. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm.common import ascii_lower, stored, table
from graftline.llm.exact_dedup import exact_dedup
from graftline.llm.mixing import mix
from graftline.llm.near_dedup import near_dedup
from graftline.llm.pieces import encode_decode
from graftline.llm.quality import fit, keep_good
from graftline.llm.queries import model_file


def _free(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column of docs has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _of(docs: DataFrame, chosen: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs whose doc_id (null being one) is chosen, with the extra columns of the choice."""
    own = _free(docs, "_id")
    picked = chosen.select(F.col("doc_id").alias(own), *extra)
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked[own]), "inner" if extra else "left_semi").drop(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier, fitted on the labelled ones, scores 0.3 or more. Null and empty texts, which show nothing, all stay or all go; repeated rows share
    a fate; no row gives no row."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id (a null id only where there is no other); of rows that repeat it with an equal text, one. Null and empty texts are equal."""
    left = _of(docs, exact_dedup(docs, keep="largest").where("kept").select("doc_id").distinct())
    sha = _free(docs, "_sha")
    return left.withColumn(sha, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)).dropDuplicates(["doc_id", sha]).drop(sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id. Texts without words are near to nothing and stay, as rows with a null id do."""
    return _of(docs, near_dedup(docs).where("kept").select("doc_id").distinct())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those of which it takes nothing go, texts without words among them. Rows that repeat an id go together; a null source is one."""
    n = _free(docs, "_n")
    copies = F.expr("CAST(try_divide(taken, size) AS INT)").alias(n)
    taken = mix(docs).where("taken > 0").select("doc_id", copies).dropDuplicates(["doc_id"])
    return _of(docs, taken, (n,)).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, one row each; a null or empty text has the begin and end ids alone."""
    return encode_decode(docs, model_file(), also=("ids",)).drop("n_bytes", "covered_bytes")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("sentencepiece", tokens)]
#: The models and hashes of these stages are not SQL's; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
