"""The thin queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import lm_score
from graftline.llm.alignment import align
from graftline.llm.common import table
from graftline.llm.exact_dedup import exact_dedup
from graftline.llm.fingerprints import edited_fingerprints
from graftline.llm.html_text import main_text
from graftline.llm.mixing import mix
from graftline.llm.near_dedup import near_dedup
from graftline.llm.pieces import encode_decode
from graftline.llm.quality import classify, fit
from graftline.llm.substring_dedup import substring_dedup
from graftline.llm.token_counts import token_counts
from graftline.llm.url_filter import fitted, judge


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for row-by-row work; one that comes in fewer partitions than there are cores is dealt to all of them."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spread(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, fitted(pages))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spread(spark, sf_dir, "documents"), model_file(), also=())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spread(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spread(spark, sf_dir, "documents")).drop("n_factors")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm_score.score(docs, lm_score.fit(docs, labels.where("quality = 1 and toxic = 0").select("doc_id")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spread(spark, sf_dir, "documents"), model_file("byte_bpe_50k.json"), model_file())


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(spark, sf_dir, "documents"), model_file("word_bpe_49k.json"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_dedup": op2_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_lm_score": op10_lm_score,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_counts": op12_token_counts,
}

ORACLES = {
    "op2_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
        FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op7_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
        ), d AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1
        ), g AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM d
        ), l AS (
            SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id
        ), k AS (
            SELECT w.doc_id, w.w, coalesce(l.gone, []) AS gone FROM w LEFT JOIN l USING (doc_id)
        ), p AS (
            SELECT k.doc_id, string_agg(k.w[x.i], ' ' ORDER BY x.i) AS kept FROM k, unnest(range(1, len(k.w) + 1)) AS x(i)
            WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = k.doc_id AND g.p = x.i) GROUP BY k.doc_id
        )
        SELECT k.doc_id, len(k.w)::BIGINT AS n_words, len(k.gone)::BIGINT AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256
        FROM k LEFT JOIN p USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
