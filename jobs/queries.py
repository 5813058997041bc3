"""The jobs as queries: each runs twice into one new folder of the shared store and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graftline import registry
from graftline.plans.storage import shared_dir
from jobs import training_table, word_graph


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_word_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        word_graph.run(spark, f"{sf_dir}/documents*.parquet", out, f"{out}/checkpoint")
    return word_graph.output(spark, out)


def job2_training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        training_table.run(spark, f"{sf_dir}/lineitem.parquet", out)
    return registry.rounded(training_table.output(spark, out))


_MARKS = word_graph.LETTERS + word_graph.MARKS
_WORDS = f"""SELECT coalesce(nullif(lang, ''), 'unknown') AS volume, regexp_extract_all(translate(coalesce(text, ''), '{_MARKS}', '{word_graph.LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents"""
_JOB1 = f"""WITH words AS ({_WORDS}),
    e AS (SELECT volume, p.pre, p.post, count(*) AS w FROM (SELECT volume, unnest(list_transform(range(1, len(w)), lambda i: {{'pre': w[i], 'post': w[i + 1]}})) AS p FROM words) GROUP BY ALL),
    s AS (SELECT volume, pre AS i, post AS j, w, 1 AS sign FROM e UNION ALL SELECT volume, post, pre, w, -1 FROM e),
    n AS (SELECT volume, i, count(*) FILTER (sign < 0) AS n_in, count(*) FILTER (sign > 0) AS n_out, coalesce(sum(w) FILTER (sign < 0), 0)::BIGINT AS syn_in, coalesce(sum(w) FILTER (sign > 0), 0)::BIGINT AS syn_out FROM s GROUP BY ALL),
    t AS (SELECT volume, i, string_agg(j, ' ' ORDER BY r) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY volume, i ORDER BY w DESC, sign DESC, j) AS r FROM s) WHERE r <= {word_graph.DEFAULTS["k"]} GROUP BY ALL)
    SELECT 'edge' AS kind, volume, pre, post, w, NULL::BIGINT AS n_in, NULL::BIGINT AS n_out, NULL::BIGINT AS syn_in, NULL::BIGINT AS syn_out, NULL::VARCHAR AS tokens FROM e
    UNION ALL SELECT 'node', volume, i, NULL, NULL, n_in, n_out, syn_in, syn_out, tokens FROM n JOIN t USING (volume, i)"""


def _job2() -> str:
    graph = "(SELECT 's' || l_suppkey AS pre, 'p' || l_partkey AS post, count(*)::DOUBLE AS w FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL GROUP BY ALL)"
    names = registry.shape_columns()
    shape = registry.shape_sql(graph, show=lambda expression, name: f'{expression} AS "{name}"')
    recip = [f"local_recip_{k}_{s}" for s in ("out", "in") for k in ("frac", "wfrac")]
    near = [f"local_nbr_logdeg_{s}{k}" for s in ("out", "in") for k in ("", "_sd")]
    both = "(SELECT pre AS i, post AS j, w, 1 AS sign FROM g WHERE pre <> post UNION ALL SELECT post, pre, w, -1 FROM g WHERE pre <> post)"
    back = ", ".join(f"""coalesce(count(back) FILTER (side = '{s}') / nullif(count(*) FILTER (side = '{s}'), 0), 0) AS local_recip_frac_{s},
        coalesce(sum(w) FILTER (side = '{s}' AND back IS NOT NULL) / nullif(sum(w) FILTER (side = '{s}'), 0), 0) AS local_recip_wfrac_{s}""" for s in ("out", "in"))  # fmt: skip
    mean = ", ".join(f"coalesce(avg(x) FILTER (sign = {k}), 0) AS local_nbr_logdeg_{s}, coalesce(stddev_pop(x) FILTER (sign = {k}), 0) AS local_nbr_logdeg_{s}_sd" for s, k in (("out", 1), ("in", -1)))
    share = "(('0x' || substr(md5(id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    columns = [*names, *recip, *near]
    stats = ", ".join(f'avg("{c}") AS "m {c}", stddev_pop("{c}") AS "s {c}"' for c in columns)
    scaled = ", ".join(registry.r6(f'("{c}" - "m {c}") / greatest("s {c}", 1e-6)', c) for c in columns)
    return f"""WITH shape AS ({shape}), g AS (SELECT * FROM {graph}),
    r AS (SELECT a.pre, a.post, a.w, b.w AS back FROM g a LEFT JOIN g b ON a.pre = b.post AND a.post = b.pre WHERE a.pre <> a.post),
    back AS (SELECT id, {back} FROM (SELECT pre AS id, 'out' AS side, w, back FROM r UNION ALL SELECT post, 'in', w, back FROM r) GROUP BY id),
    d AS (SELECT i, ln(1 + count(*)) AS x FROM {both} GROUP BY i),
    near AS (SELECT s.i AS id, {mean} FROM {both} s JOIN d ON d.i = s.j GROUP BY s.i),
    f AS (SELECT shape.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*recip, *near])}, {share} AS u FROM shape LEFT JOIN back USING (id) LEFT JOIN near USING (id)),
    t AS (SELECT *, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM f)
    SELECT id, {scaled}, split FROM t, (SELECT {stats} FROM t WHERE split = 'train')"""


QUERIES = {"job1_word_graph": job1_word_graph, "job2_training_table": job2_training_table}
ORACLES = {"job1_word_graph": _JOB1, "job2_training_table": _job2()}
