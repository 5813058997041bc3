"""The named queries over the test tables and the SQL that checks them.

Doubles are rounded to six places where engines may add in another order. Queries whose result SQL cannot express have no SQL;
tests hold them against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import arrays as A
from graftline.functions import labels as L
from graftline.functions import vocabulary as V
from graftline.operators import edges as E
from graftline.operators import features as X
from graftline.operators import flow, probes, scaling, scoring, slicing, splits, tokens
from graftline.operators.components import components
from graftline.plans.storage import stored
from graftline.sources import graphs as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "fea_connection_shape"
#: Places of an embedding.
_PLACES = 64


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS \"{name}\""


# --- edges and nodes ---------------------------------------------------------------------------------------------------

G1, G2, G3 = G.G1_SQL, G.G2_SQL, G.G3_SQL
SYM2 = f"(SELECT pre AS i, post AS j, w, 1 AS sign FROM {G2} UNION ALL SELECT post, pre, w, -1 FROM {G2})"
SYM1 = f"(SELECT pre AS i, post AS j, w, 1 AS sign FROM {G1} UNION ALL SELECT post, pre, w, -1 FROM {G1})"


@query("agg1_pair_sum", "SELECT l_suppkey AS pre, l_partkey + 1000000 AS post, count(*)::BIGINT AS w FROM lineitem GROUP BY ALL")
def _(spark, d):
    return E.aggregate_edges(G.bipartite_raw(spark, d))


@query("agg1_pair_verified", f"SELECT pre, post, w FROM {G1}")
def _(spark, d):
    return E.aggregate_edges(G.bipartite(spark, d), already_unique=True)


@query("src_event_graph", f"SELECT pre, post, w FROM {G2}")
def _(spark, d):
    return G.directed(spark, d)


@query("src_nation_graph", f"SELECT pre, post, w FROM {G3}")
def _(spark, d):
    return G.dense(spark, d)


@query("agg2_node_index", f"SELECT i AS source_id, row_number() OVER (ORDER BY i) - 1 AS node_id FROM (SELECT DISTINCT i FROM {SYM1})")
def _(spark, d):
    return E.node_index(E.node_ids(G.bipartite(spark, d)))


@query("joi2_renumbered", f"""WITH ids AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS n FROM (SELECT DISTINCT i FROM {SYM1}))
    SELECT a.n AS pre, b.n AS post, g.w FROM {G1} g JOIN ids a ON a.i = g.pre JOIN ids b ON b.i = g.post""")
def _(spark, d):
    g = G.bipartite(spark, d)
    return E.renumbered(g, E.node_index(E.node_ids(g)))


@query("joi11_induced", f"""WITH k AS (SELECT user_id AS i, row_number() OVER (ORDER BY user_id) - 1 AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 50))
    SELECT a.n AS pre, b.n AS post, g.w FROM {G2} g JOIN k a ON a.i = g.pre JOIN k b ON b.i = g.post""")
def _(spark, d):
    kept = _t(spark, d, "events").where("event_type = 'purchase' AND value > 50").select(F.col("user_id").alias("source_id"))
    return E.induced(G.directed(spark, d), kept)


@query("agg3_degree_table", f"""SELECT i AS id, count(*) FILTER (sign < 0) AS n_in, count(*) FILTER (sign > 0) AS n_out,
    coalesce(sum(w) FILTER (sign < 0), 0)::BIGINT AS syn_in, coalesce(sum(w) FILTER (sign > 0), 0)::BIGINT AS syn_out FROM {SYM1} GROUP BY i""")
def _(spark, d):
    return E.degree_table(G.bipartite(spark, d))


@query("agg3_degree_isolated", f"""SELECT c_custkey AS id, count(i) FILTER (sign < 0) AS n_in, count(i) FILTER (sign > 0) AS n_out,
    coalesce(sum(w) FILTER (sign < 0), 0)::BIGINT AS syn_in, coalesce(sum(w) FILTER (sign > 0), 0)::BIGINT AS syn_out FROM customer LEFT JOIN {SYM2} ON i = c_custkey GROUP BY 1""")
def _(spark, d):
    return E.degree_table(G.directed(spark, d), _t(spark, d, "customer").select(F.col("c_custkey").alias("source_id")))


@query("agg6_percentiles", f"SELECT {r6('quantile_cont(w, 0.75)', 'p75')}, {r6('quantile_cont(w, 0.9)', 'p90')} FROM {G3}")
def _(spark, d):
    return rounded(E.weight_percentiles(G.dense(spark, d)))


@query("agg20_check_graph", f"""SELECT 0::BIGINT AS null_ids, 0::BIGINT AS repeated_ids, 0::BIGINT AS null_ends, 0::BIGINT AS bad_weights, 0::BIGINT AS repeated_pairs,
    (SELECT count(*) FROM (SELECT DISTINCT i FROM {SYM2}) WHERE i NOT IN (SELECT c_custkey FROM customer)) AS ends_without_node""")
def _(spark, d):
    return E.check_graph(_t(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), G.directed(spark, d))


@query("joi12_reciprocal", f"SELECT a.pre, a.post, a.w, b.w AS w_back FROM {G2} a LEFT JOIN {G2} b ON a.pre = b.post AND a.post = b.pre")
def _(spark, d):
    return E.reciprocal(G.directed(spark, d))


@query("set3_symmetrised", f"SELECT i, j, w, sign FROM {SYM2}")
def _(spark, d):
    return E.symmetrised(G.directed(spark, d))


# --- features ----------------------------------------------------------------------------------------------------------


def shape_columns() -> list[str]:
    """The degree and connection-shape columns, in the order of the SQL."""
    return [c for side in ("out", "in") for c in (*(f"logD{side}@{t}" for t in X.FLOORS), f"logSyn{side.title()}", *(f"{s}_{side}" for s in X.SHAPES))]


def shape_sql(graph: str, degrees: bool = True, show=r6) -> str:
    out = []
    for side, key in (("out", "pre"), ("in", "post")):
        n = f"greatest(coalesce(n_{side}, 0), 1)"
        g = lambda k, side=side: f"coalesce({k}_{side}, 0)"
        mean = f"({g('s')} / {n})"
        floor = f"greatest({g('s')}, 1e-9)"
        if degrees:
            out += [show(f"ln(1 + {g(f't{t}')})", f"logD{side}@{t}") for t in X.FLOORS] + [show(f"ln(1 + {g('s')})", f"logSyn{side.title()}")]
        sd = f"sqrt(greatest({g('ss')} / {n} - {mean} * {mean}, 0))"
        shape = (f"{g('one')} / {n}", f"{g('p75')} / {n}", f"{g('p90')} / {n}", f"ln(1 + {mean})", f"{sd} / greatest({mean}, 1e-9)", f"{g('ss')} / ({floor} * {floor})", f"{g('m')} / {floor}", f"{g('l')} / {n}")
        out += [show(e, f"{s}_{side}") for s, e in zip(X.SHAPES, shape, strict=True)]
    sums = lambda key, side: f"""(SELECT {key} AS id, count(*)::DOUBLE AS n_{side}, sum(w)::DOUBLE AS s_{side}, sum(w * w)::DOUBLE AS ss_{side}, max(w)::DOUBLE AS m_{side}, sum(ln(1 + w)) AS l_{side},
        count(*) FILTER (w = 1)::DOUBLE AS one_{side}, count(*) FILTER (w >= p75)::DOUBLE AS p75_{side}, count(*) FILTER (w >= p90)::DOUBLE AS p90_{side},
        count(*) FILTER (w >= 1)::DOUBLE AS t1_{side}, count(*) FILTER (w >= 3)::DOUBLE AS t3_{side}, count(*) FILTER (w >= 5)::DOUBLE AS t5_{side} FROM g, p GROUP BY 1)"""  # noqa: E731
    return f"""WITH g AS (SELECT * FROM {graph}), p AS (SELECT quantile_cont(w, 0.75) AS p75, quantile_cont(w, 0.9) AS p90 FROM g)
    SELECT id, {', '.join(out)} FROM {sums('pre', 'out')} FULL JOIN {sums('post', 'in')} USING (id)"""


@query("fea_connection_shape", shape_sql(G1))
def _(spark, d):
    return rounded(X.connection_features(G.bipartite(spark, d)))


@query("fea_connection_shape_events", shape_sql(G2))
def _(spark, d):
    return rounded(X.connection_features(G.directed(spark, d)))


@query("fea_l1_reciprocity", f"""WITH g AS (SELECT a.pre, a.post, a.w, b.w AS back FROM {G2} a LEFT JOIN {G2} b ON a.pre = b.post AND a.post = b.pre WHERE a.pre <> a.post),
    s AS (SELECT pre AS id, 'out' AS side, w, back FROM g UNION ALL SELECT post, 'in', w, back FROM g)
    SELECT id, {', '.join(f"round(coalesce(count(back) FILTER (side = '{s}') / nullif(count(*) FILTER (side = '{s}'), 0), 0), 6) + 0.0 AS local_recip_frac_{s}, round(coalesce(sum(w) FILTER (side = '{s}' AND back IS NOT NULL) / nullif(sum(w) FILTER (side = '{s}'), 0), 0), 6) + 0.0 AS local_recip_wfrac_{s}" for s in ('out', 'in'))} FROM s GROUP BY id""")
def _(spark, d):
    return rounded(X.reciprocity(G.directed(spark, d)))


@query("fea_l4_partner_degree", f"""WITH s AS (SELECT * FROM {SYM2} WHERE i <> j), x AS (SELECT i, ln(1 + count(*)) AS x FROM s GROUP BY i)
    SELECT s.i AS id, {', '.join(f"round(coalesce(avg(x) FILTER (sign = {k}), 0), 6) + 0.0 AS local_nbr_logdeg_{n}, round(coalesce(stddev_pop(x) FILTER (sign = {k}), 0), 6) + 0.0 AS local_nbr_logdeg_{n}_sd" for n, k in (('out', 1), ('in', -1)))}
    FROM s JOIN x ON x.i = s.j GROUP BY s.i""")
def _(spark, d):
    return rounded(X.partner_degree(stored(G.directed(spark, d), "event-graph")))  # degrees and both ends read it


@query("fea_l8_triangles", f"""WITH e AS (SELECT pre, post FROM {G2} WHERE pre <> post), u AS (SELECT pre AS i, post AS j FROM e UNION SELECT post, pre FROM e),
    d AS (SELECT i, count(*) AS d FROM u GROUP BY i),
    c AS (SELECT a.pre AS i, count(*) AS n FROM e a JOIN e b ON a.post = b.pre JOIN e c ON b.post = c.pre AND c.post = a.pre GROUP BY 1),
    t AS (SELECT a.pre AS i, count(*) AS n FROM e a JOIN e b ON a.post = b.pre JOIN e c ON c.pre = a.pre AND c.post = b.post GROUP BY 1),
    k AS (SELECT a.i, count(*) AS n FROM u a JOIN u b ON a.j = b.i JOIN u c ON b.j = c.i AND c.j = a.i GROUP BY 1)
    SELECT d.i AS id, {r6('CASE WHEN d > 1 THEN coalesce(c.n, 0) / (d * (d - 1)) ELSE 0 END', 'local_tri_cycle_frac')}, {r6('CASE WHEN d > 1 THEN coalesce(t.n, 0) / (d * (d - 1)) ELSE 0 END', 'local_tri_trans_frac')},
    {r6('CASE WHEN d > 1 THEN coalesce(k.n, 0) / (d * (d - 1)) ELSE 0 END', 'local_clust_coef')}, {r6('ln(1 + coalesce(k.n, 0) / 2)', 'local_log_tri_undirected')} FROM d LEFT JOIN c USING (i) LEFT JOIN t USING (i) LEFT JOIN k USING (i)""")
def _(spark, d):
    return rounded(X.triangles(G.directed(spark, d)))


def _core_sql(graph: str, rounds: int = 80) -> str:
    """The h-index of the neighbours' values, so often that nothing changes any more."""
    return f"""WITH RECURSIVE u AS (SELECT pre AS i, post AS j FROM {graph} WHERE pre <> post UNION SELECT post, pre FROM {graph} WHERE pre <> post), d AS (SELECT i, count(*) AS d FROM u GROUP BY i),
    c AS (SELECT 0 AS step, i, d AS h FROM d UNION ALL SELECT step + 1, i, max(least(h, r)) FROM (SELECT c.step, u.i, c.h, row_number() OVER (PARTITION BY u.i ORDER BY c.h DESC) AS r FROM c JOIN u ON u.j = c.i WHERE c.step < {rounds}) GROUP BY step, i)
    SELECT i AS id, h AS core, {r6('ln(1 + h)', 'local_log_kcore')}, {r6('h / d', 'local_kcore_frac')} FROM c JOIN d USING (i) WHERE step = {rounds}"""


@query("fea_l3_kcore", _core_sql(G1))
def _(spark, d):
    return rounded(X.core_numbers(G.bipartite(spark, d)))


_WALK = "a AS (SELECT i, j, sum(w)::DOUBLE AS a FROM {sym} GROUP BY ALL), t AS (SELECT i, sum(a) AS t FROM a GROUP BY i), s AS (SELECT a.i, a.j, a.a / sqrt(x.t * y.t) AS s FROM a JOIN t x ON x.i = a.i JOIN t y ON y.i = a.j)"
SYM3 = f"(SELECT pre AS i, post AS j, w FROM {G3} UNION ALL SELECT post, pre, w FROM {G3})"


@query("fea_r_walk_2_3", f"""WITH {_WALK.format(sym=SYM3)}, b AS (SELECT i, sum(s * s) AS p FROM s GROUP BY i),
    c AS (SELECT x.i, sum(x.s * y.s * z.s) AS p FROM s x JOIN s y ON x.j = y.i JOIN s z ON y.j = z.i AND z.j = x.i GROUP BY x.i)
    SELECT b.i AS id, {r6('b.p', 'rwse_2')}, {r6('coalesce(c.p, 0)', 'rwse_3')} FROM b LEFT JOIN c USING (i)""")
def _(spark, d):
    return rounded(X.return_probabilities_sql(G.dense(spark, d)))


def _walks_sql(sym: str, show: str = "coalesce(({p}), 0)") -> str:
    part = lambda x, y: show.format(p=f"SELECT sum(x.s * y.s) FROM {x} x JOIN {y} y ON x.i = y.i AND x.j = y.j WHERE x.i = n.i")
    return f"""WITH {_WALK.format(sym=sym)}, s2 AS (SELECT x.i, y.j, sum(x.s * y.s) AS s FROM s x JOIN s y ON x.j = y.i GROUP BY ALL),
    s3 AS (SELECT x.i, y.j, sum(x.s * y.s) AS s FROM s2 x JOIN s y ON x.j = y.i GROUP BY ALL), s4 AS (SELECT x.i, y.j, sum(x.s * y.s) AS s FROM s3 x JOIN s y ON x.j = y.i GROUP BY ALL),
    n AS (SELECT DISTINCT i FROM s)
    SELECT n.i AS id, {', '.join(r6(part(x, y), f'rwse_{k}') for k, x, y in ((2, 's', 's'), (3, 's', 's2'), (4, 's2', 's2'), (5, 's2', 's3'), (6, 's3', 's3'), (7, 's3', 's4'), (8, 's4', 's4')))} FROM n"""


_WALK_FEATURES = _walks_sql(SYM2, "ln(1 + 10000 * coalesce(({p}), 0))")


@query("fea_r_walk_8", _walks_sql(SYM3))
def _(spark, d):
    return rounded(X.return_probabilities(G.dense(spark, d))).drop("rwse_1")


@query("fea_r_walk_8_joined", _walks_sql(SYM3))
def _(spark, d):
    return rounded(X.return_probabilities(G.dense(spark, d), most_entries=0, parts=2)).drop("rwse_1")


@query("fea_rt_walk_features", _WALK_FEATURES)
def _(spark, d):
    return rounded(X.walk_features(X.return_probabilities(G.directed(spark, d))))


@query("agg21_components", f"""WITH RECURSIVE u AS (SELECT pre AS i, post AS j FROM {G1} UNION SELECT post, pre FROM {G1}),
    c AS (SELECT DISTINCT 0 AS step, i, i AS m FROM u UNION ALL SELECT step + 1, i, min(m) FROM (SELECT c.step, u.i, c.m FROM c JOIN u ON u.j = c.i WHERE c.step < 24 UNION ALL SELECT step, i, m FROM c WHERE step < 24) GROUP BY step, i)
    SELECT i AS id, m AS component_id FROM c WHERE step = 24""")
def _(spark, d):
    return components(G.bipartite(spark, d), "pre", "post")


def _nodes(edges: DataFrame) -> DataFrame:
    return E.node_ids(edges).toDF("id")


_WEIGHT = {"binary": "1.0::DOUBLE", "raw": "w::DOUBLE", "log1p": "ln(1 + w)"}


def _flow_sql(graph: str, weighting: str, alpha: float = 0.0, steps: int = 150, share: float = 0.8) -> str:
    """(i, x) of a connected graph by damped Jacobi steps. The solution adds up to zero, so every entry of the system may have the mean weight
    added, without which the steps would be slow to find that sum; with alpha the sign is that of a rank."""
    return f"""(WITH RECURSIVE g AS (SELECT pre, post, {_WEIGHT[weighting]} AS w FROM {graph} WHERE pre <> post),
    d AS (SELECT i, sum(w) AS d, {-1 if alpha else 1} * sum(b) AS b FROM (SELECT post AS i, w, w AS b FROM g UNION ALL SELECT pre, w, -w FROM g) GROUP BY i),
    e AS (SELECT i, j, sum(w) AS v FROM (SELECT pre AS i, post AS j, w FROM g UNION ALL SELECT post, pre, w FROM g) GROUP BY ALL),
    c AS (SELECT sum(d) / (count(*) * count(*)) AS c FROM d), f AS (SELECT i, d + {alpha}::DOUBLE + c AS d, b FROM d, c),
    m AS (SELECT i.i, j.i AS j, CASE WHEN i.i = j.i THEN 1 - {share}::DOUBLE ELSE {share}::DOUBLE * (coalesce(v, 0) - c) / i.d END AS v FROM f i CROSS JOIN f j CROSS JOIN c LEFT JOIN e ON e.i = i.i AND e.j = j.i),
    x AS (SELECT 0 AS step, i, 0.0::DOUBLE AS x FROM f
        UNION ALL SELECT x.step + 1, m.i, sum(m.v * x.x) + any_value({share}::DOUBLE * f.b / f.d) FROM x JOIN m ON m.j = x.i JOIN f ON f.i = m.i WHERE x.step < {steps} GROUP BY x.step, m.i)
    SELECT i, x FROM x WHERE step = {steps})"""


@query("fea_f1_trophic", f"SELECT i AS id, {r6('x', 'trophic_log1p')} FROM {_flow_sql(G2, 'log1p')}")
def _(spark, d):
    g = G.directed(spark, d)
    return rounded(flow.trophic_levels(g, _nodes(g), "log1p", rtol=1e-12)[0])


@query("fea_f2_springrank", f"SELECT i AS id, {r6('x', 'springrank_log1p_a1')} FROM {_flow_sql(G2, 'log1p', 1.0)}")
def _(spark, d):
    g = G.directed(spark, d)
    return rounded(flow.springrank(g, _nodes(g), 1.0, rtol=1e-12)[0])


_FLOWS = {f"trophic_{w}": _flow_sql(G3, w) for w in flow.WEIGHTINGS} | {f"springrank_log1p_a{a:g}": _flow_sql(G3, "log1p", a) for a in flow.ALPHAS if a}


@query("fea_f6_flow_block", f"""WITH {', '.join(f'f{k} AS {sql}' for k, sql in enumerate(_FLOWS.values()))}
    SELECT f0.i AS id, (SELECT min(i) FROM f0) AS component, {', '.join(r6(f'f{k}.x', c) for k, c in enumerate(_FLOWS))} FROM f0 {' '.join(f'JOIN f{k} USING (i)' for k in range(1, len(_FLOWS)))}""")
def _(spark, d):
    g = stored(G.dense(spark, d), "nation-graph")
    return rounded(flow.flow_block(g, _nodes(g))[0])


@query("fea_f5_incoherence", f"SELECT {r6('sum(w * pow(post / 1000.0 - pre / 1000.0 - 1, 2)) / sum(w)', 'incoherence')} FROM {G2}")
def _(spark, d):
    g = G.directed(spark, d)
    return rounded(flow.incoherence(g, _nodes(g).withColumn("h", F.col("id") / 1000.0), "raw", "h"))


@query("fea_x_correlations", """WITH r AS (SELECT c_acctbal AS x, length(c_name) + c_nationkey AS y FROM customer),
    k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
    SELECT count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(corr(rx, ry) * sqrt((count(*) - 2) / (1 - corr(rx, ry) * corr(rx, ry))), 6) + 0.0 AS t FROM k""")
def _(spark, d):
    return rounded(X.correlations(_t(spark, d, "customer").select("c_acctbal", (F.length("c_name") + F.col("c_nationkey")).alias("y")), "c_acctbal", "y"))


@query("fea_y_explained", "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem")
def _(spark, d):
    return rounded(spark.createDataFrame([(X.explained_by(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]),)], "r2 double"))


@query("fea_z_redundancy")
def _(spark, d):
    f = X.connection_features(G.bipartite(spark, d))
    return rounded(spark.createDataFrame(X.redundancy_filter(f, f.columns[1:]), "column string, r2 double"))


def _flows(g: DataFrame) -> DataFrame:
    return flow.levels(g, _nodes(g), {"trophic_log1p": ("log1p", 1, 0.0), "springrank_log1p_a1": ("log1p", -1, 1.0)}, rtol=1e-12)[0]


@query("fea_a_assembled", f"""SELECT id, coalesce(COLUMNS(* EXCLUDE (id)), 0) FROM (SELECT DISTINCT i AS id FROM {SYM2}) LEFT JOIN ({shape_sql(G2)}) USING (id) LEFT JOIN ({ORACLES['fea_l1_reciprocity']}) USING (id)
    LEFT JOIN ({ORACLES['fea_l4_partner_degree']}) USING (id) LEFT JOIN ({ORACLES['fea_l8_triangles']}) USING (id) LEFT JOIN (SELECT * EXCLUDE (core) FROM ({_core_sql(G2)})) USING (id) LEFT JOIN ({_WALK_FEATURES}) USING (id)
    LEFT JOIN ({ORACLES['fea_f1_trophic']}) USING (id) LEFT JOIN ({ORACLES['fea_f2_springrank']}) USING (id)""")
def _(spark, d):
    g = stored(G.directed(spark, d), "event-graph")  # eight blocks read it
    return rounded(X.assemble(_nodes(g), X.connection_features(g), X.reciprocity(g), X.partner_degree(g), X.triangles(g), X.core_numbers(g).drop("core"), X.walk_features(X.return_probabilities(g)), _flows(g)))


# --- tokens ------------------------------------------------------------------------------------------------------------


@query("top1_partners", f"""SELECT i AS id, (r - 1)::INT AS rank, j AS partner, {r6('ln(1 + w)', 'weight')}, sign FROM
    (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, sign DESC, j) AS r FROM {SYM1}) WHERE r <= 16""")
def _(spark, d):
    return rounded(tokens.top_partners(stored(G.bipartite(spark, d), "pairs"), 16))  # no task both adds up pairs and sorts them


@query("top2_token_stats", f"""WITH n AS (SELECT i, count(*) AS d FROM {SYM2} GROUP BY i)
    SELECT quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, quantile_cont(d, 0.99) AS p99, max(d) AS most, {r6('count(*) FILTER (d > 64) / (count(*) + 10)', 'truncated_share')},
    {r6('sum(least(d, 64)) / sum(d)', 'kept_share')}, 10::BIGINT AS isolated, {r6('sum(least(d, 64)) / ((count(*) + 10) * 64)', 'fill')} FROM n""")
def _(spark, d):
    g = G.directed(spark, d)
    return rounded(tokens.token_stats(g, _nodes(g).count() + 10))


@query("agg18_composition", f"""WITH p AS (SELECT p_partkey + 1000000 AS j, CASE WHEN p_size % 3 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS label FROM part),
    m AS (SELECT i, CASE WHEN sign > 0 THEN 'out' ELSE 'in' END AS side, w, coalesce(label, 'unknown') AS label FROM {SYM1} LEFT JOIN p USING (j))
    SELECT i AS id, side, {', '.join(f"round(coalesce(sum(w) FILTER (label = '{c}'), 0) / sum(w), 6) + 0.0 AS \"{c}\"" for c in ('ECONOMY', 'PROMO'))},
    {r6("coalesce(sum(w) FILTER (label NOT IN ('ECONOMY', 'PROMO')), 0) / sum(w)", 'unknown')} FROM m GROUP BY ALL""")
def _(spark, d):
    return _composition(spark, d)


def _composition(spark, d) -> DataFrame:
    part = _t(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("id"), F.when(F.col("p_size") % 3 != 0, F.split("p_type", " ")[0]).alias("label"))
    return rounded(tokens.composition(G.bipartite(spark, d), part, ["ECONOMY", "PROMO"]))


@query("nn8_mean_in", f"SELECT post AS id, {r6('sum(w * x) / sum(w)', 'x')}, {r6('sum(w * y) / sum(w)', 'y')} FROM {G2} g JOIN (SELECT user_id AS u, avg(value) AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1) f ON u = pre GROUP BY 1")
def _(spark, d):
    f = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(tokens.propagate(G.directed(spark, d), f, ["x", "y"], "mean", "in", "w"))


@query("nn8_sum_out", f"SELECT pre AS id, {r6('sum(y)', 'y')} FROM {G2} g JOIN (SELECT user_id AS u, count(*)::DOUBLE AS y FROM events GROUP BY 1) f ON u = post GROUP BY 1")
def _(spark, d):
    f = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(tokens.propagate(G.directed(spark, d), f, ["y"], "sum", "out"))


@query("nn10_attention", f"SELECT post AS id, {r6('sum(exp(w - m) * y) / sum(exp(w - m))', 'y')} FROM {G2} g JOIN (SELECT post, max(w) AS m FROM {G2} GROUP BY 1) USING (post) JOIN (SELECT user_id AS u, count(*)::DOUBLE AS y FROM events GROUP BY 1) f ON u = pre GROUP BY 1")
def _(spark, d):
    f = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(tokens.attention(G.directed(spark, d), "w", f, ["y"]))


_GNN = "h AS (SELECT user_id AS id, avg(value) / 50 AS h0, count(*) / 100.0::DOUBLE AS h1 FROM events GROUP BY 1)"


def _near(graph: str, of: str, how: str) -> str:
    return f"(SELECT post AS id, {how}(h0) AS n0, {how}(h1) AS n1 FROM {graph} JOIN {of} ON {of}.id = pre GROUP BY 1)"


_SAGE = {"own": [[0.5, -0.25], [0.125, 1.0]], "near": [[0.25, 0.5], [-1.0, 0.75]], "bias": [0.1, -0.2]}
_GIN = {"weights": [[0.01, -0.02], [0.005, 0.01]], "bias": [0.3, 0.0], "eps": 0.5}
_NORM = [(0.5, 2.0, 1.5, 0.1), (0.25, 0.5, 1.0, 0.0)]
_SAGE_SQL = ["0.5 * h0 - 0.25 * h1 + 0.25 * coalesce(n0, 0) + 0.5 * coalesce(n1, 0) + 0.1", "0.125 * h0 + h1 - coalesce(n0, 0) + 0.75 * coalesce(n1, 0) - 0.2"]
_GIN_SQL = ["0.01 * (1.5 * h0 + coalesce(n0, 0)) - 0.02 * (1.5 * h1 + coalesce(n1, 0)) + 0.3", "0.005 * (1.5 * h0 + coalesce(n0, 0)) + 0.01 * (1.5 * h1 + coalesce(n1, 0))"]


def _user_features(spark, d) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((F.avg("value") / 50).alias("h0"), (F.count(F.lit(1)) / 100.0).alias("h1"))


@query("nn10_sage_layer", f"WITH {_GNN} SELECT id, {', '.join(r6(f'greatest({e}, 0)', f'h{k}') for k, e in enumerate(_SAGE_SQL))} FROM h LEFT JOIN {_near(G2, 'h', 'avg')} USING (id)")
def _(spark, d):
    return rounded(tokens.sage_layer(G.directed(spark, d), _user_features(spark, d), **_SAGE))


@query("nn10_gin_layer", f"WITH {_GNN} SELECT id, {', '.join(r6(f'greatest({e}, 0)', f'h{k}') for k, e in enumerate(_GIN_SQL))} FROM h LEFT JOIN {_near(G2, 'h', 'sum')} USING (id)")
def _(spark, d):
    return rounded(tokens.gin_layer(G.directed(spark, d), _user_features(spark, d), **_GIN))


@query("nn11_gnn_stack", f"""WITH {_GNN}, a AS (SELECT id, {', '.join(f'greatest((({e}) - {m}) / {v} * {g} + {b}, 0) AS h{k}' for k, (e, (m, v, g, b)) in enumerate(zip(_SAGE_SQL, _NORM, strict=True)))} FROM h LEFT JOIN {_near(G2, 'h', 'avg')} USING (id))
    SELECT id, {', '.join(r6(f'greatest({e}, 0)', f'h{k}') for k, e in enumerate(_GIN_SQL))} FROM a LEFT JOIN {_near(G2, 'a', 'sum')} USING (id)""")
def _(spark, d):
    return rounded(tokens.gnn_forward(G.directed(spark, d), _user_features(spark, d), [{"kind": "sage", "norm": _NORM, **_SAGE}, {"kind": "gin", **_GIN}]))


_DIR_SAGE = _SAGE | {"near_out": [[-0.5, 0.25], [0.75, 0.125]]}
_DIR_GIN = _GIN | {"weights_out": [[0.005, 0.02], [-0.01, 0.0]], "eps_out": -0.25}
_GAT = {"own": [[0.5, -0.25], [0.125, 1.0]], "bias": [0.1, -0.2], "sides": {
    "in": {"lin": [[1.0, 0.5], [-0.5, 0.25]], "src": [[0.75], [-1.0]], "dst": [[0.5], [2.0]], "weight": [0.25, -0.5]},
    "out": {"lin": [[0.25, -1.0], [0.5, 0.5]], "src": [[-0.5], [1.5]], "dst": [[1.0], [-0.75]], "weight": [0.0, 1.0]}}}
_OUT_SIDE = lambda how: f"(SELECT pre AS id, {how}(h0) AS o0, {how}(h1) AS o1 FROM {G2} JOIN h ON h.id = post GROUP BY 1)"


def _gat_sql(direction: str) -> str:
    w, (partner, own) = _GAT["sides"][direction], ("pre", "post") if direction == "in" else ("post", "pre")
    lin = lambda t, k: f"({w['lin'][k][0]} * {t}.h0 + {w['lin'][k][1]} * {t}.h1)"
    raw = lambda k: f"({w['src'][k][0]} * {lin('p', k)} + {w['dst'][k][0]} * {lin('o', k)} + {w['weight'][k]} * ln(1 + w))"
    rows = f"SELECT {own} AS id, {', '.join(f'{lin(chr(112), k)} AS x{k}, greatest({raw(k)}, 0.2 * {raw(k)}) AS e{k}' for k in (0, 1))} FROM {G2} JOIN h p ON p.id = {partner} JOIN h o ON o.id = {own}"
    tops = f"SELECT *, max(e0) OVER (PARTITION BY id) AS m0, max(e1) OVER (PARTITION BY id) AS m1 FROM ({rows})"
    return f"(SELECT id, {', '.join(f'sum(exp(e{k} - m{k}) * x{k}) / sum(exp(e{k} - m{k})) AS {direction}{k}' for k in (0, 1))} FROM ({tops}) GROUP BY 1)"


@query("nn10_dir_sage_layer", f"WITH {_GNN} SELECT id, {r6('greatest(' + _SAGE_SQL[0] + ' - 0.5 * coalesce(o0, 0) + 0.25 * coalesce(o1, 0), 0)', 'h0')}, {r6('greatest(' + _SAGE_SQL[1] + ' + 0.75 * coalesce(o0, 0) + 0.125 * coalesce(o1, 0), 0)', 'h1')} FROM h LEFT JOIN {_near(G2, 'h', 'avg')} USING (id) LEFT JOIN {_OUT_SIDE('avg')} USING (id)")
def _(spark, d):
    return rounded(tokens.sage_layer(G.directed(spark, d), _user_features(spark, d), **_DIR_SAGE))


@query("nn10_dir_gin_layer", f"WITH {_GNN} SELECT id, {r6('greatest(' + _GIN_SQL[0] + ' + 0.005 * (0.75 * h0 + coalesce(o0, 0)) + 0.02 * (0.75 * h1 + coalesce(o1, 0)), 0)', 'h0')}, {r6('greatest(' + _GIN_SQL[1] + ' - 0.01 * (0.75 * h0 + coalesce(o0, 0)), 0)', 'h1')} FROM h LEFT JOIN {_near(G2, 'h', 'sum')} USING (id) LEFT JOIN {_OUT_SIDE('sum')} USING (id)")
def _(spark, d):
    return rounded(tokens.gin_layer(G.directed(spark, d), _user_features(spark, d), **_DIR_GIN))


@query("nn10_dir_gat_layer", f"WITH {_GNN} SELECT id, {r6('greatest(0.5 * h0 - 0.25 * h1 + 0.1 + coalesce(in0, 0) + coalesce(out0, 0), 0)', 'h0')}, {r6('greatest(0.125 * h0 + h1 - 0.2 + coalesce(in1, 0) + coalesce(out1, 0), 0)', 'h1')} FROM h LEFT JOIN {_gat_sql('in')} USING (id) LEFT JOIN {_gat_sql('out')} USING (id)")
def _(spark, d):
    return rounded(tokens.gat_layer(G.directed(spark, d), _user_features(spark, d), **_GAT))


@query("nn4_displacement", f"SELECT vec_id AS id, {', '.join(r6(f'embedding[{k + 1}]::DOUBLE - embedding[{64 - k}]::DOUBLE', f'x{k}') for k in range(_PLACES))} FROM embeddings")
def _(spark, d):
    from graftline.operators.encoder import displacement

    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    moved = displacement(e, e.withColumn("embedding", F.reverse("embedding")))
    return rounded(moved.select("id", *(F.col("embedding")[k].alias(f"x{k}") for k in range(_PLACES))))


@query("nn1_nn5_untrained_embedding")
def _(spark, d):
    from graftline.operators.encoder import embed, random_weights

    g = G.dense(spark, d)
    f = X.connection_features(g)
    scaled = scaling.apply_scale(f, scaling.fit_scale(f, f.columns[1:]), f.columns[1:])
    packed = scaled.select("id", F.array(*(F.col(f"`{c}`") for c in f.columns[1:])).alias("x"))
    sets = tokens.gather(tokens.token_arrays(tokens.top_partners(g, 8)), packed)
    return embed(sets, random_weights(len(f.columns) - 1, 32, 4, 2, 7), 8)


#: Columns of connection_features.
_SET_COLUMNS = 24


def _class_sets(spark, d) -> DataFrame:
    """Users' token sets over the event graph, with a class of their commonest event type."""
    g = G.directed(spark, d)
    f = X.connection_features(g)
    scaled = scaling.apply_scale(f, scaling.fit_scale(f, f.columns[1:]), f.columns[1:])
    packed = scaled.select("id", F.array(*(F.col(f"`{c}`") for c in f.columns[1:])).alias("x"))
    classes = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.pmod(F.crc32(F.mode("event_type", True)), F.lit(5)).cast("int").alias("code"))
    return tokens.gather(tokens.token_arrays(tokens.top_partners(g, 16)), packed).join(classes, "id")


@query("nn7_target_stats")
def _(spark, d):
    from graftline.operators import encoder, training

    sets = _class_sets(spark, d)
    stats = training.target_stats(sets, encoder.random_weights(_SET_COLUMNS, 32, 4, 2, 5), 16)
    return rounded(spark.createDataFrame([stats]))


@query("nn6_training_curve")
def _(spark, d):
    """As many steps as two epochs have, eight at least."""
    from graftline.operators import encoder, training

    sets = stored(_class_sets(spark, d), "class-sets")
    steps = max(8, -(-2 * sets.count() // 1024))
    done = training.train(sets, encoder.random_weights(_SET_COLUMNS, 32, 4, 2, 5), 16, steps, rate=0.003)
    return rounded(spark.createDataFrame([(c["step"], c["loss"], done["stats"]["constant_predictor_loss"]) for c in done["curve"]], "step int, loss double, constant_predictor_loss double"))


# --- label text and label columns ------------------------------------------------------------------------------------------

#: Label text made from the orders: names of the vocabulary and others, by remainders of the key.
_TEXT = "concat_ws('; ', {a}, {b}, {c})"
_A = "CASE o_orderkey % 5 WHEN 0 THEN 'Acetylcholine' WHEN 1 THEN 'gaba , sNPF' WHEN 2 THEN 'glutamate' WHEN 3 THEN 'tyramine' ELSE '' END"
_B = "CASE o_custkey % 4 WHEN 0 THEN 'acetylcholine' WHEN 1 THEN 'gaba-negative' WHEN 2 THEN 'mystery' ELSE 'unknown' END"
_C = "CASE WHEN o_custkey % 7 = 0 THEN 'histamine' WHEN o_custkey % 7 = 1 THEN 'odd, ' END"


def _label_rows(spark, d) -> DataFrame:
    text = F.expr(_TEXT.format(a=_A, b=_B, c=_C))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, text).alias("known"), F.expr("CASE WHEN o_custkey % 3 = 0 THEN 'dopamine' WHEN o_custkey % 3 = 1 THEN 'gaba' END").alias("top"), (F.col("o_custkey") % 100 / 100.0).alias("conf"), F.expr("CASE o_custkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'M' WHEN 3 THEN 'na' END").alias("side"))


_ROWS = f"""(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN {_TEXT.format(a=_A, b=_B, c=_C)} END AS known, CASE WHEN o_custkey % 3 = 0 THEN 'dopamine' WHEN o_custkey % 3 = 1 THEN 'gaba' END AS top,
    o_custkey % 100 / 100.0 AS conf, CASE o_custkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'M' WHEN 3 THEN 'na' END AS side FROM orders)"""
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_PARSED = f"""(SELECT *, list_sort(list_distinct(list_filter(t, lambda x: list_contains({_list(V.TRANSMITTERS)}, x)))) AS found, len(list_filter(t, lambda x: list_contains({_list(V.OUT_OF_SCOPE)}, x))) > 0 AS outside,
    len(list_filter(t, lambda x: list_contains({_list(V.IGNORED)}, x) OR ends_with(x, '-negative'))) > 0 AS negated FROM
    (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(coalesce(known, '')), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS t FROM {_ROWS}))"""


@query("txt1_parse_labels", f"SELECT id, CASE WHEN len(found) = 1 THEN found[1] END AS single, array_to_string(found, ',') AS mentioned, len(found) = 1 AND NOT outside AND NOT negated AS clean FROM {_PARSED}")
def _(spark, d):
    p = L.parse_label(F.col("known"))
    return _label_rows(spark, d).select("id", p["single"].alias("single"), F.array_join(p["mentioned"], ",").alias("mentioned"), p["clean"].alias("clean"))


@query("txt2_unknown_tokens", f"""SELECT token, count(*) AS cells FROM (SELECT DISTINCT known, unnest(list_distinct(t)) AS token FROM {_PARSED}) WHERE NOT ends_with(token, '-negative')
    AND NOT list_contains({_list((*V.TRANSMITTERS, *V.OUT_OF_SCOPE, *V.IGNORED))}, token) GROUP BY token""")
def _(spark, d):
    return L.audit_tokens(_label_rows(spark, d), "known")


@query("txt4_clean_lineage", "SELECT p_partkey AS id, CASE WHEN v <> '' AND v <> 'putative_primary' AND NOT ends_with(v, '__prim') THEN v END AS lineage FROM (SELECT p_partkey, trim(CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'putative_primary ' WHEN 2 THEN p_brand || '__prim' WHEN 3 THEN ' ' || p_brand ELSE NULL END) AS v FROM part)")
def _(spark, d):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'putative_primary ' WHEN 2 THEN p_brand || '__prim' WHEN 3 THEN ' ' || p_brand ELSE NULL END")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), L.clean_lineage(raw).alias("lineage"))


_DERIVED = f"""(SELECT *, CASE WHEN len(found) = 1 THEN found[1] END AS nt_known, len(found) = 1 AND NOT outside AND NOT negated AS nt_known_clean,
    CASE WHEN list_contains(found, 'histamine') THEN 'histamine' WHEN NOT (coalesce(regexp_matches(lower(known), 'tyramine|glycine'), false) AND len(found) = 0) THEN top END AS nt_train, list_contains(found, 'histamine') AS over FROM {_PARSED})"""


@query("txt5_derive_labels", f"SELECT id, nt_known, nt_known_clean, nt_train, CASE WHEN over THEN 'known' WHEN nt_train IS NOT NULL THEN 'predicted' END AS nt_train_source, CASE WHEN NOT over AND nt_train IS NOT NULL THEN conf::DOUBLE END AS nt_conf FROM {_DERIVED}")
def _(spark, d):
    return L.derive_label(_label_rows(spark, d), "known", "top", "conf").select("id", "nt_known", "nt_known_clean", "nt_train", "nt_train_source", F.col("nt_conf").cast("double").alias("nt_conf"))


@query("txt5_report", f"SELECT count(nt_known) AS known, count(*) FILTER (nt_known_clean) AS known_clean, count(*) FILTER (over) AS overridden, count(*) FILTER (nt_train IS NULL) AS unlabelled, count(*) FILTER (NOT over AND nt_train IS NOT NULL) AS with_confidence FROM {_DERIVED}")
def _(spark, d):
    return L.derivation_report(L.derive_label(_label_rows(spark, d), "known", "top", "conf"))


@query("prj8_harmonise", f"SELECT id, coalesce(nt_known, nt_train) AS nt_best, CASE side WHEN 'L' THEN 'left' WHEN 'R' THEN 'right' WHEN 'M' THEN 'center' ELSE side END AS side FROM {_DERIVED}")
def _(spark, d):
    return L.harmonise(L.derive_label(_label_rows(spark, d), "known", "top", "conf")).select("id", "nt_best", "side")


@query("prj7_mapped", "SELECT n_nationkey AS id, CASE r_name WHEN 'EUROPE' THEN 'north' WHEN 'ASIA' THEN 'east' WHEN 'AFRICA' THEN 'south' WHEN 'AMERICA' THEN 'west' END AS side FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return L.mapped(rows, "r_name", {"EUROPE": "north", "ASIA": "east", "AFRICA": "south", "AMERICA": "west", "MIDDLE EAST": None}, "side").select(F.col("n_nationkey").alias("id"), "side")


_NODES = f"(SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN 'vnc' ELSE 'brain' END AS region, c_mktsegment AS super_class, count(i) FILTER (sign < 0) AS n_in, count(i) FILTER (sign > 0) AS n_out, any_value(c_nationkey) AS nation FROM customer LEFT JOIN {SYM2} ON i = c_custkey GROUP BY 1, 2, 3)"


def _node_rows(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    deg = E.degree_table(G.directed(spark, d), c.select(F.col("c_custkey").alias("source_id")))
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 == 0, "vnc").otherwise("brain").alias("region"), F.col("c_mktsegment").alias("super_class"), F.col("c_nationkey").alias("nation")).join(deg, "id")


@query("prj9_scope_split", f"SELECT id, CASE WHEN region = 'brain' AND n_in + n_out > 0 THEN CASE WHEN id % 20 < 14 THEN 'train' WHEN id % 20 < 17 THEN 'val' ELSE 'test' END ELSE 'excluded' END AS split FROM {_NODES}")
def _(spark, d):
    return _node_rows(spark, d).select("id", L.restrict_split(splits.modulo_split(F.col("id")), L.in_scope("brain")).alias("split"))


@query("prj11_scope_masks", "SELECT c_custkey AS id, true AS whole, coalesce(c_mktsegment = 'BUILDING', false) AS central, coalesce(c_mktsegment = 'AUTOMOBILE', false) AS optic FROM customer")
def _(spark, d):
    m = lambda n: L.scope_mask(n, "c_mktsegment", "BUILDING", "AUTOMOBILE")
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), m("whole_brain").alias("whole"), m("central_brain").alias("central"), m("optic_lobe").alias("optic"))


@query("prj12_label_strings", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR END AS label FROM lineitem")
def _(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.label_string(F.col("l_quantity")).alias("label"))


@query("prj17_seen_unseen", "SELECT p_partkey AS id, CASE WHEN v IS NULL THEN 'absent' WHEN v IN (SELECT p_size FROM part WHERE p_partkey % 2 = 0 AND p_size < 30) THEN 'seen' ELSE 'unseen' END AS \"group\" FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS v FROM part WHERE p_partkey % 2 = 1)")
def _(spark, d):
    part = _t(spark, d, "part")
    seen = part.where("p_partkey % 2 = 0 AND p_size < 30").select(F.col("p_size").alias("v")).distinct().withColumn("_in", F.lit(True))
    rows = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("v"))
    return rows.join(seen, "v", "left").select("id", L.classified(F.col("v"), F.col("_in").isNotNull()).alias("group"))


@query("prj19_pooled", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'other' END AS pool, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return _t(spark, d, "customer").groupBy(L.pooled(F.col("c_mktsegment"), ("BUILDING", "MACHINERY")).alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query("prj20_weightings", f"SELECT {r6('sum(1.0)', 'binary')}, {r6('sum(w::DOUBLE)', 'raw')}, {r6('sum(ln(1 + w))', 'log1p')} FROM {G3}")
def _(spark, d):
    return rounded(G.dense(spark, d).agg(*(F.sum(L.weighted(n, F.col("w"))).alias(n) for n in ("binary", "raw", "log1p"))))


@query("prj21_safe_and_log2", "SELECT event_id, round(CASE WHEN value > 50 THEN 100 / (value - 50) ELSE 0 END, 6) + 0.0 AS safe, round(CASE WHEN value > 50 THEN log2(value / (value - 50)) END, 6) + 0.0 AS ratio FROM events")
def _(spark, d):
    v = F.col("value")
    return rounded(_t(spark, d, "events").select("event_id", L.safe_ratio(F.lit(100.0), v - 50).alias("safe"), L.log2_ratio(v, v - 50).alias("ratio")))


# --- array functions -------------------------------------------------------------------------------------------------------

_P = "(SELECT vec_id AS id, label, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


@query("mth_vectors", f"""SELECT id, list_position(p, list_max(p)) - 1 AS argmax, {r6('list_sort(p, ' + "'DESC')[1] - list_sort(p, 'DESC')[2]", 'margin')}, {r6('-list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12))))', 'entropy')},
    least(floor(10 * list_max(p)), 9)::INT AS left_bin, (ceil(10 * list_max(p)) - 1)::INT AS right_bin, {r6('sqrt(list_sum(list_transform(x, lambda v: v * v)))', 'norm')}
    FROM (SELECT id, x, list_transform(e, lambda v: v / list_sum(e)) AS p FROM {_P})""")
def _(spark, d):
    x = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    p = x.withColumn("p", A.softmax(F.col("x")))
    top = F.array_max("p")
    return rounded(p.select("id", A.argmax(F.col("p")).alias("argmax"), A.margin(F.col("p")).alias("margin"), A.entropy(F.col("p")).alias("entropy"), A.floor_bin(top).alias("left_bin"), A.right_bin(top).alias("right_bin"), F.sqrt(A.dot(F.col("x"), F.col("x"))).alias("norm")))


# --- splits ----------------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN {k} % 20 < 14 THEN 'train' WHEN {k} % 20 < 17 THEN 'val' ELSE 'test' END"


@query("spl1_modulo", f"SELECT vec_id AS id, {_SPLIT.format(k='vec_id')} AS split FROM embeddings")
def _(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), splits.modulo_split(F.col("vec_id")).alias("split"))


def _draw_sql(key: str) -> str:
    return f"md5({key})"


def _share_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("spl1_random", f"SELECT id, CASE WHEN s < 0.7::DOUBLE THEN 'train' WHEN s < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split_random FROM (SELECT c_custkey AS id, {_share_sql("c_custkey || ':3'")} AS s FROM customer)")
def _(spark, d):
    return splits.random_split(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), 3)


def _part_nodes(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 != 0, F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("cell_type"), F.col("p_type").alias("label"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END").alias("side"), splits.modulo_split(F.col("p_partkey")).alias("split"))


_PART = f"(SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_brand || '-' || p_size END AS cell_type, p_type AS label, CASE p_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side, {_SPLIT.format(k='p_partkey')} AS split FROM part)"


@query("spl3_blocked", f"""WITH RECURSIVE n AS (SELECT *, coalesce(cell_type, '__ungrouped_' || id) AS grp FROM {_PART}), c AS (SELECT grp, label, count(*) AS c FROM n GROUP BY ALL),
    s AS (SELECT grp, sum(c)::BIGINT AS size, arg_min(label, (-c, label)) AS stratum FROM c GROUP BY grp),
    g AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, {_draw_sql("grp || ':1'")}, grp) AS r, sum(size) OVER (PARTITION BY stratum)::DOUBLE AS total FROM s),
    deal AS (SELECT DISTINCT stratum, 0::BIGINT AS r, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::VARCHAR AS grp, -1 AS p FROM g UNION ALL
        SELECT stratum, r, a + CASE WHEN p = 0 THEN size ELSE 0 END, b + CASE WHEN p = 1 THEN size ELSE 0 END, c + CASE WHEN p = 2 THEN size ELSE 0 END, grp, p FROM
        (SELECT d.stratum, g.r, d.a, d.b, d.c, g.grp, g.size, CASE WHEN 0.7::DOUBLE * total - a >= 0.15::DOUBLE * total - b AND 0.7::DOUBLE * total - a >= 0.15::DOUBLE * total - c THEN 0 WHEN 0.15::DOUBLE * total - b >= 0.15::DOUBLE * total - c THEN 1 ELSE 2 END AS p
        FROM deal d JOIN g ON g.stratum = d.stratum AND g.r = d.r + 1))
    SELECT id, cell_type, label, side, CASE p WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM n JOIN (SELECT grp, p FROM deal WHERE p >= 0) USING (grp)""")
def _(spark, d):
    return splits.blocked_split(_part_nodes(spark, d).drop("split"), ["label"], "cell_type", 1)


@query("spl4_leak_audit", " UNION ALL ".join(f"SELECT '{c}' AS audited, count(*) AS rows, round(avg(CASE WHEN {c} IN (SELECT {c} FROM n WHERE split = 'train' AND {c} IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS leaked FROM n WHERE split = 'test' AND {c} IS NOT NULL" for c in ("cell_type", "side")).join((f"WITH n AS (SELECT * FROM {_PART}) ", "")))
def _(spark, d):
    return rounded(splits.leak_audit(_part_nodes(spark, d), "split", ["cell_type", "side"]))


@query("spl4_twins", f"""WITH n AS (SELECT * FROM {_PART} WHERE side IS NOT NULL AND cell_type IS NOT NULL), t AS (SELECT * FROM n WHERE cell_type IN (SELECT cell_type FROM n GROUP BY 1 HAVING count(*) = 2))
    SELECT 'cell_type' AS audited, count(*) AS rows, round(avg(CASE WHEN cell_type IN (SELECT cell_type FROM t WHERE split = 'train') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS leaked FROM t WHERE split = 'test'""")
def _(spark, d):
    return rounded(splits.twin_share(_part_nodes(spark, d), "split"))


@query("spl5_label_coverage", f"""WITH n AS (SELECT split, cell_type AS c FROM {_PART}), p AS (SELECT DISTINCT split FROM n), k AS (SELECT DISTINCT c FROM n WHERE c IS NOT NULL)
    SELECT p.split, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM k WHERE c NOT IN (SELECT c FROM n WHERE n.split = p.split AND c IS NOT NULL)), '') AS missing FROM p""")
def _(spark, d):
    return splits.label_coverage(_part_nodes(spark, d), "split", "cell_type")


@query("spl7_holdout", f"""WITH n AS (SELECT id, split, row_number() OVER (ORDER BY {_draw_sql("id || ':0'")}, id) AS r, count(*) OVER () AS c FROM {_PART}), h AS (SELECT *, r <= least(2048, c // 4) AS held FROM n)
    SELECT id, CASE WHEN held THEN 'holdout' ELSE 'trainable' END AS part FROM h UNION ALL SELECT id, 'pool' FROM h WHERE NOT held AND split = 'train'""")
def _(spark, d):
    n = _part_nodes(spark, d)
    held, rest, pool = splits.holdout(n.select("id"), 8, n.where("split = 'train'").select("id"))
    mark = lambda df, name: df.select("id", F.lit(name).alias("part"))
    return mark(held, "holdout").unionByName(mark(rest, "trainable")).unionByName(mark(pool, "pool"))


# --- scaling ----------------------------------------------------------------------------------------------------------------

#: Places of an embedding; the queries read all of them.


def _vec(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(_PLACES)), splits.modulo_split(F.col("vec_id")).alias("split"))


_ALL = [f"x{i}" for i in range(_PLACES)]
_VEC = f"(SELECT vec_id AS id, label, {', '.join(f'embedding[{i + 1}]::DOUBLE AS x{i}' for i in range(_PLACES))}, {_SPLIT.format(k='vec_id')} AS split FROM embeddings)"


def _scaled_sql(fitted: str, shown: str = "true") -> str:
    """All places of the shown rows by the mean and deviation of the fitted ones."""
    return f"SELECT id, {', '.join(r6(f'({c} - m_{c}) / greatest(s_{c}, 1e-6)', c) for c in _ALL)} FROM {_VEC}, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _ALL)} FROM {_VEC} WHERE {fitted}) WHERE {shown}"


@query("scl1_standardise", _scaled_sql("split = 'train'"))
def _(spark, d):
    v = _vec(spark, d).select("id", *_ALL, "split")
    return rounded(scaling.apply_scale(v, scaling.fit_scale(v, _ALL, F.col("split") == "train"), _ALL).drop("split"))


@query("scl2_transfer", _scaled_sql("split = 'train' AND id % 2 = 0", "id % 2 = 1"))
def _(spark, d):
    v = _vec(spark, d)
    source, target = v.where("id % 2 = 0"), v.where("id % 2 = 1").select("id", *_ALL)
    return rounded(scaling.apply_scale(target, scaling.target_scale(source, target, _ALL, "source", F.col("split") == "train", F.lit(True)), _ALL))


@query("scl3_own_statistics", _scaled_sql("id % 2 = 1", "id % 2 = 1"))
def _(spark, d):
    v = _vec(spark, d)
    source, target = v.where("id % 2 = 0"), v.where("id % 2 = 1").select("id", *_ALL)
    return rounded(scaling.apply_scale(target, scaling.target_scale(source, target, _ALL, "own", F.col("split") == "train", F.lit(True)), _ALL))


@query("scl3_connected_statistics", _scaled_sql("id % 2 = 1 AND label < 5", "id % 2 = 1"))
def _(spark, d):
    v = _vec(spark, d)
    source, target = v.where("id % 2 = 0"), v.where("id % 2 = 1").select("id", "label", *_ALL)
    stats = scaling.target_scale(source, target, _ALL, "own_neurons", F.col("split") == "train", F.col("label") < 5)
    return rounded(scaling.apply_scale(target, stats, _ALL).drop("label"))


@query("scl4_unit_floor", f"SELECT id, {', '.join(r6(f'({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END)', c) for c in _ALL)}, {r6('0.0', 'c')} FROM {_VEC}, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _ALL)} FROM {_VEC})")
def _(spark, d):
    v = _vec(spark, d).select("id", *_ALL, F.lit(3.0).alias("c"))
    return rounded(scaling.apply_scale(v, scaling.fit_scale(v, [*_ALL, "c"]), [*_ALL, "c"], None))


@query("scl5_effective_rank")
def _(spark, d):
    v = _vec(spark, d)
    m = scaling.collapse_metrics(v, _ALL)
    return rounded(spark.createDataFrame([(scaling.effective_rank(v, _ALL), *m.values())], "standardised double, " + ", ".join(f"{k} double" for k in m)))


@query("scl9_null_space")
def _(spark, d):
    v = _vec(spark, d).withColumn("t", F.col("x0") + F.col("x1"))
    return rounded(scaling.null_space(v, _ALL, ["t"], 1).select("id", *_ALL))


# --- probes -----------------------------------------------------------------------------------------------------------------


def _probe_rows(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"), splits.modulo_split(F.col("vec_id")).alias("split"))


_E = f"(SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label::VARCHAR AS label, {_SPLIT.format(k='vec_id')} AS split FROM embeddings)"
_NEAR = "(SELECT q.id, r.label, {dist} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY round({dist}, 9), r.id) AS rank FROM {e} q, {e} r WHERE q.split = 'test' AND r.split = 'train')"


@query("prb6_knn_vote", f"""SELECT id, label AS pred_knn, {r6('c / 5', 'knn_share')} FROM (SELECT id, label, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS r FROM
    (SELECT id, label, count(*) AS c FROM {_NEAR.format(dist='list_distance(q.x, r.x)', e=_E)} WHERE rank <= 5 GROUP BY ALL)) WHERE r = 1""")
def _(spark, d):
    rows = _probe_rows(spark, d)
    return rounded(probes.vote(probes.neighbours(rows.where("split = 'test'"), rows.where("split = 'train'"), 5), 5))


@query("prb8_class_votes", f"SELECT id, label, {r6('count(*) / 5', 'share')} FROM {_NEAR.format(dist='list_distance(q.x, r.x)', e=_E)} WHERE rank <= 5 GROUP BY id, label")
def _(spark, d):
    rows = _probe_rows(spark, d)
    return rounded(probes.class_votes(probes.neighbours(rows.where("split = 'test'"), rows.where("split = 'train'"), 5), 5))


@query("qry11_same_label", f"SELECT q.label AS label, count(*) AS n, {r6('avg((n.label = q.label)::INT::DOUBLE)', 'same_share')} FROM {_NEAR.format(dist='(1 - list_cosine_similarity(q.x, r.x))', e=_E)} n JOIN {_E} q USING (id) WHERE rank = 1 GROUP BY 1")
def _(spark, d):
    rows = _probe_rows(spark, d)
    near = probes.neighbours(rows.where("split = 'test'"), rows.where("split = 'train'"), 1, "cosine")
    return rounded(probes.same_label_share(near, rows.withColumn("by", F.col("label")), "label", "by").withColumnRenamed("by", "label"))


@query("prb11_curve_point")
def _(spark, d):
    found = probes.curve_point(_probe_rows(spark, d))
    return rounded(spark.createDataFrame([tuple(found.values())], "linear double, knn double, k long"), 4)


@query("prb2_sweep")
def _(spark, d):
    rows = _probe_rows(spark, d).withColumn("odd", F.expr("CAST(CAST(label AS INT) % 2 AS STRING)"))
    found = probes.sweep(rows, ["odd"], {"all": F.lit(True), "even": F.col("id") % 2 == 0})
    return rounded(spark.createDataFrame([(t, scope, r["source_macro_f1"], r["rows_of_unknown_class"]) for (t, scope), r in found.items()], "target string, scope string, macro_f1 double, rows_of_unknown_class long"), 4)


@query("joi16_cosine_nearest", f"SELECT id, label, {r6('distance', 'distance')} FROM {_NEAR.format(dist='(1 - list_cosine_similarity(q.x, r.x))', e=_E)} WHERE rank = 1")
def _(spark, d):
    rows = _probe_rows(spark, d)
    return rounded(probes.neighbours(rows.where("split = 'test'"), rows.where("split = 'train'"), 1, "cosine").select("id", "label", "distance"))


@query("prb7_baselines", f"""WITH c AS (SELECT label, count(*) AS c FROM {_E} WHERE split = 'train' GROUP BY 1) SELECT {r6('avg((t.label = (SELECT label FROM c ORDER BY c DESC, label LIMIT 1))::INT::DOUBLE)', 'majority_accuracy')},
    {r6('avg(coalesce(c.c / (SELECT sum(c) FROM c), 0))', 'prior_accuracy')} FROM {_E} t LEFT JOIN c USING (label) WHERE t.split = 'test'""")
def _(spark, d):
    rows = _probe_rows(spark, d)
    return rounded(probes.baselines(rows.where("split = 'train'"), rows.where("split = 'test'")))


@query("prb3_transfer")
def _(spark, d):
    rows = _probe_rows(spark, d)
    out, _ = probes.transfer(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    return rounded(out.drop("proba"), 4)


@query("prb4_logistic")
def _(spark, d):
    rows = _probe_rows(spark, d)
    classes = probes.class_list(rows)
    probe = probes.fit_logistic(rows.where("split = 'train'"), classes, 0.1)
    return rounded(probes.prediction_rows(probes.probabilities(rows.where("split = 'test'"), probe), classes).select("id", "label", "pred", "p", "p_true", "margin", "entropy"), 4)


# --- scores -----------------------------------------------------------------------------------------------------------------


def _pred(spark, d) -> DataFrame:
    """Predictions made from the labels table: quality as true, toxic turned round as pred, and a confidence by hash-free arithmetic."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = _t(spark, d, "labels").join(docs, "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("true"), (1 - F.col("toxic")).cast("string").alias("pred"), ((F.col("doc_id") * 7919 % 997) / 997.0).alias("p"), "lang", "source", "n_chars", F.when(F.col("doc_id") % 2 == 0, "target").otherwise("source_test").alias("where"))


_PRED = "(SELECT doc_id AS id, quality::VARCHAR AS \"true\", (1 - toxic)::VARCHAR AS pred, (doc_id * 7919 % 997) / 997.0::DOUBLE AS p, lang, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'target' ELSE 'source_test' END AS \"where\" FROM labels JOIN documents USING (doc_id))"
_CLASS = "(SELECT {by} c AS class, count(*) FILTER (\"true\" = c AND pred = c)::DOUBLE AS tp, count(*) FILTER (\"true\" = c)::DOUBLE AS support, count(*) FILTER (pred = c)::DOUBLE AS predicted FROM {rows}, (SELECT unnest(['0', '1', '2']) AS c) GROUP BY ALL)"


@query("scr1_score", f"""WITH c AS (SELECT *, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM {_CLASS.format(by='', rows=_PRED)})
    SELECT sum(support)::BIGINT AS n, {r6('sum(f) / 3', 'macro_f1')}, {r6('avg(f) FILTER (support > 0)', 'macro_f1_present')}, {r6('sum(f * support) / sum(support)', 'weighted_f1')}, {r6('sum(r) / 3', 'balanced_accuracy')},
    {r6('avg(r) FILTER (support > 0)', 'balanced_accuracy_present')}, {r6('sum(tp) / sum(support)', 'accuracy')}, (3 - count(*) FILTER (support > 0))::BIGINT AS classes_absent FROM c""")
def _(spark, d):
    return rounded(scoring.score(_pred(spark, d), ["0", "1", "2"]))


@query("scr2_present_by_lang", f"""WITH c AS (SELECT *, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f FROM {_CLASS.format(by='lang,', rows=_PRED)})
    SELECT lang, sum(support)::BIGINT AS n, {r6('avg(f) FILTER (support > 0)', 'macro_f1')}, {r6('sum(f * support) / sum(support)', 'weighted_f1')}, {r6('sum(tp) / sum(support)', 'accuracy')} FROM c GROUP BY lang""")
def _(spark, d):
    return rounded(scoring.score(_pred(spark, d), None, ("lang",)).select("lang", "n", "macro_f1", "weighted_f1", "accuracy"))


@query("agg12_confusion", f"SELECT \"true\", count(*) AS n, {r6('count(*) FILTER (pred = ' + chr(39) + '0' + chr(39) + ') / count(*)', 'pred_0')}, {r6('count(*) FILTER (pred = ' + chr(39) + '1' + chr(39) + ') / count(*)', 'pred_1')}, {r6('0.0', 'pred_2')} FROM {_PRED} GROUP BY 1")
def _(spark, d):
    return rounded(slicing.shown("pred", ["0", "1", "2"], scoring.confusion(_pred(spark, d)), "true"))


_RUN = "(SELECT *, sum(n) OVER w AS rn, sum(h) OVER w AS hits FROM (SELECT {by} p, count(*) AS n, count(*) FILTER (\"true\" = pred) AS h FROM {rows} GROUP BY ALL) WINDOW w AS ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query("scr4_coverage", f"SELECT goal::DOUBLE AS goal, {r6('coalesce(max(rn) FILTER (hits >= goal * rn - 1e-12) / max(rn), 0)', 'coverage')}, {r6('min(p) FILTER (hits >= goal * rn - 1e-12)', 'threshold')} FROM {_RUN.format(by='', rows=_PRED, part='')}, (SELECT unnest([0.8, 0.9, 0.95, 0.99]) AS goal) GROUP BY goal")
def _(spark, d):
    return rounded(scoring.coverage(_pred(spark, d)))


@query("scr5_triage", f"SELECT pred, {r6('coalesce(max(rn) FILTER (hits >= 0.85 * rn - 1e-12) / max(rn), 0)', 'coverage')}, {r6('min(p) FILTER (hits >= 0.85 * rn - 1e-12)', 'threshold')} FROM {_RUN.format(by='pred,', rows=_PRED, part='PARTITION BY pred')} GROUP BY pred")
def _(spark, d):
    return rounded(scoring.triage(_pred(spark, d), 0.85))


@query("scr4_ece_left", f"SELECT {r6('sum(n * abs(m - a)) / sum(n)', 'ece')} FROM (SELECT count(*) AS n, avg(p) AS m, avg((\"true\" = pred)::INT) AS a FROM {_PRED} GROUP BY least(floor(p * 10), 9))")
def _(spark, d):
    return rounded(scoring.calibration_error(_pred(spark, d)))


@query("scr6_ece_right", f"SELECT {r6('sum(n * abs(m - a)) / sum(n)', 'ece')} FROM (SELECT count(*) AS n, avg(p) AS m, avg((\"true\" = pred)::INT) AS a FROM {_PRED} GROUP BY ceil(p * 10))")
def _(spark, d):
    return rounded(scoring.calibration_error(_pred(spark, d), closed="right"))


@query("scr9_mann_whitney", """WITH r AS (SELECT quality = 1 AS g, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS k FROM labels JOIN documents USING (doc_id))
    SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, round(sum(k) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2, 6) + 0.0 AS u FROM r""")
def _(spark, d):
    return rounded(scoring.mann_whitney(_pred(spark, d), "n_chars", F.col("true") == "1").drop("p_greater"))


@query("scr8_temperature")
def _(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("log_p"), F.col("label").alias("true_code"))
    t, scores = scoring.calibrated(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"))
    return rounded(scores.withColumn("temperature", F.lit(t)), 4)


# --- slices and reports -----------------------------------------------------------------------------------------------------


@query("win3_quintiles", f"SELECT id, CASE WHEN c = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * 5 / (c - 1)))::INT END AS quintile FROM (SELECT id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, id) AS r, count(*) OVER (PARTITION BY lang) AS c FROM {_PRED})")
def _(spark, d):
    return slicing.quantile_bin(_pred(spark, d), "n_chars", 5, ("lang",), "id", "quintile").select("id", "quintile")


@query("win5_value_quartiles", f"SELECT id, 1 + (n_chars > q[1])::INT + (n_chars > q[2])::INT + (n_chars > q[3])::INT AS quartile FROM {_PRED}, (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM {_PRED})")
def _(spark, d):
    return slicing.value_quartile(_pred(spark, d), "n_chars").select("id", "quartile")


@query("win6_fixed_bins", f"SELECT CASE WHEN n_chars > 0 AND n_chars <= 500 THEN 'short' WHEN n_chars > 500 AND n_chars <= 2000 THEN 'middle' WHEN n_chars > 2000 AND n_chars <= 1e9 THEN 'long' END AS bin, count(*) AS n FROM {_PRED} GROUP BY 1")
def _(spark, d):
    return _pred(spark, d).groupBy(slicing.fixed_bin(F.col("n_chars"), [0, 500, 2000, 1e9], ["short", "middle", "long"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("win8_shares", "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM customer GROUP BY 1")
def _(spark, d):
    return rounded(slicing.share_of_total(_t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "n"))


@query("qry2_per_class", f"""WITH c AS (SELECT * FROM {_CLASS.format(by='"where",', rows=_PRED)} WHERE support + predicted > 0), m AS (SELECT "where", pred AS class, avg(p) AS mean_p FROM {_PRED} GROUP BY ALL)
    SELECT "where", class, tp::BIGINT AS tp, support::BIGINT AS support, predicted::BIGINT AS predicted, {r6('CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END', 'precision')}, {r6('CASE WHEN support > 0 THEN tp / support ELSE 0 END', 'recall')},
    {r6('2 * tp / (support + predicted)', 'f1')}, {r6('mean_p', 'mean_p')} FROM c LEFT JOIN m USING ("where", class)""")
def _(spark, d):
    return rounded(slicing.per_class(_pred(spark, d)))


_BREAKDOWN = {"lang": "lang", "source": "source", "place": '"where"', "class": '"true"', "call": "pred", "quintile": "least(4, floor(p * 5))::INT", "length": "floor(log10(n_chars + 1))::INT", "connected": "(n_chars >= 500)"}


@query("qry4_slices", f"""WITH s AS ({' UNION ALL '.join(f"""SELECT '{k}' AS slice, CAST({e} AS VARCHAR) AS value, "true", pred FROM {_PRED}""" for k, e in _BREAKDOWN.items())}),
    k AS (SELECT slice, value, count(*) AS n, count(*) FILTER ("true" <> pred) AS wrong FROM s GROUP BY ALL),
    f AS (SELECT slice, value, avg(2 * tp / (support + predicted)) AS f FROM {_CLASS.format(by='slice, value,', rows='s')} WHERE support > 0 GROUP BY ALL)
    SELECT slice, value, n, wrong, round(wrong / sum(wrong) OVER (PARTITION BY slice), 6) + 0.0 AS share_of_errors, CASE WHEN n >= 30 THEN round(1 - wrong / n, 6) + 0.0 END AS accuracy, CASE WHEN n >= 30 THEN round(f, 6) + 0.0 END AS macro_f1
    FROM k LEFT JOIN f USING (slice, value) QUALIFY row_number() OVER (PARTITION BY slice ORDER BY n DESC, value) <= 12""")
def _(spark, d):
    p = _pred(spark, d).withColumns({"place": F.col("where"), "class": F.col("true"), "call": F.col("pred"), "quintile": F.least(F.lit(4), F.floor(F.col("p") * 5)).cast("int"), "length": F.floor(F.log10(F.col("n_chars") + 1.0)).cast("int"), "connected": F.col("n_chars") >= 500})
    return rounded(slicing.slices(p, list(_BREAKDOWN)))


_MODE = "(SELECT {by}, {v} AS mode FROM (SELECT {by}, {v}, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {v}) AS r FROM {rows} WHERE {v} IS NOT NULL GROUP BY {by}, {v}) WHERE r = 1)"


@query("qry5_by_type", f"""SELECT source, count(*) AS n, round(avg(("true" = pred)::INT), 6) + 0.0 AS accuracy, count(*) FILTER ("true" <> pred) AS wrong, any_value(a.mode) AS modal_true, any_value(b.mode) AS modal_pred FROM {_PRED} p
    JOIN {_MODE.format(by='source', v='"true"', rows=_PRED)} a USING (source) JOIN {_MODE.format(by='source', v='pred', rows=_PRED)} b USING (source) GROUP BY source HAVING count(*) >= 10""")
def _(spark, d):
    return rounded(slicing.by_type(_pred(spark, d), "source"))


@query("top4_worst", f"SELECT source, count(*) AS n, count(*) FILTER (\"true\" <> pred) AS wrong FROM {_PRED} GROUP BY 1 HAVING count(*) >= 10 ORDER BY wrong DESC, source LIMIT 5")
def _(spark, d):
    return slicing.worst(slicing.by_type(_pred(spark, d), "source"), 5).select("source", "n", "wrong")


@query("qry6_changes", f"SELECT nt_known, nt_train, count(*) AS n FROM {_DERIVED} WHERE nt_known <> nt_train GROUP BY ALL")
def _(spark, d):
    return slicing.changes(L.derive_label(_label_rows(spark, d), "known", "top", "conf"), "nt_known", "nt_train")


@query("agg19_changed_types", "SELECT count(*) AS types, count(*) FILTER (c > 0.9) AS mostly, count(*) FILTER (c < 0.1) AS hardly FROM (SELECT p_brand, avg((p_size % 2 IS DISTINCT FROM p_partkey % 2)::INT) AS c FROM part GROUP BY 1 HAVING count(*) >= 5)")
def _(spark, d):
    rows = _t(spark, d, "part").select("p_brand", (F.col("p_size") % 2).cast("long").alias("a"), (F.col("p_partkey") % 2).alias("b"))
    return slicing.changed_types(rows, "p_brand", "a", "b")


@query("qry6_type_agreement", f"""WITH p AS (SELECT p_partkey AS k, p_brand, p_type FROM part) SELECT count(*) AS types, {r6('avg((a.mode = b.mode)::INT)', 'agreement')} FROM {_MODE.format(by='p_brand', v='p_type', rows='(SELECT * FROM p WHERE k % 2 = 0)')} a JOIN {_MODE.format(by='p_brand', v='p_type', rows='(SELECT * FROM p WHERE k % 2 = 1)')} b USING (p_brand)""")
def _(spark, d):
    p = _t(spark, d, "part")
    return rounded(slicing.type_agreement(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_brand", "p_type"))


@query("qry7_over_runs", f"""WITH c AS (SELECT *, 2 * tp / (support + predicted) AS f FROM {_CLASS.format(by='lang, seed,', rows=f'(SELECT *, id % 3 AS seed FROM {_PRED})')} WHERE support > 0), s AS (SELECT lang, seed, avg(f) AS f FROM c GROUP BY ALL)
    SELECT lang, {r6('avg(f)', 'mean')}, {r6('min(f)', 'least')}, {r6('max(f)', 'most')}, count(*) AS runs FROM s GROUP BY lang""")
def _(spark, d):
    return rounded(slicing.over_runs(_pred(spark, d).withColumn("seed", F.col("id") % 3), "lang"))


@query("top5_commonest", f"SELECT lang, m.mode AS commonest, {r6('max(c) / sum(c)', 'accuracy')} FROM (SELECT lang, \"true\", count(*) AS c FROM {_PRED} GROUP BY ALL) JOIN {_MODE.format(by='lang', v=chr(34) + 'true' + chr(34), rows=_PRED)} m USING (lang) GROUP BY ALL")
def _(spark, d):
    return rounded(slicing.commonest_rule(_pred(spark, d), ("lang",)))


@query("qry13_matched", f"SELECT count(*) AS n, count(*) FILTER (\"true\" = pred AND \"true\" = '1') AS both, count(*) FILTER (\"true\" = pred AND \"true\" <> '1') AS only_a, count(*) FILTER (\"true\" <> pred AND \"true\" = '1') AS only_b, count(*) FILTER (pred <> '1') AS flips FROM {_PRED}")
def _(spark, d):
    p = _pred(spark, d)
    return slicing.matched(p, p.withColumn("pred", F.lit("1")))


@query("joi8_run_diff", f"SELECT id FROM {_PRED} WHERE id % 3 = 0 OR pred <> '1'")
def _(spark, d):
    p = _pred(spark, d)
    return slicing.run_diff(p, p.where("id % 3 <> 0").withColumn("pred", F.lit("1")), ["id"], ["pred", "p"]).select("id")


@query("joi10_uncovered", "SELECT c_custkey AS k, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'repeated' FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    return slicing.uncovered(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("qry19_release", f"""SELECT doc_id AS id, max(pred) FILTER ("where" = 'target') AS a_call, {r6("max(p) FILTER (\"where\" = 'target')", 'a_p')}, max(pred) FILTER ("where" = 'source_test') AS b_call, {r6("max(p) FILTER (\"where\" = 'source_test')", 'b_p')}, count(p) > 0 AS scored
    FROM documents LEFT JOIN (SELECT id AS doc_id, pred, p, "where" FROM {_PRED}) USING (doc_id) GROUP BY doc_id""")
def _(spark, d):
    pred = _pred(spark, d).withColumn("probe_target", F.col("where"))
    return rounded(slicing.release_table(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), pred, {"target": "a", "source_test": "b"}))


@query("top6_by_status", f"""WITH t AS (SELECT source FROM {_PRED} GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5), c AS (SELECT *, 2 * tp / (support + predicted) AS f FROM {_CLASS.format(by='source,', rows=f'(SELECT * FROM {_PRED} WHERE source IN (SELECT source FROM t))')} WHERE support > 0)
    SELECT source, sum(support)::BIGINT AS n, {r6('avg(f)', 'macro_f1')}, {r6('sum(tp) / sum(support)', 'accuracy')} FROM c GROUP BY source""")
def _(spark, d):
    return rounded(slicing.by_status(_pred(spark, d), "source", 5, 1).select("source", "n", "macro_f1", "accuracy"))


@query("qry16_side_shares", f"SELECT s_nationkey AS nation, 'out' AS side, count(*) AS n, {r6('median(share)', 'median')}, {r6('avg(share)', 'mean')} FROM (SELECT pre, count(*) FILTER (w = 1) / count(*) AS share FROM {G1} GROUP BY pre) JOIN supplier ON s_suppkey = pre GROUP BY 1")
def _(spark, d):
    return rounded(slicing.side_shares(X.connection_features(G.bipartite(spark, d)), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "nation"))


@query("qry1_metadata", f"""WITH n AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN 'vnc' ELSE 'brain' END AS region, c_mktsegment AS super_class, c_nationkey AS nation, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::VARCHAR END AS cell_type,
    count(i) FILTER (sign < 0) AS n_in, count(i) FILTER (sign > 0) AS n_out, coalesce(sum(w) FILTER (sign < 0), 0)::BIGINT AS syn_in, coalesce(sum(w) FILTER (sign > 0), 0)::BIGINT AS syn_out FROM customer LEFT JOIN {SYM2} ON i = c_custkey GROUP BY 1, 2, 3, 4),
    t AS (SELECT DISTINCT cell_type FROM n WHERE nation < 12 AND cell_type IS NOT NULL), m AS (SELECT *, n_in + n_out AS degree, row_number() OVER (ORDER BY n_in + n_out, id) AS r, count(*) OVER () AS c FROM n)
    SELECT id, 'nt' AS probe_target, super_class AS "true", 'BUILDING' AS pred, region, super_class, nation, cell_type, n_in, n_out, syn_in, syn_out, degree, CASE WHEN cell_type IS NULL THEN 'no type' WHEN cell_type IN (SELECT cell_type FROM t) THEN 'seen' ELSE 'unseen' END AS type_in_source,
    CASE WHEN degree <= 7 THEN '0-7' WHEN degree <= 15 THEN '8-15' WHEN degree <= 31 THEN '16-31' WHEN degree <= 63 THEN '32-63' ELSE '64+' END AS tokens, greatest(1, ceil((r - 1) * 5 / (c - 1)))::INT AS degree_quintile FROM m""")
def _(spark, d):
    nodes = _node_rows(spark, d).withColumn("cell_type", F.when(F.col("id") % 5 != 0, F.col("nation").cast("string")))
    pred = nodes.select("id", F.lit("nt").alias("probe_target"), F.col("super_class").alias("true"), F.lit("BUILDING").alias("pred"))
    return slicing.attach_metadata(pred, nodes, nodes.where("nation < 12"))


@query("qry8_seen_unseen_scores", f"""WITH s AS (SELECT DISTINCT source FROM {_PRED} WHERE "where" = 'source_test' AND n_chars > 3000), g AS (SELECT *, CASE WHEN source IN (SELECT source FROM s) THEN 'seen' ELSE 'unseen' END AS grp FROM {_PRED} WHERE "where" = 'target'),
    c AS (SELECT *, 2 * tp / (support + predicted) AS f FROM {_CLASS.format(by='grp,', rows='g')} WHERE support > 0) SELECT grp AS "group", sum(support)::BIGINT AS n, {r6('avg(f)', 'macro_f1')}, {r6('sum(tp) / sum(support)', 'accuracy')} FROM c GROUP BY grp""")
def _(spark, d):
    p = _pred(spark, d)
    return rounded(slicing.seen_unseen(p.where("where = 'target'".replace("where =", "`where` =")), p.where("`where` = 'source_test' AND n_chars > 3000"), "source"))


@query("agg14_medians", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(median(c_acctbal), 6) + 0.0 AS median, round(avg(c_acctbal), 6) + 0.0 AS mean FROM customer GROUP BY 1")
def _(spark, d):
    return rounded(slicing.median_and_mean(_t(spark, d, "customer"), "c_acctbal", ("c_mktsegment",), nations=F.count_distinct("c_nationkey")))


@query("set4_set_ops", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)")
def _(spark, d):
    o, c = _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(o.intersect(c.where("c_nationkey < 10").select("k")), "both").unionByName(n(c.select("k").subtract(o), "only")).unionByName(n(o.unionByName(c.select("k")).distinct(), "either"))


@query("agg13_class_balance", f"SELECT label, count(*) AS n, {', '.join(f"round(count(*) FILTER (split = '{v}') / count(*), 6) + 0.0 AS split_{v}" for v in splits.PARTS)} FROM {_PART} GROUP BY label")
def _(spark, d):
    return rounded(slicing.shown("split", list(splits.PARTS), _part_nodes(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")), "label"))


@query("qry9_recalls", f"SELECT source, \"true\", count(*) AS n, round(avg((\"true\" = pred)::INT), 6) + 0.0 AS recall FROM {_PRED} GROUP BY ALL HAVING count(*) >= 5")
def _(spark, d):
    return rounded(slicing.recalls(_pred(spark, d), ("source", "true"), 5))


@query("qry10_confident", f"SELECT lang, count(*) AS n, count(*) FILTER (p >= 0.8) AS confident FROM {_PRED} WHERE id % 3 = 0 GROUP BY lang")
def _(spark, d):
    return slicing.confident(_pred(spark, d).withColumn("true", F.when(F.col("id") % 3 != 0, F.col("true"))), 0.8, ("lang",))


@query("qry14_split_composition", f"""WITH n AS (SELECT * FROM {_PART}), o AS (SELECT split, count(*) AS c FROM (SELECT cell_type, min(split) AS split FROM n WHERE cell_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) = 1) GROUP BY 1)
    SELECT split, count(*) AS n, count(DISTINCT cell_type) AS types, count(DISTINCT label) AS labels, coalesce(any_value(o.c), 0) AS own_types FROM n LEFT JOIN o USING (split) GROUP BY split""")
def _(spark, d):
    return slicing.split_composition(_part_nodes(spark, d), "split", "cell_type", "label")


@query("qry12_arms", f"""WITH r AS (SELECT 'a' AS run, lang, "true", pred FROM {_PRED} UNION ALL SELECT 'b', lang, "true", '1' FROM {_PRED}), c AS (SELECT *, 2 * tp / (support + predicted) AS f FROM {_CLASS.format(by='run, lang,', rows='r')} WHERE support + predicted > 0)
    SELECT run, lang, sum(support)::BIGINT AS n, {r6('avg(f) FILTER (support > 0)', 'macro_f1')}, {r6('sum(f * support) / sum(support)', 'weighted_f1')}, {r6('sum(tp) / sum(support)', 'accuracy')} FROM c GROUP BY ALL""")
def _(spark, d):
    p = _pred(spark, d)
    return rounded(slicing.arms({"a": p, "b": p.withColumn("pred", F.lit("1"))}, ("lang",)))


@query("nn8_dropped_edges", f"SELECT pre, post, w FROM {G1} WHERE {_share_sql("pre || ':' || post || ':1'")} >= 0.2::DOUBLE")
def _(spark, d):
    return tokens.dropped_edges(G.bipartite(spark, d), 0.2, 1)


@query("prb1_in_volume")
def _(spark, d):
    out, _ = probes.in_volume(_probe_rows(spark, d))
    return rounded(out.drop("proba"), 4)


@query("spl6_cohort", f"SELECT p_partkey AS id FROM part ORDER BY {_draw_sql("p_partkey || ':2'")}, id LIMIT 50")
def _(spark, d):
    return splits.cohort(_part_nodes(spark, d).select("id"), 50, 2)


def _report_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vectors whose label stands for a class, with a type, a split and counts by arithmetic; even ids are the source."""
    e, i = _t(spark, d, "embeddings"), F.col("vec_id")
    rows = e.select(i.alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 3).cast("string").alias("label"), F.concat(F.lit("t"), (F.col("label") * 4 + F.shiftright(i, 1) % 4).cast("string")).alias("cell_type"),
        splits.modulo_split(i).alias("split"), (i * 37 % 101 + 1).alias("syn_out"), (i * 17 % 31 + 1).alias("n_out"), (i * 13 % 97 + 1).alias("syn_in"), (i * 7 % 29 + 1).alias("n_in"))
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


@query("qry17_forward_mechanism")
def _(spark, d):
    from graftline.plans.reports import forward_mechanism

    found = forward_mechanism(*_report_rows(spark, d), least_cells=3, least_types=3)
    cell = lambda part, name, value: found[part].select(F.lit(part).alias("part"), F.expr(f"CAST({name} AS STRING)").alias("what"), F.expr(value).cast("double").alias("value"))
    return rounded(cell("A", "what", "macro_f1").unionByName(cell("B", "class", "spearman")).unionByName(cell("B by ratio", "ratio_bin", "acc")).unionByName(cell("C", "concat(`true`, quartile)", "acc")).unionByName(cell("D", "what", "macro_f1")).unionByName(cell("E", "`true`", "same_type")).unionByName(cell("E by neighbour", "same", "acc")).unionByName(cell("E chance", "'chance'", "chance")), 4)


@query("qry18_reverse_drop")
def _(spark, d):
    from graftline.plans.reports import reverse_drop

    found = reverse_drop(*_report_rows(spark, d), "1")
    cell = lambda part, name, value: found[part].select(F.lit(part).alias("part"), F.expr(f"CAST({name} AS STRING)").alias("what"), F.expr(value).cast("double").alias("value"))
    return rounded(cell("score", "what", "macro_f1").unionByName(cell("confusion", "concat(`true`, pred)", "share")).unionByName(cell("types", "cell_type", "correct")).unionByName(cell("coverage", "'of_class'", "of_class")).unionByName(cell("by coverage", "type_in_source", "accuracy")).unionByName(cell("counts", "ok", "median_syn_out")).unionByName(cell("test", "'p'", "p_greater")).unionByName(cell("quartiles", "quartile", "share")), 4)
