import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.operators import encoder, probes, scoring


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(360):
        c = i % 3
        x = rng.standard_normal(4) + 1.5 * np.eye(4)[c]
        out.append((i, [float(v) for v in x], "abc"[c] if i % 41 else None, ("train", "train", "val", "test")[i // 3 % 4]))
    return spark.createDataFrame(out, "id long, x array<double>, label string, split string").cache()


def test_logistic_is_at_the_optimum(rows):
    train = rows.where("split = 'train' AND label IS NOT NULL")
    p = probes.fit_logistic(train, ["a", "b", "c"], 0.5)
    pdf = train.toPandas()
    x, y = np.array(pdf["x"].tolist()), pdf["label"].map({"a": 0, "b": 1, "c": 2}).to_numpy()
    w = (len(y) / (3 * np.bincount(y)))[y]
    z = x @ p["coef"].T + p["intercept"]
    e = np.exp(z - z.max(1, keepdims=True))
    g = (e / e.sum(1, keepdims=True) - np.eye(3)[y]) * w[:, None]
    assert np.abs(p["coef"] + 0.5 * g.T @ x).max() < 1e-3


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("limit", [1 << 30, 1000])
def test_neighbours_equal_brute_force(rows, metric, limit, monkeypatch):
    monkeypatch.setattr(probes, "MOST_BYTES", limit)
    train, test = (rows.where(f"split = '{s}' AND label IS NOT NULL") for s in ("train", "test"))
    a, b = train.toPandas(), test.toPandas()
    x, q = np.array(a["x"].tolist()), np.array(b["x"].tolist())
    d = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T if metric == "cosine" else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    want = {int(i): list(a["id"].to_numpy()[np.lexsort((a["id"], row))[:5]]) for i, row in zip(b["id"], d, strict=True)}
    got = {}
    for r in sorted(probes.neighbours(test, train, 5, metric).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == want


def test_transfer_and_bundle(spark, rows):
    target = rows.where("id % 2 = 1").unionByName(rows.where("id = 5").withColumn("label", F.lit("new")))
    out, report = probes.transfer(rows, target, penalties=(0.1, 1.0), ks=(1, 5, 5000))
    assert report["target_macro_f1"] > 0.75 and report["k"] in (1, 5) and report["classes"] == ["a", "b", "c"]
    places = {r["where"]: r["count"] for r in out.groupBy("where").count().collect()}
    assert places["target_unlabelled"] == target.where("label IS NULL").count() and out.where(F.col("true") == "new").isEmpty()
    train = rows.where("split = 'train' AND label IS NOT NULL")
    row, reference = probes.bundle(report, train, spark)
    kept = row.first()
    assert {r.id: r.code for r in reference.collect()} == {r.id: "abc".index(r.label) for r in train.collect()}
    again = {r.id: r.p for r in probes.apply_bundle(kept, rows.where("split = 'test'")).collect()}
    first = {r.id: r.p for r in out.where("`where` = 'source_test'").collect()}
    assert all(abs(again[i] - p) < 1e-9 for i, p in first.items())
    one = rows.withColumn("label", F.lit("a"))
    assert "skipped" in probes.transfer(one, one)[1] and "error" in probes.transfer(rows.where("split = 'train'"), target)[1]


def test_mann_whitney_and_temperature(spark):
    rng = np.random.default_rng(5)
    v = [(float(rng.integers(0, 12) + (i < 40)), i < 40) for i in range(100)]
    r = scoring.mann_whitney(spark.createDataFrame(v, "v double, g boolean"), "v", F.col("g")).first()
    a, b = [x for x, g in v if g], [x for x, g in v if not g]
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and (r.n1, r.n2) == (40, 60)
    assert 0 < r.p_greater < 0.2
    z = rng.standard_normal((600, 3)) * 4
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    t = scoring.temperature(spark.createDataFrame([([float(x) for x in row], c) for row, c in zip(z, y, strict=True)], "log_p array<double>, true_code int"))
    assert 2 < t < 3.2


def test_coverage_by_row_and_encoder(spark):
    rows_ = spark.createDataFrame([(1, "a", "a", 0.9), (2, "a", "b", 0.8), (3, "a", "a", 0.7), (4, "a", "a", 0.6), (5, "a", "b", 0.1)], "id long, true string, pred string, p double")
    got = {r.goal: (r.coverage, r.threshold) for r in scoring.coverage_by_row(rows_, (0.75, 0.99)).collect()}
    assert got == {0.75: (0.8, 0.6), 0.99: (0.2, 0.9)}
    assert {r.goal: (r.coverage, r.threshold) for r in scoring.coverage(rows_, (0.75, 0.99)).collect()} == got
    w = encoder.random_weights(3, 16, 2, 2, 4)
    x = np.random.default_rng(0).standard_normal((2, 5, 5))
    valid = np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 1]], bool)
    a = encoder.forward(w, x.copy(), valid)
    y = x.copy()
    y[0, 3:] = 99  # padding has no say
    y[1, 1:] = y[1, [3, 1, 4, 2]]  # nor has the order of partners
    assert np.allclose(a, encoder.forward(w, y, valid))
    assert not np.allclose(encoder.forward(w, x.copy(), valid, np.array([0, 1])), encoder.forward(w, x.copy(), valid, np.array([-1, -1])))


def test_codes_take_the_norm_of_seed_tokens():
    from graftline.operators import encoder

    weights = encoder.random_weights(6, 16, 4, 2, 5, 3)
    seeds = np.random.default_rng(1).standard_normal((40, 8))
    got, scale = encoder.calibrate_codes(weights, seeds)
    assert abs(scale - np.linalg.norm(seeds @ weights["token"], axis=1).mean()) < 1e-12
    assert np.allclose(np.linalg.norm(got["codes"], axis=1), scale) and np.allclose(np.linalg.norm(got["unknown"]), scale)
    assert np.allclose(got["codes"] / scale, weights["codes"] / np.linalg.norm(weights["codes"], axis=1, keepdims=True))
    tokens, valid = np.random.default_rng(2).standard_normal((3, 4, 8)), np.ones((3, 4), bool)
    plain, shown = encoder.read_out(got), encoder.read_out(got, shown=True)
    code = np.array([0, 1, 2])
    assert np.allclose(plain(tokens, valid, code), plain(tokens, valid, code[::-1])) and not np.allclose(shown(tokens, valid, code), plain(tokens, valid, code))


def test_five_thousand_classes(spark):
    """Scored row by row as numpy does, in a plan whose size does not know the classes."""
    rng = np.random.default_rng(13)
    classes = sorted(f"type{i}" for i in range(5000))
    probe = {"coef": rng.standard_normal((5000, 64)), "intercept": rng.standard_normal(5000)}
    x = rng.standard_normal((700, 64))
    labels = [None if i % 50 == 0 else "other" if i % 50 == 1 else classes[i * 7] for i in range(700)]
    rows = spark.createDataFrame([(i, [float(v) for v in r], y, "k") for i, (r, y) in enumerate(zip(x, labels, strict=True))], "id long, x array<double>, label string, proba string")
    out = probes.prediction_rows(probes.probabilities(rows, probe), classes)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    z = x @ probe["coef"].T + probe["intercept"]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = out.orderBy("id").drop("x", "proba").collect()
    best = np.sort(p, axis=1)[:, ::-1]
    assert [r.pred for r in got] == [classes[i] for i in p.argmax(1)]
    for r, q, b, y in zip(got, p, best, labels, strict=True):
        assert abs(r.p - b[0]) < 1e-12 and abs(r.margin - (b[0] - b[1])) < 1e-12 and abs(r.entropy + (q * np.log(np.maximum(q, 1e-12))).sum()) < 1e-9
        assert (r.p_true is None) if y not in set(classes) else abs(r.p_true - q[classes.index(y)]) < 1e-12
    probes.MOST_MODEL, most = 1000, probes.MOST_MODEL
    try:
        with pytest.raises(ValueError, match="at most"):
            probes.probabilities(rows, probe)
    finally:
        probes.MOST_MODEL = most


def test_rows_without_a_vector_have_no_probabilities(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "a"), (3, [0.0, 0.0], None)], "id long, x array<double>, label string")
    probe = {"coef": np.array([[1.0, 0.0], [0.0, 1.0]]), "intercept": [0.0, 0.0]}
    got = {r.id: r for r in probes.prediction_rows(probes.probabilities(rows, probe), ["a", "b"]).collect()}
    assert got[1].pred == "b" and got[2].proba is None and got[2].pred is None and got[2].p_true is None and got[3].p == 0.5 and got[3].p_true is None


def test_calibration_of_the_target_equals_numpy(spark):
    rng = np.random.default_rng(21)
    z = rng.standard_normal((900, 4)) * 4
    p = np.exp(z / 2.0) / np.exp(z / 2.0).sum(1, keepdims=True)
    y = np.array([int(rng.choice(4, p=q)) for q in p])
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(z, y, strict=True))], "id long, log_p array<double>, true_code int")
    t, out = scoring.calibrated(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"))
    fit = np.arange(900) % 3 > 0
    loss = lambda t: (np.log(np.exp(z[fit] / t).sum(1)) - z[fit][np.arange(fit.sum()), y[fit]] / t).mean()
    assert all(loss(t) <= loss(t * k) for k in (0.99, 1.01)) and abs(t - scoring.temperature(rows.where("id % 3 > 0"))) < 1e-12

    def gap(t):
        q = np.exp(z[~fit] / t) / np.exp(z[~fit] / t).sum(1, keepdims=True)
        top, hit = q.max(1), q.argmax(1) == y[~fit]
        bins = np.minimum(np.floor(top * 10), 9)
        return sum((bins == b).mean() * abs(top[bins == b].mean() - hit[bins == b].mean()) for b in set(bins))

    r = out.first()
    assert r.rows == 300 and abs(r.before - gap(1.0)) < 1e-9 and abs(r.after - gap(t)) < 1e-9 and r.after < r.before


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_of_far_clusters_meet_few_rows(spark, metric):
    """Exact beside ties, repeated rows and zero vectors, though most cells are never met."""
    rng = np.random.default_rng(17)
    centres = rng.standard_normal((12, 6)) * 40
    x = centres[np.arange(4200) % 12] + rng.standard_normal((4200, 6)) * 0.5
    x[100:140] = x[100]
    x[[7, 8]] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r], str(i % 3)) for i, r in enumerate(x)], "id long, x array<double>, label string")
    asked, held = df.where("id % 10 = 0 OR id IN (7, 100, 101)"), df.where("id % 10 > 0")
    assert probes.met_share(asked, held, 3, metric) < 0.5
    ids, refs = [r.id for r in asked.collect()], np.array([r.id for r in held.collect()])
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in sorted(probes.neighbours(asked, held, 3, metric).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append((r.neighbour, r.distance))
    assert set(got) == set(ids)
    for i in ids:
        d = 1 - norm(x[refs]) @ norm(x[[i]])[0] if metric == "cosine" else np.sqrt(((x[refs] - x[i]) ** 2).sum(1))
        want = np.sort(d)[:3]
        assert np.allclose([v for _, v in got[i]], want, atol=1e-9)
        assert all(abs(d[refs == j][0] - v) < 1e-9 for j, v in got[i])


def test_neighbours_of_nothing(spark, rows):
    assert probes.neighbours(rows.limit(0), rows, 3).collect() == []
    assert probes.neighbours(rows.limit(5), rows.limit(0), 3).collect() == []
    assert len(probes.neighbours(rows.where("id < 2"), rows.where("id IN (5, 6)"), 9).collect()) == 4


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_what_moves_does_not_grow_with_the_cells(spark, monkeypatch, metric):
    """Queries are sent once a part of bounded size, not once a cell, and no part or block is larger than the bound allows."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], str(i % 3)) for i, r in enumerate(x)], "id long, x array<double>, label string")
    cells = probes.Cells(df, metric)
    assert len(cells.pivots) > 20 and cells.parts == 1 and probes.Cells(df.limit(0), metric).rows.count() == 0
    monkeypatch.setattr(probes, "MOST_BYTES", 20_000)
    cells = probes.Cells(df, metric)
    sizes = {r.part: r["count"] for r in cells.rows.groupBy("part").count().collect()}
    assert set(sizes) <= set(range(cells.parts)) and cells.parts < 2 * 3000 * 64 / 20_000 + 2 and max(sizes.values()) * 64 <= 20_000
    assert np.array_equal(cells.needed_parts(x[:9], 3).any(axis=1), np.ones(9, bool))
    spread = cells.rows.groupBy("cell").agg(F.count_distinct("part").alias("parts")).collect()
    assert all(r.parts <= cells.pieces[r.cell] for r in spread)
