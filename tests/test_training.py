import numpy as np
import pytest

from graftline.operators import encoder, training

D, K = 5, 3


def made(n, seed=1, classes=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        code = i % classes
        x = rng.standard_normal(D) + 2.0 * np.eye(D)[code]
        rows.append((i, x.tolist(), [{"x": (rng.standard_normal(D) + np.eye(D)[code]).tolist(), "weight": 1.0 + j, "sign": 1 - 2 * (j % 2)} for j in range(i % (K + 1))] or None, code if i % 10 else None))
    return rows


SCHEMA = "id long, seed array<double>, partners array<struct<x: array<double>, weight: double, sign: int>>, code int"


def test_gradients_agree_with_finite_differences():
    rng = np.random.default_rng(0)
    weights = encoder.random_weights(D, 8, 2, 2, 3)
    target, head = encoder.random_weights(D, 8, 2, 2, 3, seed=5), encoder.random_predictor(8)
    tokens, valid, code = rng.standard_normal((4, K + 1, D + 2)), rng.random((4, K + 1)) < 0.7, np.array([0, 1, 2, 1])
    valid[:, 0] = True
    given = (target, 0.7, tokens, valid, code)
    loss, grads = training.loss_and_gradients(weights, head, *given)
    params = training.leaves(weights, head)
    assert [g.shape for g in grads] == [p.shape for p in params]
    for p, g in zip(params, grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            kept, h = p[at], 1e-5
            p[at] = kept + h
            up = training.loss_and_gradients(weights, head, *given)[0]
            p[at] = kept - h
            down = training.loss_and_gradients(weights, head, *given)[0]
            p[at] = kept
            assert abs((up - down) / (2 * h) - g[at]) < 1e-6 + 1e-4 * abs(g[at])


def test_statistics_of_the_target_over_all_rows(spark):
    rows = [r for r in made(90) if r[3] is not None]
    target = encoder.random_weights(D, 8, 2, 1, 3)
    got = training.target_stats(spark.createDataFrame(rows, SCHEMA).repartition(7), target, K)
    import pandas as pd

    tokens, valid = encoder.arrays(pd.DataFrame(rows, columns=["id", "seed", "partners", "code"]), K)
    u, m = training.moved(target, tokens, valid, np.array([r[3] for r in rows]))
    rms = np.sqrt((m**2).mean())
    want = {"rows": len(rows), "constant_predictor_loss": training.smooth_l1((m - m.mean(axis=0)) / rms).mean(), "displacement": np.linalg.norm(m, axis=1).mean(), "anchor_spread": np.linalg.norm(u - u.mean(axis=0), axis=1).mean(), "rms": rms, "class_blind_loss": 0.5 * (m**2).mean(), "class_share": (m**2).mean() / ((m**2).mean() + ((u - u.mean(axis=0)) ** 2).mean())}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    with pytest.raises(ValueError, match="no labelled row"):
        training.target_stats(spark.createDataFrame([], SCHEMA), target, K)


def test_loss_falls_below_the_line_and_a_run_goes_on(spark, tmp_path):
    sets = spark.createDataFrame(made(120), SCHEMA)
    weights = encoder.random_weights(D, 8, 2, 1, 3)
    how = {"k": K, "batch": 40, "rate": 0.02, "seed": 2}
    whole = training.train(sets, weights, steps=24, **how)
    losses = [c["loss"] for c in whole["curve"]]
    assert [c["step"] for c in whole["curve"]] == list(range(24)) and np.mean(losses[-4:]) < 0.6 * np.mean(losses[:4])
    assert np.mean(losses[-4:]) < whole["stats"]["constant_predictor_loss"]
    state = str(tmp_path / "state")
    training.train(sets, weights, steps=10, state=state, save_every=5, **how)
    rest = training.train(sets, weights, steps=24, state=state, **how)
    assert np.allclose([c["loss"] for c in rest["curve"]], losses, atol=1e-9)
    assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(training.leaves(rest["weights"], rest["head"]), training.leaves(whole["weights"], whole["head"]), strict=True))
    assert np.array_equal(whole["weights"]["codes"], weights["codes"])
    got = encoder.embed(sets.drop("code"), whole["weights"], K).collect()
    assert len(got) == 120 and np.isfinite([r.embedding for r in got]).all()


def test_weights_as_a_table(spark):
    weights = encoder.random_weights(D, 8, 2, 2, 3)
    table = training.weights_table(spark, weights, {"k": K})
    got, settings = training.read_weights(table)
    assert settings == {"k": K, "heads": 2, "layers": 2} and got["heads"] == 2
    head = encoder.random_predictor(8)
    assert all(np.array_equal(a, b) for a, b in zip(training.leaves(got, head), training.leaves(weights, head), strict=True))
    assert np.array_equal(got["codes"], weights["codes"]) and np.array_equal(got["unknown"], weights["unknown"])
    for bad, told in ((table.where("name <> '1.up'"), "1.up"), (table.unionByName(table), "repeated"), (table.limit(0), "no weights")):
        with pytest.raises(ValueError, match=told):
            training.read_weights(bad)


def test_sums_reach_the_driver_as_one_vector(spark, monkeypatch):
    """However many tasks add up, no list of their vectors comes to the driver."""
    df = spark.range(0, 40, 1, 8)
    plain, seen = type(df).collect, []
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(plain(self)) or seen[-1])

    def run(batches):
        for b in batches:
            yield b["id"].min(), len(b), np.array([b["id"].sum(), 1.0])

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n, s = training._summed(df, run, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert n == 40 and s[0] == 780 and s[1] == 8 and all(len(rows) <= 1 for rows in seen)


def test_steps_read_their_own_rows_and_run_the_frozen_target_once(spark, monkeypatch):
    """The frozen target reads each row before the first step; a step lists no other step's files."""
    asked, plain, batches = [], type(spark.read).parquet, training.batches_of
    monkeypatch.setattr(training, "batches_of", lambda *a: asked.clear() or batches(*a))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **how: asked.extend(paths) or plain(self, *paths, **how))
    done = training.train(spark.createDataFrame(made(60), SCHEMA), encoder.random_weights(D, 8, 2, 1, 3), K, 3, batch=20)
    assert len(done["curve"]) == 3 and [p.rsplit("/", 1)[1] for p in asked[-3:]] == ["step=0", "step=1", "step=2"] and len(asked) == 4
