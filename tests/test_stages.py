"""The command line from raw tables to a release, on two small made-up volumes."""

import json

import numpy as np
import pytest

from graftline.__main__ import main
from graftline.plans import volumes


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw"))
    rng = np.random.default_rng(9)
    nts = ["acetylcholine", "gaba", "glutamate"]
    n, edges = 150, []
    for _ in range(1500):
        a, b = rng.integers(0, n, 2)
        edges.append((int(a) + 1000, int(b) + 1000, int(rng.integers(1, 4)) * (1 + 4 * int(a % 3 == 0))))
    spark.createDataFrame(edges, "pre_pt_root_id long, post_pt_root_id long, syn_count int").write.parquet(f"{path}/c1")
    ann = [(i + 1000, nts[i % 3] if i % 2 else None, nts[i % 3], 0.9, "central", f"t{i % 50}", "left" if i % 2 else "right", "LH" if i % 4 else "putative_primary") for i in range(n + 5)]
    spark.createDataFrame(ann, "root_id long, known_nt string, top_nt string, top_nt_conf double, super_class string, cell_type string, side string, ito_lee_hemilineage string").selectExpr(
        "root_id", "known_nt", "top_nt", "top_nt_conf", "super_class", "CAST(NULL AS string) cell_class", "CAST(NULL AS string) supertype", "cell_type", "CAST(NULL AS string) hemibrain_type", "CAST(NULL AS string) fbbt_id", "ito_lee_hemilineage", "side"
    ).coalesce(1).write.csv(f"{path}/a1", sep="\t", header=True)
    pairs = {(a, b): w for a, b, w in edges}
    spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "body_pre long, body_post long, weight int").write.parquet(f"{path}/c2")
    ann2 = [(i + 1000, ("cb_intrinsic", "vnc_motor")[i % 10 == 0], f"t{i % 50}", f"T{i}", "LH", "LR"[i % 2], "Traced") for i in range(n)]
    spark.createDataFrame(ann2, "bodyId long, superclass string, flywireType string, type string, itoleeHl string, somaSide string, statusLabel string").write.parquet(f"{path}/a2")
    spark.createDataFrame([(i + 1000, nts[i % 3] if i % 5 else "unclear", nts[i % 3] if i % 2 else None) for i in range(n)], "body long, consensus_nt string, ground_truth string").write.parquet(f"{path}/t2")
    return path


def test_command_line(spark, raw, tmp_path, capsys):
    out = str(tmp_path)

    def run(volume, *args):
        assert main(["--processed", out, "--volume", volume, *args]) == 0
        return capsys.readouterr().out

    told = json.loads(run("fafb", "intake", "--connections", f"{raw}/c1", "--annotations", f"{raw}/a1"))
    assert told["n_nodes"] == 155 and told["n_edgeless"] >= 5
    told = json.loads(run("mcns", "intake", "--connections", f"{raw}/c2", "--annotations", f"{raw}/a2", "--transmitters", f"{raw}/t2"))
    assert told["n_vnc"] == 15 and told["n_superclass_unmapped"] == 15
    nodes = spark.read.parquet(f"{out}/fafb_nodes.parquet")
    assert dict(nodes.dtypes) == volumes.NODE_COLUMNS
    for v in ("fafb", "mcns"):
        assert "leaked" in run(v, "splits")
        run(v, "features")
        assert "kept_share" in run(v, "topk", "-k", "8")
        run(v, "embed", *(["--source", "fafb"] if v == "mcns" else []))
    for method in ("degree", "composition", "propagate"):
        run("mcns", "embed", "--method", method)
        assert spark.read.parquet(f"{out}/mcns_embedding_{method}.parquet").count() == 150
    small = ("--k", "8", "--width", "16", "--heads", "2", "--layers", "1", "--steps", "6", "--batch", "40", "--rate", "0.01")
    told = json.loads(run("fafb", "train", *small))
    loss = [r.loss for r in spark.read.parquet(f"{out}/fafb_encoder_loss.parquet").orderBy("step").collect()]
    assert len(loss) == 6 and told["loss"] == loss[-1] < loss[0] and told["constant_predictor_loss"] > 0
    assert json.loads(run("fafb", "train", *small)) == told  # nothing is left to do
    run("fafb", "embed", "--method", "trained")
    run("mcns", "embed", "--method", "trained", "--source", "fafb")
    told = json.loads(run("fafb", "transfer", "--target", "mcns", "--targets", "nt_best", "--method", "trained"))
    assert 0 <= told["nt_best"]["target_macro_f1"] <= 1
    run("mcns", "embed", "--method", "outside", "--vectors", f"{out}/mcns_embedding_trained.parquet")
    with pytest.raises(ValueError, match="rows"):
        main(["--processed", out, "--volume", "fafb", "embed", "--method", "outside", "--vectors", f"{out}/mcns_embedding_trained.parquet"])
    told = json.loads(run("fafb", "transfer", "--target", "mcns", "--targets", "nt_best,nt_known", "--out", f"{out}/pred"))
    assert set(told) == {"nt_best", "nt_known"} and 0 <= told["nt_best"]["target_macro_f1"] <= 1
    assert "## Slices" in run("mcns", "breakdown", "--predictions", f"{out}/pred")
    assert "agreement" in run("fafb", "audit", "--other", "mcns")
    assert json.loads(run("mcns", "release", "--predictions", f"{out}/pred", "--out", f"{out}/release"))["rows"] > 100
    assert main(["check", "--a", f"{out}/pred", "--b", f"{out}/pred"]) == 0
    capsys.readouterr()
    assert run("fafb", "dictionary").count("\n") == 47


def test_a_block_that_lost_a_node_is_an_error(spark, tmp_path, monkeypatch):
    """Nodes without an edge, or with a loop alone, are filled; others must be there."""
    from graftline.operators import features as X
    from graftline.plans import stages

    at = stages.Folder(spark, str(tmp_path), "fafb")
    at.write("nodes", spark.range(6).selectExpr("CAST(id AS int) AS node_id"))
    at.write("edges", spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 0, 4), (3, 3, 1)], "pre int, post int, w int"))
    stages.feature_blocks(at, ("connection", "local"))
    assert at.read("local").count() == 6 and at.read("local").where("local_log_kcore > 0").count() == 3
    whole = X.partner_degree
    monkeypatch.setattr(X, "partner_degree", lambda edges: whole(edges).where("id <> 1"))
    with pytest.raises(ValueError, match="local"):
        stages.feature_blocks(at, ("local",))
