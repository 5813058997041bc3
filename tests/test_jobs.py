"""The jobs: against SQL, over growing input, cut off and run again, and from the command line."""

import collections
import json
import os
import subprocess
import sys

import pytest
from compare import assert_same, connect

from jobs import common, queries, training_table, word_graph

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string"
FIRST = [(1, "The cat sat. The cat ran!", "en"), (2, "le chat\nle chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "alone", "en"), (6, "no lang here", None), (7, "empty lang here", "")]
SECOND = [(8, "le chat dort", "fr"), (8, "le chat dort", "fr"), (9, "le le le", "fr")]


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def plain(rows, k=8):
    """{(volume, pre, post): w} and {(volume, word): (n_in, n_out, syn_in, syn_out, tokens)} by loops."""
    edges, nodes = collections.Counter(), {}
    for _, text, lang in rows:
        words = "".join(c.lower() if c in word_graph.LETTERS else c for c in text or "" if c not in word_graph.MARKS).split()
        edges.update((lang or "unknown", a, b) for a, b in zip(words, words[1:], strict=False))
    for v, word in {(v, x) for v, a, b in edges for x in (a, b)}:
        out, into = [(w, 1, b) for (u, a, b), w in edges.items() if (u, a) == (v, word)], [(w, -1, a) for (u, a, b), w in edges.items() if (u, b) == (v, word)]
        best = sorted(out + into, key=lambda t: (-t[0], -t[1], t[2]))[:k]
        nodes[v, word] = (len(into), len(out), sum(t[0] for t in into), sum(t[0] for t in out), " ".join(t[2] for t in best))
    return dict(edges), nodes


def found(spark, out):
    rows = word_graph.output(spark, out).collect()
    return {(r.volume, r.pre, r.post): r.w for r in rows if r.kind == "edge"}, {(r.volume, r.pre): (r.n_in, r.n_out, r.syn_in, r.syn_out, r.tokens) for r in rows if r.kind == "node"}


@pytest.fixture
def grown(spark, tmp_path):
    """(documents, out, checkpoint, add): a folder of documents to which add gives one more file."""
    docs = str(tmp_path / "docs")
    add = lambda rows: spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(docs)
    return docs, str(tmp_path / "out"), str(tmp_path / "checkpoint"), add


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def test_word_graph_takes_only_what_is_new(spark, grown):
    docs, out, checkpoint, add = grown
    add(FIRST)
    assert word_graph.run(spark, docs, out, checkpoint) == {"batches": 1, "volumes": ["en", "fr", "unknown"]}
    assert found(spark, out) == plain(FIRST)
    before = {v: files(f"{out}/edges/volume={v}") + files(f"{out}/nodes/volume={v}") for v in ("en", "fr", "unknown")}
    log = files(f"{out}/log")
    add(SECOND)
    assert word_graph.run(spark, docs, out, checkpoint) == {"batches": 1, "volumes": ["fr"]}
    assert found(spark, out) == plain(FIRST + SECOND)
    after = {v: files(f"{out}/edges/volume={v}") + files(f"{out}/nodes/volume={v}") for v in before}
    assert (after["en"], after["unknown"]) == (before["en"], before["unknown"]) and not set(after["fr"]) & set(before["fr"])
    assert set(log) < set(files(f"{out}/log"))
    whole = files(out)
    assert word_graph.run(spark, docs, out, checkpoint) == {"batches": 0, "volumes": []}
    assert files(out) == whole and found(spark, out) == plain(FIRST + SECOND)


def test_word_graph_is_the_same_in_one_run_or_many(spark, grown, tmp_path):
    docs, out, checkpoint, add = grown
    for rows in (FIRST, SECOND):
        add(rows)
        word_graph.run(spark, docs, out, checkpoint)
    other = str(tmp_path / "other")
    assert word_graph.run(spark, docs, other, f"{other}/checkpoint", {"files_per_batch": 1})["batches"] == 2
    assert found(spark, other) == found(spark, out)


def test_word_graph_goes_on_where_it_was_cut_off(spark, grown, monkeypatch):
    docs, out, checkpoint, add = grown
    add(FIRST)
    word_graph.take_new(spark, docs, out, checkpoint, word_graph.DEFAULTS)  # cut off before anything is put together
    assert word_graph.run(spark, docs, out, checkpoint) == {"batches": 0, "volumes": ["en", "fr", "unknown"]}
    add(SECOND)
    with monkeypatch.context() as patch:  # cut off after the edges were replaced
        patch.setattr(word_graph, "degree_table", lambda edges: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            word_graph.run(spark, docs, out, checkpoint)
    assert found(spark, out)[0] == plain(FIRST + SECOND)[0]
    assert word_graph.run(spark, docs, out, checkpoint) == {"batches": 0, "volumes": ["fr"]}
    assert found(spark, out) == plain(FIRST + SECOND)


def test_a_batch_that_is_run_again_replaces_itself(spark, grown):
    docs, out, checkpoint, add = grown
    add(FIRST)
    word_graph.run(spark, docs, out, checkpoint)
    word_graph.run(spark, docs, out, checkpoint + "-lost")  # the log's batch 0 comes a second time
    assert found(spark, out) == plain(FIRST)


def test_word_graph_settings(spark, grown):
    docs, out, checkpoint, add = grown
    add([(1, "a b a b a c", "x"), (2, "a b", "y")])
    word_graph.run(spark, docs, out, checkpoint, {"least_weight": 2, "k": 1})
    edges, nodes = found(spark, out)
    assert edges == {("x", "a", "b"): 2, ("x", "b", "a"): 2} and {n[4] for n in nodes.values()} == {"a", "b"}
    with pytest.raises(ValueError, match="more than 1 volumes"):
        word_graph.run(spark, docs, out + "2", checkpoint + "2", {"most_volumes": 1})


def test_training_table_reruns_and_serves_another_graph(spark, tmp_path):
    rows = str(tmp_path / "rows")
    spark.createDataFrame([(i % 7, (i * i) % 11, None if i == 5 else 1.5) for i in range(60)] + [(None, 3, 1.0), (2, None, 1.0)], "a long, b long, x double").write.parquet(rows)
    config = {"pre": "a", "post": "b", "weight": "x", "parts": 2}
    first = training_table.run(spark, rows, str(tmp_path / "one"), config)
    shown = sorted(map(str, training_table.output(spark, str(tmp_path / "one")).collect()))
    assert training_table.run(spark, rows, str(tmp_path / "one"), config) == first
    assert sorted(map(str, training_table.output(spark, str(tmp_path / "one")).collect())) == shown
    assert sorted(d for d in os.listdir(tmp_path / "one" / "table") if "=" in d) == ["split=test", "split=train", "split=val"]
    edges = spark.read.parquet(str(tmp_path / "one" / "edges"))
    assert edges.selectExpr("sum(w)").first()[0] == 59 * 1.5 and edges.where("pre IS NULL OR post IS NULL").isEmpty()
    scale = spark.read.parquet(str(tmp_path / "one" / "scale")).first()
    training_table.run(spark, rows, str(tmp_path / "two"), config | {"pre": "b", "post": "a", "source_scale": str(tmp_path / "one" / "scale")})
    assert spark.read.parquet(str(tmp_path / "two" / "scale")).first() == scale
    raw = {r.id: r["cv_out"] for r in spark.read.parquet(str(tmp_path / "two" / "unscaled")).collect()}
    for r in training_table.output(spark, str(tmp_path / "two")).collect():
        assert abs(r["cv_out"] - (raw[r.id] - scale["mean_cv_out"]) / max(scale["sd_cv_out"], 1e-6)) < 1e-9


def test_training_table_knows_both_ways_of_a_pair(spark, tmp_path):
    """Both kinds of ids are one; weights of zero and below are no edges, either way."""
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (2, 1, 4.0), (1, 3, 1.0), (3, 1, 0.0), (4, 1, 2.0), (1, 4, -2.0), (5, 5, 3.0)], "a long, b long, x double").write.parquet(rows)
    training_table.run(spark, rows, out, {"pre": "a", "post": "b", "pre_prefix": "n", "post_prefix": "n", "weight": "x", "parts": 2})
    edges = {(r.pre, r.post): (r.w, r.w_back) for r in spark.read.parquet(f"{out}/edges").collect()}
    assert edges == {("n1", "n2"): (3, 4), ("n2", "n1"): (4, 3), ("n1", "n3"): (1, None), ("n4", "n1"): (2, None), ("n5", "n5"): (3, 3)}
    raw = {r.id: (r.local_recip_frac_out, r.local_recip_wfrac_out, r.local_recip_frac_in) for r in spark.read.parquet(f"{out}/unscaled").collect()}
    assert raw == {"n1": (0.5, 0.75, 0.5), "n2": (1, 1, 1), "n3": (0, 0, 0), "n4": (0, 0, 0), "n5": (0, 0, 0)}


def test_settings_come_from_a_file_and_unknown_ones_fail(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"k": 3}))
    assert common.configured(spark, str(path), word_graph.DEFAULTS) == word_graph.DEFAULTS | {"k": 3}
    path.write_text(json.dumps({"kk": 3}))
    with pytest.raises(ValueError, match="kk"):
        common.configured(spark, str(path), word_graph.DEFAULTS)


def test_command_lines(spark, grown, tmp_path):
    docs, out, checkpoint, add = grown
    add(FIRST)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"pre": "lang", "post": "doc_id", "parts": 1}))
    for command in (["jobs.word_graph", "--documents", docs, "--out", out, "--checkpoint", checkpoint], ["jobs.training_table", "--rows", docs, "--out", out + "-t", "--config", str(config)]):
        done = subprocess.run([sys.executable, "-m", *command], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=2 pyspark-shell"})
        assert done.returncode == 0 and "done:" in done.stderr, done.stdout + done.stderr
    assert found(spark, out) == plain(FIRST)
    assert training_table.output(spark, out + "-t").count() == 9


def test_word_graph_of_one_batch_is_not_added_up_again(spark, tmp_path):
    """behind tells volumes of one batch; volumes with spaces, of which one begins like another, stay apart."""
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    rows = [("x y x y", "a b"), ("x y", "a"), ("b x y", "a")]
    spark.createDataFrame(rows, "text string, lang string").coalesce(1).write.parquet(docs)
    word_graph.take_new(spark, docs, out, f"{out}/checkpoint", word_graph.DEFAULTS)
    assert word_graph.behind(spark, out, 10) == {"a b": (0, 0), "a": (0, 0)}
    word_graph.run(spark, docs, out, f"{out}/checkpoint")
    spark.createDataFrame(rows[:1], "text string, lang string").write.mode("append").parquet(docs)
    word_graph.take_new(spark, docs, out, f"{out}/checkpoint", word_graph.DEFAULTS)
    assert word_graph.behind(spark, out, 10) == {"a b": (0, 1)}
    word_graph.run(spark, docs, out, f"{out}/checkpoint")
    got = {(r.kind, r.volume, r.pre, r.post): (r.w, r.n_in, r.n_out, r.syn_in, r.syn_out, r.tokens) for r in word_graph.output(spark, out).collect()}
    assert got == {
        ("edge", "a b", "x", "y"): (4, *[None] * 5), ("edge", "a b", "y", "x"): (2, *[None] * 5), ("edge", "a", "x", "y"): (2, *[None] * 5), ("edge", "a", "b", "x"): (1, *[None] * 5),
        ("node", "a b", "x", None): (None, 1, 1, 2, 4, "y y"), ("node", "a b", "y", None): (None, 1, 1, 4, 2, "x x"),
        ("node", "a", "x", None): (None, 1, 1, 1, 2, "y b"), ("node", "a", "y", None): (None, 1, 0, 2, 0, "x"), ("node", "a", "b", None): (None, 0, 1, 0, 1, "x"),
    }
