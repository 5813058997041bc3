import numpy as np
import pytest

from graftline import registry
from graftline.plans import reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    return registry._report_rows(spark, SF)


def test_forward_parts_equal_plain_ones(spark, both):
    source, target = both
    found = reports.forward_mechanism(source, target, least_cells=3, least_types=3, rounds=(2,))
    calls = {r.id: r for r in reports.read_out(source.where("split = 'train'"), target, 0.01).collect()}
    rows, train = {r.id: r for r in target.collect()}, [r for r in source.collect() if r.split == "train"]
    assert calls.keys() == rows.keys()
    assert abs(found["A"].first().accuracy - np.mean([c.ok for c in calls.values()])) < 1e-12

    x = np.array([r.x for r in train])
    mean, sd = x.mean(0), x.std(0)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit((x - mean) / sd)
    asked = [r for r in rows.values() if r.cell_type in {t.cell_type for t in train}]
    near = np.argmax(unit((np.array([r.x for r in asked]) - mean) / sd) @ a.T, axis=1)
    same = np.array([train[k].cell_type == r.cell_type for k, r in zip(near, asked, strict=True)])
    for r in found["E"].collect():
        pick = np.array([q.label == r.true for q in asked])
        assert r.n == pick.sum() and abs(r.same_type - same[pick].mean()) < 1e-12
    chance = np.mean([sum(t.cell_type == r.cell_type for t in train) / len(train) for r in asked])
    assert abs(found["E chance"].first().chance - chance) < 1e-12 and sum(r.n for r in found["E by neighbour"].collect()) == len(asked)
    assert sum(r.n for r in found["C"].collect()) == len([1 for c in calls.values() if sum(d.label == c.label for d in calls.values()) >= 40])
    assert [r.what for r in found["D"].collect()] == ["none", "2 rounds"] and "all" in {r["class"] for r in found["B"].collect()}


def test_counts_cannot_be_read_after_projection(spark, both):
    source, _ = both
    wide = source.selectExpr("id", "transform(slice(x, 1, 16), v -> v + 0.3 * ln(1 + syn_out)) AS x", *reports.COUNTS)
    fit = lambda df: (np.array([r.x for r in df.collect()]), np.log1p([r.syn_out for r in df.collect()]))

    def r2(df):
        x, y = fit(df.orderBy("id"))
        x = np.hstack([x - x.mean(0), np.ones((len(x), 1))])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return 1 - left.var() / y.var()

    assert r2(wide) > 0.3 > 0.2 > r2(reports.without_counts(wide, wide, 4))


def test_reverse_parts_add_up(spark, both):
    source, target = both
    found = {k: v.collect() for k, v in reports.reverse_drop(source, target, "1").items()}
    n = target.count()
    assert sum(r.n for r in found["confusion"]) == n == sum(r.n for r in found["by coverage"])
    mine = target.where("label = '1'").count()
    assert sum(r.n for r in found["types"]) == mine == sum(r.n for r in found["counts"]) == sum(r.n for r in found["quartiles"])
    assert found["test"][0].n1 + found["test"][0].n2 == mine and {r.what for r in found["score"]} == {"source statistics", "own statistics"}
    of = lambda rows, label=None: {r.cell_type for r in rows if label in (None, r.label)}
    s, t = source.collect(), target.collect()
    assert abs(found["coverage"][0].all_rows - np.mean([r.cell_type in of(s) for r in t])) < 1e-12
    assert abs(found["coverage"][0].of_class - np.mean([r.cell_type in of(s, "1") for r in t if r.label == "1"])) < 1e-12
