"""Boosted trees by sums over bins against MLlib's own learner."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from riskengine.operators import boosting as bo
from riskengine.operators import learn as ml


def table(spark, n=600):
    draw = np.random.default_rng(8)
    x = draw.integers(0, 6, (n, 3)).astype(float)
    y = (x[:, 0] * x[:, 1] + draw.normal(0, 4, n) > 8).astype(float)
    return spark.createDataFrame([(k, *map(float, x[k]), float(y[k]), 1.0 + (k % 3), k % 4 == 0) for k in range(n)], "id long, a double, b double, c double, label double, _w double, _held boolean").coalesce(1)


@pytest.mark.parametrize("held", [False, True])
def test_sums_over_bins_learn_what_mllib_learns(spark, held):
    rows = table(spark)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxIter=6, maxDepth=3, seed=42, stepSize=0.3, minInstancesPerNode=5)
    rows = rows if held else rows.filter("NOT _held")
    if held:
        gbt = gbt.setValidationIndicatorCol("_held")
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    want, got = gbt.fit(ready), bo.fit_boosted(rows, ["a", "b", "c"], gbt)
    assert got.treeWeights == want.treeWeights and got.getMaxIter() == 6
    said = [{r.id: r.p for r in m.transform(ready).select("id", vector_to_array("probability")[1].alias("p")).collect()} for m in (got, want)]
    assert said[0] == {k: pytest.approx(p, abs=1e-9) for k, p in said[1].items()}
    assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()), abs=1e-9)


def test_records_are_learned_from_as_bytes(spark):
    """Blocks hold a byte for each feature, all records are in them, and counts at every node are of records."""
    rows = table(spark, 300)
    blocks = bo._blocks(rows.select("a", "b", "c", "label", "_w", "_held"), [np.array([0.5, 3.5])] * 3, 2).collect()
    assert sum(b.bins.shape[1] for b in blocks) == 300 and {b.bins.dtype.name for b in blocks} == {"uint8"}
    model = ml.fit_trees(rows, ["a", "b", "c"], "label", rounds=2, depth=3)
    for _, nodes in ml.model_trees(model):
        assert nodes[0][4] == 300 and all(n[4] == nodes[n[2]][4] + nodes[n[3]][4] for n in nodes if n[0] >= 0)


def test_thresholds_part_values_by_weight():
    assert bo.thresholds(np.array([1.0, 3.0, 3.0, np.nan, 9.0]), np.ones(5)).tolist() == [2.0, 6.0]
    values = np.arange(1000.0)
    cut = bo.thresholds(values, np.where(values < 100, 9.0, 1.0))
    assert len(cut) <= 31 and (cut < 100).sum() in (15, 16) and bo.thresholds(np.full(3, 7.0), np.ones(3)).size == 0


@pytest.mark.parametrize("features_share", [1.0, 0.5])
def test_cells_give_the_auc_that_records_give(spark, monkeypatch, features_share):
    rows = table(spark).selectExpr("id", "a", "b", "c", "CAST(label AS INT) AS y", "CAST(id % 3 AS INT) AS fold")
    settings = {"rounds": 8, "depth": 2, "step": 0.3, "least_rows": 20, "features_share": features_share, "least_gain": 1e-3}
    by_cells = ml.fold_score(rows, "fold", ["a", "b", "c"], "y", **settings)
    assert sum(b.n.sum() for b in ml.fold_cells(rows, "fold", ["a", "b", "c"], "y")) == 400 + 600
    monkeypatch.setattr(bo, "MOST_CELLS", 10)
    assert ml.fold_cells(rows, "fold", ["a", "b", "c"], "y") is None
    assert by_cells == pytest.approx(ml.fold_score(rows, "fold", ["a", "b", "c"], "y", **settings), abs=1e-9) and 0.5 < by_cells < 1


def test_a_cell_gives_a_binomial_part_of_its_records():
    b = bo.Block(np.zeros((1, 2), np.uint8), np.ones(2), np.ones(2), np.array([False, True]), np.zeros(2), 7, np.array([10000, 10000]))
    assert b.taken(1.0, 3).tolist() == [10000, 0] and b.taken(0.6, 3)[1] == 0 and 5800 < b.taken(0.6, 3)[0] < 6200
