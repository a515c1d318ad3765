"""Forests by sums over cells against MLlib's own learner, and on many equal records."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskengine.operators import forest as fo
from riskengine.operators import learn as ml
from riskengine.operators.evaluate import roc_auc, roc_auc_of

NAMES = ["a", "b", "c"]


def table(spark, n=900, seed=5):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 7, (n, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + draw.normal(0, 6, n) > 9
    return spark.createDataFrame([(k, *map(float, x[k]), bool(y[k])) for k in range(n)], "id long, a double, b double, c double, y boolean").coalesce(1)


def mllib(rows, **settings):
    ready = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.withColumn("label", F.col("y").cast("double")))
    model = RandomForestClassifier(featuresCol="features", labelCol="label", seed=42, **settings).fit(ready)
    return model, model.transform(ready).select("id", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


@pytest.mark.parametrize("depth", [1, 4])
def test_a_tree_of_cells_is_mllibs(spark, depth):
    rows = table(spark)
    model, want = mllib(rows, numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all")
    forest, cells = fo.fit_forest(rows, NAMES, F.col("y"), trees=1, depth=depth, bootstrap=False)
    scores = {r.id: r.p for r in want.collect()}
    x = np.array([(r.a, r.b, r.c) for r in rows.orderBy("id").collect()])
    got = forest.probability(np.stack([np.searchsorted(t, x[:, k], "left") for k, t in enumerate(forest.cuts)]))
    assert got.tolist() == pytest.approx([scores[k] for k in range(len(x))], abs=1e-12)
    assert list(forest.importances()) == pytest.approx(list(model.featureImportances.toArray()), abs=1e-12)
    assert roc_auc_of(fo.score_cells(cells, forest)).first().roc_auc == pytest.approx(roc_auc(want).first().roc_auc, abs=1e-12)


def test_bags_and_roots_of_features_give_what_mllib_gives(spark):
    rows = table(spark, 3000)
    model, want = mllib(rows, numTrees=60, maxDepth=4)
    forest, cells = fo.fit_forest(rows, NAMES, F.col("y"), trees=60, depth=4)
    assert len(forest.trees) == 60 and len({tuple(t.value) for t in forest.trees}) == 60
    assert roc_auc_of(fo.score_cells(cells, forest)).first().roc_auc == pytest.approx(roc_auc(want).first().roc_auc, abs=0.01)
    assert list(forest.importances()) == pytest.approx(list(model.featureImportances.toArray()), abs=0.05)
    saw = [t.sums[0][0] for t in forest.trees]  # a bag is Poisson(1) of every record, however many are in a cell
    assert abs(np.mean(saw) - 3000) < 30 and 25 < np.std(saw) < 90


def test_equal_records_are_learned_from_once_and_counted(spark, monkeypatch):
    """Forty times the records are the same cells with forty times the counts, and no more blocks to go over."""
    few, seen = table(spark, 500), []
    blocks = fo._blocks
    monkeypatch.setattr(fo, "_blocks", lambda cells, n: seen.append(sum(b.bins.shape[1] for b in blocks(cells, n).collect())) or blocks(cells, n))
    for rows in (few, few.crossJoin(spark.range(40).select(F.lit(0).alias("_")))):
        a, b = rows.filter("NOT y"), rows.filter("y")
        ml.adversarial(a, b, NAMES, trees=3, depth=2).first()
    assert seen[0] == seen[1] == few.select(*NAMES).distinct().count()
    forest, cells = fo.fit_forest(rows, NAMES, F.col("y"), trees=3, depth=2, bootstrap=False)
    sums = cells.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    assert (sums.n0, sums.n1) == (a.count(), b.count()) and {t.sums[0][0] for t in forest.trees} == {20000.0}


def test_a_forest_does_not_change_with_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(fo, "_BLOCK", 50)
    rows = table(spark)
    found = [fo.fit_forest(r, NAMES, F.col("y"), trees=5, depth=4)[0].trees for r in (rows, rows.repartition(7))]
    assert [t.value for t in found[0]] == [t.value for t in found[1]] and [t.feature for t in found[0]] == [t.feature for t in found[1]]


def test_a_sample_for_thresholds_is_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(fo, "_SAMPLE", 100)
    rows = spark.range(3000).select(F.rand(7).alias("a"), (F.col("id") % 2 == 0).alias("y"))
    found = [fo.fit_forest(rows, ["a"], F.col("y"), trees=2, depth=2) for _ in range(2)]
    assert [f.cuts[0].tolist() for f, _ in found] == [found[0][0].cuts[0].tolist()] * 2 and len(found[0][0].cuts[0]) == 31
    assert found[0][1].agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] == 3000


def test_one_table_or_none_tells_nothing(spark):
    rows = table(spark, 40).withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a")))
    none = rows.limit(0)
    for a, b in ((rows, none), (none, rows), (none, none)):
        got = ml.adversarial(a, b, NAMES, trees=4, depth=3).first()
        assert got.auc == 0.5 and not got.drifted and got.top_features == "a,b,c"


def test_nulls_are_a_value_of_their_own(spark):
    a = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.rand(1)).alias("a"), F.rand(2).alias("b"))
    got = ml.adversarial(a, a.withColumn("a", F.rand(3)), ["a", "b"], trees=20, depth=3).first()
    assert got.auc > 0.7 and got.top_features == "a,b"
