"""Learned models on MLlib: calibration, grouped PCA, boosted trees, adversarial checks, explanations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.operators.boosting import Block, auc_by_cells, cells, fit_boosted, sampled_thresholds
from riskengine.operators.evaluate import known, roc_auc, roc_auc_of
from riskengine.operators.forest import fit_forest, score_cells
from riskengine.operators.search import SPACE, Range, search
from riskengine.session import materialize, shared_path


def fit_calibration(df: DataFrame, how: str = "isotonic", least: int = 50):
    """A model from ``p`` to the chance of ``y``; None (identity) for under ``least`` rows."""
    rows = known(df).select(F.col("y").cast("double").alias("label"), "p")
    n = rows.count()
    if n < least:
        return None
    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(rows)
    if how == "isotonic":
        return IsotonicRegression().fit(rows)
    return LogisticRegression(regParam=1 / n, standardization=False).fit(rows)


def calibrate(df: DataFrame, model) -> DataFrame:
    """``calibrated``, within 0 and 1; rows without a score have none."""
    if model is None:
        return df.withColumn("calibrated", F.col("p"))
    v = VectorAssembler(inputCols=["p"], outputCol="features", handleInvalid="keep").transform(df.filter("p IS NOT NULL"))
    out = model.transform(v)
    value = F.col("prediction") if isinstance(out.schema["prediction"].dataType, T.DoubleType) and "probability" not in out.columns else vector_to_array("probability")[1]
    out = out.select(*df.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("calibrated"))
    return out.unionByName(df.filter("p IS NULL").withColumn("calibrated", F.lit(None).cast("double")))


@dataclass
class PcaGroups:
    models: list[tuple[list[str], PipelineModel, int]]


def fit_pca(df: DataFrame, columns: list[str], share: float = 0.97, most: int = 10) -> PcaGroups:
    """One PCA for each set of columns with equally many nulls, of components up to ``share`` of the variance."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    groups: dict[int, list[str]] = {}
    for c in columns:
        groups.setdefault(nulls[c], []).append(c)
    models = []
    for names in groups.values():
        k = min(most, len(names))
        steps = [VectorAssembler(inputCols=names, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_p")]
        model = Pipeline(stages=steps).fit(df.select(*names).fillna(0.0))
        kept = int(np.searchsorted(np.cumsum(model.stages[-1].explainedVariance.toArray()), share) + 1)
        models.append((names, model, min(k, kept)))
    return PcaGroups(models)


def apply_pca(df: DataFrame, fitted: PcaGroups) -> DataFrame:
    """Components in place of the columns; a group with an absent column is left as it is."""
    for g, (names, model, k) in enumerate(fitted.models):
        if set(names) <= set(df.columns):
            rest = [c for c in df.columns if c not in names]
            df = model.transform(df.fillna(0.0, subset=names)).select(*rest, *[vector_to_array("_p")[i].alias(f"pca_{g}_{i}") for i in range(k)])
    return df


def _weighted(df: DataFrame, features: list[str], label: str, bad: int, good: int, held: Column | None = None) -> DataFrame:
    """Records with a label as ``fit_boosted`` takes them; the rarer class weighs by the ratio of the classes."""
    weight = F.when(F.col(label) == 1, float(good) / max(1, bad)).otherwise(1.0)
    return df.filter(F.col(label).isNotNull()).select(*[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)).alias(c) for c in features], F.col(label).cast("double").alias("label"), weight.alias("_w"), F.coalesce(held if held is not None else F.lit(False), F.lit(False)).alias("_held"))


def fit_trees(
    df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 5, seed: int = 42, held: Column | None = None,
    step: float = 0.1, least_rows: int = 1, rows_share: float = 1.0, features_share: float = 1.0, least_gain: float = 0.0,
) -> PipelineModel:
    """Boosted trees; the rarer class weighs by the ratio of the classes. Nulls are -999.

    ``step`` is the learning rate; a tree sees ``rows_share`` of the rows, a split
    ``features_share`` of the features; a leaf has ``least_rows`` and a split ``least_gain``.
    Rows for which ``held`` is true are not learned from: rounds stop when they no longer help on these.
    """
    n = df.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).first()
    rows = _weighted(df, features, label, n.a, n.b, held)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=step, minInstancesPerNode=least_rows, subsamplingRate=rows_share, minInfoGain=least_gain)
    if features_share < 1:
        trees = trees.setFeatureSubsetStrategy(str(features_share))
    if held is not None:
        trees = trees.setValidationIndicatorCol("_held")
    return PipelineModel(stages=[VectorAssembler(inputCols=features, outputCol="features"), fit_boosted(rows, features, trees)])


def score_trees(df: DataFrame, model: PipelineModel) -> DataFrame:
    names = model.stages[0].getInputCols()
    clash = [c for c in ("features", "rawPrediction", "prediction", "probability") if c in df.columns]
    own = df.drop(*clash)
    ready = own.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) for c in names})
    v = VectorAssembler(inputCols=[f"_f_{c}" for c in names], outputCol="features").transform(ready)
    return model.stages[1].transform(v).select(*own.columns, vector_to_array("probability")[1].alias("probability"))


def fold_score(df: DataFrame, folds: str, features: list[str], label: str, **settings) -> float:
    """The mean ROC AUC over expanding-window folds of trees with some settings; from cells where there are few (``fold_cells``)."""
    gathered = fold_cells(df, folds, features, label)
    if gathered:
        return float(np.mean([auc_by_cells(b, _said(settings)) for b in gathered]))
    last, aucs = df.agg(F.max(folds)).first()[0] or 0, []
    for k in range(1, last + 1):
        model = fit_trees(df.filter(F.col(folds) < k), features, label, **settings)
        test = score_trees(df.filter(F.col(folds) == k), model).select(F.col(label).alias("y"), F.col("probability").alias("p"))
        aucs.append(roc_auc(test).first().roc_auc)
    return float(np.mean(aucs)) if aucs else 0.5


def fold_cells(df: DataFrame, folds: str, features: list[str], label: str, seed: int = 42) -> list[Block] | None:
    """For each expanding-window fold its records as cells, those of the fold held; None where they may be too many."""
    last, out = df.agg(F.max(folds)).first()[0] or 0, []
    for k in range(1, last + 1):
        n = df.filter(F.col(folds) < k).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).first()
        rows = _weighted(df.filter(F.col(folds) <= k), features, label, n.a, n.b, F.col(folds) == k)
        found = cells(rows, features, sampled_thresholds(rows.filter("NOT _held"), features, max(1, n.a + n.b), seed))
        if found is None:
            return None
        out.append(found)
    return out


def _said(settings: dict) -> dict:
    """MLlib's names of the settings of ``fit_trees``."""
    s = {"rounds": 50, "depth": 5, "seed": 42, "step": 0.1, "least_rows": 1, "rows_share": 1.0, "features_share": 1.0, "least_gain": 0.0} | settings
    share = "all" if s["features_share"] >= 1 else str(s["features_share"])
    return {"maxIter": s["rounds"], "maxDepth": s["depth"], "seed": s["seed"], "stepSize": s["step"], "minInstancesPerNode": s["least_rows"], "subsamplingRate": s["rows_share"], "minInfoGain": s["least_gain"], "featureSubsetStrategy": share}


def settings_search(df: DataFrame, folds: str, features: list[str], label: str, tries: int = 20, seed: int = 42, space: dict[str, Range] | None = None, at_random: int = 10) -> DataFrame:
    """``try``, each setting and ``auc`` of the tries of a Parzen search, in order; ``df`` is read for each, so it should be a table.

    Where the features have few bins together, the folds' records are gathered once as cells,
    and each fold of a try is a task that learns from and scores all of them by these; the
    first, random tries are made at once. Else each try reads the records for each pass.
    """
    space, sc = SPACE if space is None else space, df.sparkSession.sparkContext
    gathered = fold_cells(df, folds, features, label)
    if gathered:
        shared, k = sc.broadcast(gathered), len(gathered)

        def together(some: list[dict]) -> list[float]:
            todo = [(fold, _said(settings)) for settings in some for fold in range(k)]
            aucs = sc.parallelize(todo, len(todo)).map(lambda t: auc_by_cells(shared.value[t[0]], t[1])).collect() if todo else []
            return [float(np.mean(aucs[at : at + k])) for at in range(0, len(aucs), k)]

        done = search(lambda settings: together([settings])[0], space, tries, seed, at_random, together)
    else:
        done = search(lambda settings: fold_score(df, folds, features, label, **settings), space, tries, seed, at_random)
    kinds = ", ".join(f"{n} {'int' if r.whole else 'double'}" for n, r in space.items())
    return df.sparkSession.createDataFrame([(k, *[s[n] for n in space], auc) for k, (s, auc) in enumerate(done)], f"try int, {kinds}, auc double")


def expanding_cv(df: DataFrame, test: DataFrame, folds: str, features: list[str], label: str, top: int = 50, **settings) -> tuple[DataFrame, DataFrame]:
    """Trees fitted on each expanding window, stopped early on the fold behind it.

    Gives ``test`` with ``probability``, the mean of the folds' models, and the mean
    ``importance`` of each ``feature`` over the folds, largest first.
    """
    last, models = df.agg(F.max(folds)).first()[0], []
    for k in range(1, last + 1):
        models.append(fit_trees(df.filter(F.col(folds) <= k), features, label, held=F.col(folds) == k, **settings))
        test = score_trees(test, models[-1]).withColumnRenamed("probability", f"_p{k}")
    scored = test.withColumn("probability", sum((F.col(f"_p{k}") for k in range(1, last + 1)), F.lit(0.0)) / last).drop(*[f"_p{k}" for k in range(1, last + 1)])
    return scored, df.sparkSession.createDataFrame(importances(models, top), "feature string, importance double")


def importances(models: list[PipelineModel], top: int = 50) -> list[tuple[str, float]]:
    """Mean importance of each feature over the folds' models, largest first."""
    names = models[0].stages[0].getInputCols()
    mean = np.mean([m.stages[1].featureImportances.toArray() for m in models], axis=0)
    return sorted(((n, float(v)) for n, v in zip(names, mean, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def adversarial(a: DataFrame, b: DataFrame, features: list[str], trees: int = 100, depth: int = 6, most: float = 0.7) -> DataFrame:
    """Whether a forest tells two tables apart: ``auc`` (in sample), ``drifted``, and the five features that do it."""
    both = a.select(*features).withColumn("_t", F.lit(False)).unionByName(b.select(*features).withColumn("_t", F.lit(True)))
    rows = both.select(*[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)).alias(c) for c in features], "_t")
    forest, cells = fit_forest(rows, features, F.col("_t"), trees, depth)
    auc = roc_auc_of(materialize(score_cells(cells, forest), "scores"))
    top = sorted(zip(forest.importances().tolist(), features, strict=True), key=lambda x: (-x[0], x[1]))[:5]
    return auc.select(F.col("roc_auc").alias("auc"), (F.col("roc_auc") > most).alias("drifted"), F.lit(",".join(n for _, n in top)).alias("top_features"))


#: The weight of a tree and its nodes: for each node (feature, threshold, left, right, cover, value); a leaf's feature is -1.
Tree = tuple[float, list[tuple[int, float, int, int, float, float]]]


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and its path: for each feature on it the interval that leads here and the share of rows that pass its splits."""

    value: float
    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray


def leaves(tree: Tree) -> list[Leaf]:
    """The leaves of a tree; splits of one feature on a path are one interval."""
    weight, nodes = tree
    out, todo = [], [(0, {})]
    while todo:
        k, path = todo.pop()
        feature, threshold, left, right, cover, value = nodes[k]
        if feature < 0:
            used = sorted(path)
            at = np.array([path[f] for f in used]).reshape(len(used), 3)
            out.append(Leaf(weight * value, np.array(used, int), at[:, 0], at[:, 1], at[:, 2]))
            continue
        lo, hi, share = path.get(feature, (-np.inf, np.inf, 1.0))
        todo.append((left, path | {feature: (lo, min(hi, threshold), share * nodes[left][4] / cover)}))
        todo.append((right, path | {feature: (max(lo, threshold), hi, share * nodes[right][4] / cover)}))
    return out


def path_shares(share: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """For each row of ``taken`` (which features of a path a record passes) the Shapley shares of a leaf of value 1.

    A feature that is not known passes with its share of the rows. The weight of a subset of
    k of the other m - 1 features, k! (m - 1 - k)! / m!, is the integral of t^k (1 - t)^(m - 1 - k)
    from 0 to 1, so the sum over all subsets is the integral of the product of
    share * (1 - t) + passes * t over the others: a polynomial, which Gauss-Legendre nodes
    integrate exactly. A path of m features costs m squared, not 2^m, and nothing cancels.
    """
    m = taken.shape[1]
    node, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = (node + 1) / 2
    factor = share[None, :, None] * (1 - t) + taken[:, :, None] * t
    others = factor.prod(axis=1)[:, None, :] / factor
    return (taken - share) * (others @ (weight / 2))


def shapley(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Each feature's exact Shapley share of the weighted trees' sum, by the rows that the trees saw.

    Records that pass the same splits of a path share their figures, so a leaf costs its
    path's features for each record and their square for each of the patterns that occur.
    """
    out = np.zeros(x.shape)
    for leaf in (leaf for tree in trees for leaf in leaves(tree)):
        m = len(leaf.feature)
        if not m:
            continue
        values = x[:, leaf.feature]
        taken = (values > leaf.above) & (values <= leaf.upto)
        code = taken @ (1 << np.arange(m, dtype=np.int64))
        some = np.arange(1 << m) if 1 << m <= len(x) else np.unique(code)
        found = path_shares(leaf.share, (some[:, None] >> np.arange(m) & 1).astype(float)) * leaf.value
        out[:, leaf.feature] += found[np.searchsorted(some, code)]
    return out


def mean_value(trees: list[Tree]) -> float:
    """The trees' mean over the rows they saw, which the shares are differences from."""
    return float(sum(leaf.value * leaf.share.prod() for tree in trees for leaf in leaves(tree)))


def model_trees(model: PipelineModel) -> list[Tree]:
    """The trees of a fitted model, from the tables that it is saved as."""
    gbt, path = model.stages[1], shared_path(SparkSession.active(), "trees")
    gbt.write().save(path)
    nodes: dict[int, dict[int, tuple]] = {}
    for r in SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        s = r.split
        leaf = r.leftChild < 0
        nodes.setdefault(r.treeID, {})[r.id] = (-1 if leaf else s.featureIndex, 0.0 if leaf else s.leftCategoriesOrThreshold[0], r.leftChild, r.rightChild, float(r.rawCount), r.prediction)
    return [(float(w), [nodes[t][k] for k in sorted(nodes[t])]) for t, w in enumerate(gbt.treeWeights)]


def explain_trees(df: DataFrame, model: PipelineModel, keep: tuple[str, ...], top: int | None = None) -> DataFrame:
    """``keep`` and ``explanations``, the features' exact contributions to the trees' raw score.

    With ``top`` only those of the ``top`` largest impacts, largest first. The trees' leaves
    go to the tasks with the function; they do not grow with the rows.
    """
    names, trees = model.stages[0].getInputCols(), model_trees(model)
    rows = df.select(F.struct(*keep).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)).alias(f"_f_{c}") for c in names])
    part = T.StructType([T.StructField("feature", T.StringType()), T.StructField("impact", T.DoubleType())])
    schema = T.StructType([rows.schema["_key"], T.StructField("explanations", T.ArrayType(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("feature", pa.string()), ("impact", pa.float64())]))
        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1) if b.num_rows else np.zeros((0, len(names)))
            s = shapley(trees, x)
            flat = pa.StructArray.from_arrays([pa.array(list(names) * b.num_rows, pa.string()), pa.array(s.ravel())], ["feature", "impact"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, len(names)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(of)], ["_key", "explanations"])

    found = rows.mapInArrow(run, schema)
    if top is not None:
        ordered = F.sort_array(F.transform("explanations", lambda e: F.struct(F.abs(e["impact"]).alias("size"), e.alias("e"))), asc=False)
        found = found.withColumn("explanations", F.slice(ordered["e"], 1, top))
    return found.select("_key.*", "explanations")
