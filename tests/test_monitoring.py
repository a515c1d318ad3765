"""Ranges by sampled splitters, features as groups, blocked products, densities and tree explanations against plain loops."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskengine.operators import features as fe
from riskengine.operators import learn as ml
from riskengine.operators import monitor as mo
from riskengine.operators.ordering import exact_quantiles, grouped_quantiles, ranged

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- ranges


def test_one_far_value_leaves_the_ranges_balanced(spark):
    points = spark.range(40000).select((F.col("id") * 0.5).alias("v")).unionByName(spark.createDataFrame([(1e12,), (-1e300,)], "v double"))
    sizes = {r._b: r["count"] for r in ranged(points, "v", (), 64).groupBy("_b").count().collect()}
    assert sum(sizes.values()) == 40002 and set(sizes) == set(range(64)) and max(sizes.values()) < 4 * 40002 / 64
    edges = ranged(points, "v", (), 64).groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("values", [[], [3.0], [2.0] * 50, [1.0, 1e12, *np.arange(3000) / 7], list(np.random.default_rng(1).normal(size=5000).round(2))])
def test_quantiles_are_numpys(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    got = exact_quantiles(df, "v", SHARES).first().q
    assert got == ([None] * len(SHARES) if not len(values) else pytest.approx(np.quantile(values, SHARES).tolist()))


def test_quantiles_of_all_features_read_the_table_once(spark, tmp_path):
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({f"f{k}": draw.normal(k, 1 + k, 700).round(1) for k in range(12)})
    frame.iloc[::5, 3] = np.nan
    frame["f4"] = 1.0
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    few, many = (mo.melt(df, [f"f{k}" for k in range(n)]) for n in (2, 12))
    got = {r.feature: r.q for r in grouped_quantiles(many, SHARES).collect()}
    for c in frame:
        assert got[c] == pytest.approx(np.quantile(frame[c].dropna(), SHARES).tolist())
    scans = [plan(grouped_quantiles(x, SHARES)).count("Relation [") for x in (few, many)]
    assert scans[0] == scans[1]
    side = lambda n: plan(mo.psi_table(df, df, [f"f{k}" for k in range(n)])).count("Relation [")
    assert side(2) == side(12)


def test_psi_of_quantiles_against_a_loop(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(0, 1, 900).round(2), np.concatenate([draw.normal(0.5, 1.5, 700).round(2), [99.0, -99.0]])
    frame = lambda v: spark.createDataFrame([(float(x), 1.0, None) for x in v], "v double, one double, none double")
    got = {r.feature: (r.psi, r.status) for r in mo.psi_table(frame(a), frame(b), ["v", "one", "none"]).collect()}
    q = np.unique(np.quantile(a, np.arange(11) / 10))
    share = lambda x: np.array([((np.searchsorted(q, x, "right") - 1).clip(max=9) == k)[(x >= q[0]) & (x <= q[-1])].sum() for k in range(10)]) / len(x)
    e, o = (np.where(s > 0, s, 1e-4) for s in (share(a), share(b)))
    want = ((e - o) * np.log(e / o)).sum()
    assert got["v"] == (pytest.approx(want), "critical" if want > 0.2 else "warning") and got["none"] == (0.0, "stable")


def test_codes_of_texts_that_begin_alike(spark):
    values = [f"{'same beginning' * 6}{k:04d}" for k in range(300)] + ["", "é", "z"]
    got = fe.dense_codes(spark.createDataFrame([(v,) for v in values], "_v string")).collect()
    assert {r._v: r._code for r in got} == {v: k for k, v in enumerate(sorted(values, key=str.encode))}


def test_drift_of_two_sides_is_drift_from_a_baseline(spark):
    draw = np.random.default_rng(4)
    rows = [(int(draw.random() < 0.5), *[None if draw.random() < gone else float(draw.normal(k, 1)) for k, gone in ((0, 0.0), (3, 0.4), (1, 0.95))], 5.0) for _ in range(1200)]
    rows += [(1, 50.0, -4.0, None, 5.0)] * 40
    df = spark.createDataFrame(rows, "live int, a double, b double, rare double, same double")
    names = ["a", "b", "rare", "same"]
    got = mo.drift_between(mo.melt(df, names, ("live",)))
    want = mo.drift(mo.baseline(mo.melt(df.filter("live = 0"), names)), mo.melt(df.filter("live = 1"), names))
    for x, y in zip(got.orderBy("feature").collect(), want.orderBy("feature").collect(), strict=True):
        assert (x.feature, x.status) == (y.feature, y.status) and (x.psi, x.null_drift) == pytest.approx((y.psi, y.null_drift))


def test_ks_with_a_far_value(spark):
    draw = np.random.default_rng(5)
    y = draw.integers(0, 2, 800)
    v = np.where(y == 1, draw.normal(1, 1, 800), draw.normal(0, 1, 800)).round(2)
    v[0] = 1e12
    got = mo.ks_scores(spark.createDataFrame([("v", int(a), float(b)) for a, b in zip(y, v)], "feature string, y int, value double")).first()
    at = np.unique(v)
    want = np.abs([(v[y == 1] <= x).mean() - (v[y == 0] <= x).mean() for x in at]).max()
    assert got.ks == pytest.approx(want)


def test_scores_that_lie_close_together_are_spread_out(spark):
    """ROC and precision of scores of which nearly all are below 0.0001."""
    from riskengine.operators import evaluate as ev

    draw = np.random.default_rng(12)
    p = np.append(np.unique(draw.random(3000) * 1e-4), [0.5, 0.99])
    y = (draw.random(len(p)) < 0.1 + 3000 * p.clip(max=1e-4)).astype(int)
    df = spark.createDataFrame([(int(a), float(b), 1.0) for a, b in zip(y, p)], "y int, p double, amt double").repartition(3)
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    down = order[::-1]
    precision = np.cumsum(y[down]) / np.arange(1, len(p) + 1)
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(auc) and ev.average_precision(df).first().average_precision == pytest.approx((precision * y[down]).sum() / y.sum())
    sizes = [r["count"] for r in ranged(ev.by_score(df), "p", (), 32).groupBy("_b").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 5 * len(p) / 32


# --- products and densities


def test_correlations_of_wide_tables(spark, tmp_path):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 400)) + 1e6
    x[:, 1] = x[:, 0] * -2 + draw.normal(size=300) * 0.1
    x[:, 399] = x[:, 250] + draw.normal(size=300) * 0.2
    x[:, 7] = 4.0
    frame = pd.DataFrame(x, columns=[f"c{k}" for k in range(400)])
    frame.iloc[::9, 33] = np.nan
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide")).repartition(5)
    full = frame.fillna(-999.0).drop(columns="c7")
    want = full.corr().abs()
    found = mo.correlated_pairs(df, list(frame.columns))
    got = found.toPandas()
    assert len(got) == 399 * 398 // 2 and not got[["a", "b"]].isin(["c7"]).any().any()
    assert np.abs(got.r.to_numpy() - want.to_numpy()[full.columns.get_indexer(got.a), full.columns.get_indexer(got.b)]).max() < 1e-9
    strong = mo.correlated_pairs(df, list(frame.columns), 0.9).collect()
    assert {(r.a, r.b) for r in strong} == {("c0", "c1"), ("c250", "c399")}
    assert len(plan(found)) < 20000 and "corr(" not in plan(found)


def test_products_in_several_passes(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(90, 10))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{k}" for k in range(10)])).repartition(4)
    blocks, n = mo.product_blocks(df, df.columns, block=4, held=2 * 8 * 16)
    own = x - x.mean(axis=0)
    full = own.T @ own
    got = {(r.i, r.j): np.array(r.g) for r in blocks.collect()}
    assert n == 90 and set(got) == {(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)}
    for (i, j), g in got.items():
        assert g.reshape(min(4, 10 - 4 * i), -1) == pytest.approx(full[4 * i : 4 * i + 4, 4 * j : 4 * j + 4])


def test_correlations_of_little(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert mo.correlated_pairs(df, ["a", "b"]).count() == 0 and mo.correlated_pairs(df, ["a"]).count() == 0 and mo.correlated_pairs(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("values", [np.random.default_rng(8).normal(size=3000), np.random.default_rng(9).integers(0, 40, 500) / 7.0, np.array([0.0, 1.0]), np.append(np.random.default_rng(1).random(200), 1e6)])
def test_density_is_the_sum_of_kernels(spark, values):
    got = mo.density(spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "p double"), "p").orderBy("k").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min(), values.max(), 100)
    want = np.exp(-(((at[:, None] - values) / h) ** 2) / 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in got] == pytest.approx(at.tolist()) and np.abs(np.array([r.density for r in got]) - want).max() < 1e-9 * want.max()


def test_density_of_nothing_and_of_one_value(spark):
    assert mo.density(spark.createDataFrame([(1.0,), (1.0,)], "p double"), "p").count() == 0
    assert mo.density(spark.createDataFrame([], "p double"), "p").count() == 0


# --- trees


def grown(draw, depth: int, features: int, k: list | None = None, cover: float = 64.0) -> list:
    """A random tree as a list of nodes."""
    nodes = [] if k is None else k
    at = len(nodes)
    nodes.append(None)
    if depth == 0 or draw.random() < 0.15 and at:
        nodes[at] = (-1, 0.0, -1, -1, cover, float(draw.normal()))
        return nodes
    part = float(draw.uniform(0.1, 0.9)) * cover
    left = len(nodes)
    grown(draw, depth - 1, features, nodes, part)
    right = len(nodes)
    grown(draw, depth - 1, features, nodes, cover - part)
    nodes[at] = (int(draw.integers(0, features)), float(draw.normal()), left, right, cover, 0.0)
    return nodes


def known_value(nodes: list, x: np.ndarray, fixed: frozenset, at: int = 0) -> float:
    """A tree's mean when only the features ``fixed`` are known."""
    f, t, left, right, cover, value = nodes[at]
    if f < 0:
        return value
    if f in fixed:
        return known_value(nodes, x, fixed, left if x[f] <= t else right)
    return (nodes[left][4] * known_value(nodes, x, fixed, left) + nodes[right][4] * known_value(nodes, x, fixed, right)) / cover


@pytest.mark.parametrize("seed", range(6))
def test_shares_are_the_mean_over_all_subsets(seed):
    draw = np.random.default_rng(seed)
    trees = [(float(draw.uniform(0.1, 2)), grown(draw, int(draw.integers(1, 6)), 5)) for _ in range(3)]
    x = draw.normal(size=(7 if seed % 2 else 70, 5))
    got = ml.shapley(trees, x)
    for r, row in enumerate(x[:7]):
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = sum(
                factorial(len(s)) * factorial(4 - len(s)) / factorial(5) * w * (known_value(t, row, frozenset((*s, f))) - known_value(t, row, frozenset(s)))
                for w, t in trees for n in range(5) for s in combinations(others, n)
            )
            assert got[r, f] == pytest.approx(want, abs=1e-12)
    full = [sum(w * known_value(t, row, frozenset(range(5))) for w, t in trees) for row in x]
    assert (got.sum(axis=1) + ml.mean_value(trees)).tolist() == pytest.approx(full)


def test_deep_paths_of_many_features_stay_cheap():
    # one path of 40 features: all subsets would be 2^40
    nodes = []
    for k in range(40):
        nodes += [(k, 0.0, 2 * k + 1, 2 * k + 2, 100.0 - k, 0.0), (-1, 0.0, -1, -1, 1.0, float(k))]
    nodes.append((-1, 0.0, -1, -1, 60.0, 7.0))
    x = np.random.default_rng(0).normal(size=(50, 40))
    got = ml.shapley([(1.0, nodes)], x)
    first = [next((k for k in range(40) if r[k] <= 0), 7.0) for r in x]
    assert (got.sum(axis=1) + ml.mean_value([(1.0, nodes)])).tolist() == pytest.approx(first, abs=1e-9)


def test_fifty_rounds_of_forty_features_are_explained(spark):
    draw = np.random.default_rng(11)
    names = [f"f{k}" for k in range(40)]
    x = draw.random((600, 40))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * x[:, 2] * x[:, 3] + 0.1 * draw.normal(size=600) > 0.75).astype(int)
    df = spark.createDataFrame([(k, *map(float, r), int(v)) for k, (r, v) in enumerate(zip(x, y))], f"id long, {', '.join(f'{n} double' for n in names)}, y int").coalesce(2).cache()
    model = ml.fit_trees(df, names, "y", rounds=50, depth=6)
    trees = ml.model_trees(model)
    assert len(trees) == 50
    raw = {r.id: float(r.rawPrediction[1]) for r in model.stages[1].transform(model.stages[0].transform(df)).select("id", "rawPrediction").collect()}
    got = {r.id: sum(e.impact for e in r.explanations) for r in ml.explain_trees(df, model, ("id",)).collect()}
    assert len(got) == 600 and all(got[k] + ml.mean_value(trees) == pytest.approx(raw[k]) for k in raw)
    few = ml.explain_trees(df, model, ("id",), top=3).first()
    assert len(few.explanations) == 3 and abs(few.explanations[0].impact) >= abs(few.explanations[2].impact) and few.explanations[0].feature in ("f0", "f1")
