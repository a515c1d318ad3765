"""The search of settings, trained and saved ensembles, and learned queries with values."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskengine.operators import features as fe
from riskengine.operators import learn as ml
from riskengine.operators import scoring as sc
from riskengine.operators.search import SPACE, Parzen, Range, search, suggest
from riskengine.plans import catalog
from riskengine.sources import adapters as ad

PLANTED = {"x": Range(-5.0, 5.0), "rate": Range(1e-4, 1.0, log=True), "n": Range(1, 200, whole=True), "idle": Range(0.0, 1.0)}


def planted(s: dict) -> float:
    return -((s["x"] - 3.2) ** 2) / 4 - (np.log10(s["rate"]) + 2.5) ** 2 - ((s["n"] - 150) / 60) ** 2


def test_the_search_beats_random_draws_on_a_planted_optimum():
    found, drawn = [], []
    for seed in range(12):
        found.append(max(v for _, v in search(planted, PLANTED, 60, seed)))
        drawn.append(max(v for _, v in search(planted, PLANTED, 60, seed, at_random=60)))
    assert np.median(found) > np.median(drawn) / 3 and sum(f > d for f, d in zip(found, drawn)) >= 9


def test_the_search_is_the_same_for_a_seed_and_stays_in_its_ranges():
    once, again, other = (search(planted, PLANTED, 30, seed) for seed in (4, 4, 5))
    assert once == again and once != other
    for s, _ in search(lambda s: float(s["depth"]), SPACE, 40, 1):
        assert all(r.lo <= s[n] <= r.hi and isinstance(s[n], int) == r.whole for n, r in SPACE.items())
    ends = {s["n"] for s, _ in search(lambda s: s["n"], {"n": Range(1, 3, whole=True)}, 40, 0)}
    assert ends == {1, 2, 3}


def test_density_of_tries_is_one_over_its_range():
    p = Parzen([0.1, 0.11, 0.5], Range(0.0, 1.0))
    x = np.linspace(0, 1, 20001)
    assert np.exp(p.log_density(x)).mean() == pytest.approx(1.0, abs=1e-3)
    assert p.log_density(np.array([0.1]))[0] > p.log_density(np.array([0.9]))[0]
    assert suggest([({"n": 2}, 1.0)] * 10, {"n": Range(2, 2, whole=True)}, np.random.default_rng(0)) == {"n": 2}


def test_settings_reach_the_trees(spark):
    draw = np.random.default_rng(0)
    rows = [(k, k, float(a), float(draw.random()), int(a + 0.2 * draw.normal() > 0.6)) for k, a in enumerate(draw.random(300))]
    df = fe.time_folds(spark.createDataFrame(rows, "TransactionID long, TransactionDT long, a double, b double, y int"), 2).cache()
    space = {"rounds": Range(2, 4, whole=True), "step": Range(0.05, 0.2, log=True), "depth": Range(2, 3, whole=True), "least_rows": Range(1, 5, whole=True), "rows_share": Range(0.5, 1.0), "features_share": Range(0.5, 1.0), "least_gain": Range(1e-8, 1e-3, log=True)}
    got = ml.settings_search(df, "fold", ["a", "b"], "y", tries=3, space=space, at_random=2).collect()
    assert [r["try"] for r in got] == [0, 1, 2] and all(0.8 < r.auc <= 1 for r in got)
    again = ml.fold_score(df, "fold", ["a", "b"], "y", **{n: got[1][n] for n in space})
    assert again == pytest.approx(got[1].auc)
    model = ml.fit_trees(df, ["a", "b"], "y", rounds=2, least_rows=150, step=0.07, rows_share=0.5, features_share=0.5, least_gain=0.01)
    said = {p.name: v for p, v in model.stages[1].extractParamMap().items()}
    assert (said["stepSize"], said["subsamplingRate"], said["featureSubsetStrategy"], said["minInfoGain"], said["minInstancesPerNode"]) == (0.07, 0.5, "0.5", 0.01, 150)


def test_the_query_searches_the_whole_space(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(ml, "search", lambda score, space, tries, seed, at_random, together=None: asked.append((space, tries, at_random)) or [])
    assert catalog.QUERIES["hyper_search"](spark, small).count() == 0 and asked == [(SPACE, 20, 10)]


@pytest.fixture(scope="module")
def trained(spark, small, tmp_path_factory):
    tx = ad.transactions(spark, small).drop("score")
    model = sc.fit_model(tx, ad.EPOCH, {"deep": {"rounds": 3, "depth": 3}, "shallow": {"rounds": 2, "depth": 2, "seed": 7}})
    folder = str(tmp_path_factory.mktemp("model"))
    model.save(spark, folder)
    return tx, model, sc.ScoringModel.load(spark, folder)


def test_a_trained_ensemble_scores_alike_when_reloaded(trained):
    tx, model, again = trained
    rows = tx.limit(150)
    a, b = (sorted(m.score(rows, F.lit("2024-01-01").cast("timestamp")).collect()) for m in (model, again))
    assert a == b and len(a) == 150 and sum(model.shares.values()) == pytest.approx(1.0)
    assert again.feature_lists() == model.feature_lists() and len(model.feature_lists()["deep"]) > 60
    assert (len(again.encoders.groups), len(again.encoders.counted), len(again.encoders.risky)) == (5, 6, 11)


def test_a_trained_ensemble_explains_its_scores(trained):
    tx, model, again = trained
    got = again.explain(tx.limit(40), "deep", top=4).collect()
    assert len(got) == 40 and all(len(r.explanations) == 4 for r in got)
    sizes = [[abs(e.impact) for e in r.explanations] for r in got]
    assert all(s == sorted(s, reverse=True) for s in sizes)
    names = again.feature_lists()["deep"]
    full = again.explain(tx.limit(40), "deep", top=len(names)).collect()
    member = again.members["deep"]
    raw = member.stages[1].transform(member.stages[0].transform(again.features(tx.limit(40)).select("TransactionID", *[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)).alias(c) for c in names])))
    want = {r.TransactionID: float(r.rawPrediction[1]) for r in raw.select("TransactionID", "rawPrediction").collect()}
    base = ml.mean_value(ml.model_trees(member))
    assert {r.TransactionID: pytest.approx(base + sum(e.impact for e in r.explanations)) for r in full} == want


def test_the_saved_baseline_shows_drift(trained):
    tx, _, again = trained
    same = {r.feature: r for r in again.drift(tx).collect()}
    moved = {r.feature: r for r in again.drift(tx.withColumn("TransactionAmt", F.col("TransactionAmt") * 40 + 500)).collect()}
    assert set(same) == set(again.feature_lists()["deep"]) and same["TransactionAmt"].status == "GREEN" and moved["TransactionAmt"].status == "RED"


def test_a_batch_without_some_columns_is_scored(trained):
    tx, _, again = trained
    few = tx.select("TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1").limit(20)
    got = again.score(few, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(got) == 20 and all(0 <= r.probability <= 1 and r.y_true is None for r in got)


def test_grouped_components_are_numpys(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 0.3], [0, 0, 0.2]]) + 5
    df = spark.createDataFrame([(k, *map(float, r), float(r[0]) if k % 4 else None) for k, r in enumerate(x)], "id long, a double, b double, c double, lone double")
    got = ml.apply_pca(df, ml.fit_pca(df, ["a", "b", "c", "lone"], share=0.97)).orderBy("id").toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    value, axes = np.linalg.eigh(np.cov(z.T))
    value, axes = value[::-1], axes[:, ::-1]
    kept = int(np.searchsorted(np.cumsum(value) / value.sum(), 0.97) + 1)
    mine = got[[c for c in got if c.startswith("pca_0_")]].to_numpy()
    assert mine.shape[1] == min(3, kept) and "a" not in got and "pca_1_0" in got
    for k in range(mine.shape[1]):
        assert min(np.abs(mine[:, k] - z @ axes[:, k]).max(), np.abs(mine[:, k] + z @ axes[:, k]).max()) < 1e-6
    alone = got["pca_1_0"].to_numpy()
    filled = np.where(np.arange(200) % 4, x[:, 0], 0.0)
    assert np.abs(np.abs(alone) - np.abs((filled - filled.mean()) / filled.std(ddof=1))).max() < 1e-6


def test_learned_scores_rank_frauds_first(spark, small):
    got = catalog.QUERIES["gbt_score"](spark, small).toPandas()
    bad, good = (got.probability[got.isFraud == k] for k in (1, 0))
    assert got.probability.between(0, 1).all() and (bad.to_numpy()[:, None] > good.to_numpy()).mean() > 0.6


def test_two_tables_are_told_apart(spark):
    draw = np.random.default_rng(3)
    frame = lambda shift: spark.createDataFrame([(float(a + shift), float(b)) for a, b in draw.normal(size=(250, 2))], "a double, b double")
    apart = ml.adversarial(frame(0), frame(6), ["a", "b"], trees=8, depth=3).first()
    alike = ml.adversarial(frame(0), frame(0), ["a", "b"], trees=8, depth=1).first()
    assert apart.auc > 0.99 and apart.drifted and apart.top_features == "a,b" and alike.auc < 0.7 and not alike.drifted


def test_figures_are_formatted_as_told(spark, small):
    """Every row of the query against Python's own formatting."""

    def half_up(v: float, places: int) -> Decimal:
        return Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)

    def money(v: float) -> str:
        return f"${half_up(v / 1e6, 1)}M" if v >= 1e6 else f"${half_up(v / 1e3, 1)}K" if v >= 1e3 else f"${half_up(v, 2)}"

    want = {r.id: (r.amt, r.p) for r in ad.scored(ad.transactions(spark, small)).select("id", "amt", "p").collect()}
    got = catalog.QUERIES["formatted_figures"](spark, small).collect()
    assert len(got) == len(want) and "K" in {r.amount[-1] for r in got}
    for r in got:
        amt, p = want[r.id]
        assert r.amount == money(amt * 1000) and r.share == f"{half_up(p * 100, 1)}%" and r.json == ('{"id":%d,"p":%s}' % (r.id, p))


def test_a_small_file_is_prepared_by_all_cores(spark, small, monkeypatch):
    """600,000 events are one or two splits of a file; their long projections have to be spread over the cores."""
    seen = []
    monkeypatch.setattr(sc, "prepare", lambda tx, epoch: seen.append(tx.rdd.getNumPartitions()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sc.fit_model(ad.transactions(spark, small).drop("score"), ad.EPOCH)
    assert seen[0] >= spark.sparkContext.defaultParallelism > ad.transactions(spark, small).rdd.getNumPartitions()
