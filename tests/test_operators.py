"""Hand-made cases: the traps, edges and invariants that parity with SQL does not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskengine.functions import clean
from riskengine.operators import evaluate as ev
from riskengine.operators import features as fe
from riskengine.operators import learn as ml
from riskengine.operators import monitor as mo
from riskengine.operators.graph import connected_components
from riskengine.plans import catalog as cat
from riskengine.plans import views as vw
from riskengine.sources import readers as rd
from riskengine.streaming import streams as st

TX = "TransactionID long, TransactionDT long, TransactionAmt double, UID string"


def one(df):
    return df.first()[0]


def test_interleaved_users_get_their_own_windows(spark):
    rows = [(1, 100, 10.0, "a"), (2, 100, 1.0, "b"), (3, 200, 20.0, "a"), (4, 300, 2.0, "b"), (5, 300, 5.0, "a"), (6, 300, 7.0, "c")]
    got = {r.TransactionID: (r.UID_count_1h, r.UID_amt_sum_1h) for r in fe.velocity(spark.createDataFrame(rows, TX)).collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0), 3: (1, 10.0), 4: (1, 1.0), 5: (2, 30.0), 6: (0, None)}


def test_same_second_is_not_before(spark):
    rows = [(1, 100, 10.0, "a"), (2, 100, 20.0, "a"), (3, 3700, 1.0, "a")]
    got = {r.TransactionID: r.UID_count_1h for r in fe.velocity(spark.createDataFrame(rows, TX)).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_email_order_of_rules(spark):
    df = spark.createDataFrame([(None, None), ("GMAIL", "gmail.com"), ("temp1.com", "x.mx")], "P_emaildomain string, R_emaildomain string")
    got = clean.email_features(df).collect()
    assert got[0].P_emaildomain == "unknown" and got[0].P_emaildomain_length == 7 and got[0].email_match_status == 1
    assert got[1].email_match_status == 1 and got[1].P_emaildomain_vendor_id == 1
    assert got[2].P_emaildomain_risk_score == 1 + 1 + 3 and got[2].R_emaildomain_country_id == 1


def test_browser_priority(spark):
    cases = {"chrome 62.0 for android": 3, "edge 15": 6, "mobile safari 11": 9, "safari generic": 3, "samsung browser": 2, "chrome 63 ios": 7, "chrome": 8, "firefox": 5, "puffin": 1, "opera generic": 4, "x": 0, "": 0}
    df = spark.createDataFrame([(k,) for k in cases], "b string").select("b", clean.browser_type(F.col("b")).alias("t"))
    assert {r.b: r.t for r in df.collect()} == cases


def test_amounts_by_cents(spark):
    df = clean.amount_features(spark.createDataFrame([(100.0,), (99.99,), (49.95,), (123.45,), (0.29,), (None,), (59.065,), (0.995,)], "TransactionAmt double"))
    got = [(r.TransactionAmt_suspicious, r.cents_value, r.TransactionAmt_decimal, r.is_exact_dollars, r.is_99_cents) for r in df.collect()]
    assert got == [(2, 0, 0.0, 1, 0), (1, 990, 0.99, 0, 1), (1, 950, 0.95, 0, 0), (0, 450, 0.45, 0, 0), (0, 290, 0.29, 0, 0), (0, 0, 0.0, 1, 0), (0, 65, 0.065, 0, 0), (0, 995, 0.995, 0, 1)]


def test_screen_rows_stand_alone(spark):
    w, h = clean.screen_size(F.col("s"))
    df = spark.createDataFrame([("1920x1080",), ("junk",), ("1x2x3",), (None,)], "s string").select(w.alias("w"), h.alias("h"))
    assert [tuple(r) for r in df.collect()] == [(1920, 1080), (None, None), (None, None), (None, None)]


def test_unknown_codes(spark):
    df = spark.createDataFrame([("Z", None, "weird", "T")], "ProductCD string, card4 string, card6 string, M1 string")
    r = clean.card_features(df).first()
    assert (r.ProductCD, r.card4, r.card6, r.M1) == (0, -1, -1, 1)


def test_coercion_and_infinities(spark):
    df = spark.createDataFrame([("1", "x", "inf"), ("bad", None, "2.5")], "a string, b string, c string")
    got = clean.finite(clean.coerce_schema(df, {"a"}, {"b"})).collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (None, None, 2.5)]


def test_md5_bucket(spark):
    import hashlib

    for x in ("abc", "1000_-1_0", ""):
        want = int(hashlib.md5(x.encode()).hexdigest(), 16) % 10000
        assert one(spark.createDataFrame([(x,)], "u string").select(fe.hash_bucket(F.col("u")))) == want


def test_thresholds_must_be_ordered():
    with pytest.raises(ValueError):
        clean.tier(F.lit(0.1), 0.2, 0.1)
    with pytest.raises(ValueError):
        rd.Settings(soft_threshold=0.9)


SC = "y int, p double, amt double"


@pytest.mark.parametrize(("rows", "auc"), [([(0, 0.1, 1.0), (0, 0.2, 1.0), (1, 0.8, 1.0), (1, 0.9, 1.0)], 1.0), ([(0, 0.1, 1.0)], 0.5), ([], 0.5), ([(0, 0.5, 1.0), (1, 0.5, 1.0)], 0.5), ([(1, 0.2, 1.0), (0, 0.9, 1.0)], 0.0)])
def test_auc_edges(spark, rows, auc):
    assert one(ev.roc_auc(spark.createDataFrame(rows, SC))) == auc


def test_metrics_against_loops(spark):
    draw = np.random.default_rng(42)
    y, p, a = (draw.random(400) < 0.1).astype(int), draw.random(400).round(3), draw.exponential(200, 400).round(2)
    df = spark.createDataFrame([(int(u), float(v), float(w)) for u, v, w in zip(y, p, a, strict=True)], SC)
    wins = sum((p[i] > p[j]) + 0.5 * (p[i] == p[j]) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    assert one(ev.roc_auc(df)) == pytest.approx(wins / (y.sum() * (1 - y).sum()))
    grid = ev.linspace(0.01, 0.99, 100)
    cost = [a[(y == 1) & (p < t)].sum() + 30 * ((y == 1) & (p < t)).sum() + 12.5 * ((y == 0) & (p >= t)).sum() + 0.15 * a[(y == 0) & (p >= t)].sum() for t in grid]
    got = [r.cost for r in ev.cost_at(ev.at_thresholds(df, grid)).orderBy("threshold").collect()]
    assert got == pytest.approx(cost)
    assert one(ev.best_threshold_cost(df)) == grid[int(np.argmin(np.round(cost, 6)))]


def test_empty_thresholds(spark):
    df = spark.createDataFrame([], SC)
    assert [one(f(df)) for f in (ev.best_threshold_cost, ev.best_threshold_fbeta, ev.best_threshold_fpr)] == [0.5, 0.5, 0.5]
    assert ev.simulation_table(df).count() == 101 and ev.calibration_curve(df).count() == 0


def test_pnl_of_one_class(spark):
    r = ev.profit_and_loss(spark.createDataFrame([(0, 0.1, 5.0)] * 3, SC), 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.net_savings) == (0, 0, 0, 3, 0.0)


def test_recall_falls_with_threshold(spark):
    df = spark.createDataFrame([(k % 2, k / 100, 1.0) for k in range(100)], SC)
    recall = [r.recall for r in ev.simulation_table(df).orderBy("threshold").collect()]
    assert recall == sorted(recall, reverse=True)


def test_psi_same_and_shifted(spark):
    draw = np.random.default_rng(1)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    base = mo.baseline(mo.melt(frame(draw.normal(0, 1, 1000)), ["v"]))
    same, moved = (mo.drift(base, mo.melt(frame(draw.normal(m, 1, 1000)), ["v"])).first() for m in (0, 3))
    assert same.psi < 0.1 and moved.psi > 0.2 and moved.status == "RED"
    none = mo.drift(base, mo.melt(frame([]), ["v"])).first()
    assert none.psi == 0 and none.status == "GREEN"
    odd = mo.drift(base, mo.melt(frame([*draw.normal(0, 1, 500), float("inf"), float("nan")]), ["v"])).first()
    assert np.isfinite(odd.psi)


def test_sparse_features(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(None,)] * 95, "v double")
    r = mo.baseline(mo.melt(df, ["v"])).first()
    assert r.is_sparse and r.edges is None


def test_importance_average(spark):
    old = spark.createDataFrame([("amt", 1.0), ("card", 0.5)], "feature string, value double")
    new = spark.createDataFrame([("amt", 0.0), ("new", 2.0)], "feature string, value double")
    got = {r.feature: r.value for r in vw.merge_importance(old, new).collect()}
    assert got == pytest.approx({"amt": 0.9, "card": 0.5, "new": 0.2})


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 300), (None, 5)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)} | {200: 200, 300: 300, 301: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_time_split_and_folds(spark):
    df = spark.createDataFrame([(k, 1000 * (k // 3)) for k in range(60)], "TransactionID long, TransactionDT long")
    assert {r.TransactionID for r in fe.time_split(df).filter("is_train = 1").collect()} == set(range(51))
    folds = {r.TransactionID: r.fold for r in fe.time_folds(df, 5).collect()}
    assert [folds[k] for k in (0, 9, 10, 19, 59)] == [0, 0, 1, 1, 5]


def test_category_codes_of_unseen_values(spark):
    train, test = (spark.createDataFrame([(v,) for v in x], "c string") for x in (("b", "a", "b", None), ("a", "z", None)))
    got, fitted = fe.category_codes(train, ["c"])
    assert sorted(r.c_code for r in got.collect()) == [-1, 0, 1, 1]
    assert sorted(r.c_code for r in fe.category_codes(test, ["c"], fitted)[0].collect()) == [-1, -1, 0]


def test_messages_and_dead_letters(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.DoubleType())])
    df = spark.createDataFrame([('{"id": 1, "p": 0.5}',), ("{oops",), (None,)], "value string")
    good, bad = rd.parse_messages(df, schema)
    assert [tuple(r) for r in good.collect()] == [(1, 0.5)]
    assert bad.count() == 2 and bad.columns == ["original_message", "error_reason", "exception", "timestamp"]


def test_long_messages_stay_whole(spark, tmp_path):
    rows = [(1, '{"k": 5, "pad": "' + "x" * 3000 + '"}'), (7, '{"k": 6}')]
    spark.createDataFrame(rows, "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in cat.parse_messages(spark, str(tmp_path)).collect()] == [(1, 5)]
    assert [r.original_message for r in cat.dead_letters(spark, str(tmp_path)).collect()] == ['{"event_i']


def test_csv_round_trip_and_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "nan"), (2, "x")], "k long, s string")
    rd.write_table(df, str(tmp_path / "t"), fmt="csv")
    back = rd.missing_to_null(rd.read_csv(spark, str(tmp_path / "t"), df.schema))
    named = rd.with_replay_id(back, ["k"], F.col("k"))
    assert sorted((r.k, r.s, r.transaction_id) for r in named.collect()) == [(1, None, "tx_0"), (2, "x", "tx_1")]


def test_settings_from_files(tmp_path):
    (tmp_path / "a.yaml").write_text("fee_fraud: 40.0  # note\nbatch_rows: 7\nother: 1\n")
    s = rd.Settings.load(str(tmp_path / "a.yaml"))
    assert (s.fee_fraud, s.batch_rows, s.extra) == (40.0, 7, {"other": 1})


def test_rows_with_missing_columns_and_mock(spark):
    assert rd.rows_to_frame(spark, {"TransactionID": 5}, rd.RAW_SCHEMA).first().TransactionAmt is None
    m = rd.mock_transactions(spark.range(5000))
    share = m.agg(F.avg("isFraud")).first()[0]
    assert 0.07 < share < 0.13 and m.filter("isFraud = 0 AND TransactionAmt > 300").count() == 0


def test_stream_velocity_over_batches_is_batch_velocity(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(k, int(k * 1000), float(draw.integers(1, 100)), f"u{draw.integers(0, 3)}") for k in range(300)]
    full = spark.createDataFrame(rows, TX)
    for k in range(3):
        full.filter(f"TransactionID BETWEEN {100 * k} AND {100 * k + 99}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r.TransactionID: (r.count_24h, round(r.amt_sum_24h, 6)) for r in st.run_to_table(st.keyed_velocity(stream, 24), "append", "t").collect()}
    want = {r.TransactionID: (r.UID_count_24h, round(r.UID_amt_sum_24h, 6)) for r in fe.velocity(full, (24,), fill_single=True).collect()}
    assert got == want


def test_scoring_stream_replay_and_threshold(spark, tmp_path):
    rows = [(k, int(k % 10 == 0), (k % 100) / 100, 10.0) for k in range(2000)]
    src = spark.createDataFrame(rows, "id long, y int, p double, amt double")
    src.write.parquet(str(tmp_path / "in"))
    tables = st.ScoringTables(str(tmp_path / "out"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        tables.start(stream(), rd.Settings()).awaitTermination()
    t = tables.totals(spark).first()
    assert (t.n, t.fraud) == (2000, 500) and tables.predictions(spark).count() == 2000
    best, seen = tables.reoptimise(spark)
    assert best is not None and seen == 2000 and tables.threshold(spark, 0.75) == best
    assert tables.reoptimise(spark, seen=seen)[0] is None


def test_throttled_points():
    got, *_ = st.throttle_points(np.array([0.0, 1, 2, 11, 12]), np.array([1.0, 1, 600, 1, 1]), 10, 500, None, 0.0, 0.0)
    assert [k for k, _ in got] == [0, 2] or [k for k, _ in got] == [0, 2, 4]
    got, last_at, *_ = st.throttle_points(np.array([0.0, 5, 10, 15]), np.zeros(4), 10, 500, None, 0.0, 0.0)
    assert [k for k, _ in got] == [0, 2] and last_at == 10


def test_calibration_range_and_small_tables(spark):
    draw = np.random.default_rng(5)
    p = draw.random(300)
    df = spark.createDataFrame([(int(draw.random() < v), float(v), 1.0) for v in p] + [(1, None, 1.0)], SC)
    for how in ("isotonic", "platt"):
        out = ml.calibrate(df, ml.fit_calibration(df, how))
        assert out.count() == 301 and out.filter("calibrated NOT BETWEEN 0 AND 1").count() == 0
    assert ml.fit_calibration(df.limit(2)) is None


def test_tree_explanations_add_up(spark):
    draw = np.random.default_rng(6)
    rows = [(k, float(draw.random()), float(draw.random()), 0) for k in range(300)]
    rows = [(k, a, b, int(a + 0.3 * b > 0.7)) for k, a, b, _ in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = ml.fit_trees(df, ["a", "b"], "y", rounds=3, depth=2)
    got = ml.explain_trees(df, model, ("id",)).collect()
    raw = model.stages[1].transform(model.stages[0].transform(df)).select("id", "rawPrediction").collect()
    base = ml.mean_value(ml.model_trees(model))
    assert [sum(e.impact for e in r.explanations) + base for r in sorted(got)] == pytest.approx([float(r.rawPrediction[1]) for r in sorted(raw)])


def test_nulls_everywhere_and_empty_tables(spark, small):
    from riskengine.sources import adapters as ad

    tx = ad.transactions(spark, small)
    gone = tx.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in tx.schema]).limit(5)
    for df, n in ((gone, 5), (tx.limit(0), 0)):
        full = fe.sequence_features(fe.velocity(fe.with_user(clean.normalise_days(clean.card_features(clean.device_features(clean.email_features(clean.amount_features(clean.set_country(df)))))))))
        assert fe.sharing_degrees(full).count() == n
    enc = fe.fit_encoders(fe.with_user(tx), ["card4"], ["card1"], ["ProductCD"])
    assert fe.apply_encoders(fe.with_user(gone), enc).count() == 5


def test_hot_users_are_split(spark):
    """A user's windows are dealt by spans of time, and give what windows over the whole history give."""
    draw = np.random.default_rng(2)
    rows = [(k, int(draw.integers(0, 10 * 86400)), float(draw.integers(1, 50)), "hot" if k % 3 else f"u{k}") for k in range(900)]
    df = spark.createDataFrame(rows, TX)
    got = {r.TransactionID: r for r in fe.sequence_features(fe.velocity(df)).collect()}
    assert len(got) == 900
    by: dict = {}
    for k, t, a, u in sorted(rows, key=lambda r: (r[1], r[0])):
        past = by.setdefault(u, [])
        for h in (1, 12, 24):
            near = [x for s, x in past if t - h * 3600 <= s < t]
            assert getattr(got[k], f"UID_count_{h}h") == len(near) and (got[k][f"UID_amt_sum_{h}h"] or 0.0) == pytest.approx(sum(near))
        assert (got[k].UID_amt_sum_1h is None) == (u != "hot")
        assert got[k].txn_sequence == len(past) and got[k].UID_dt_diff == (t - past[-1][0] if past else 0)
        past.append((t, a))
    for plan in (fe.velocity(df, fill_single=True), fe.sequence_features(df)):
        assert "Exchange hashpartitioning(UID" in (text := plan._jdf.queryExecution().executedPlan().toString())
        assert "_span" in text or "_day" in text


def test_split_condition_and_quantiles(spark):
    draw = np.random.default_rng(4)
    rows = [(int(draw.integers(0, 40)), int(draw.integers(0, 20000)), float(draw.integers(0, 30)) if k % 7 else None, "u") for k in range(500)]
    df = spark.createDataFrame([(k, r[1], r[2], r[3]) for k, r in enumerate(rows)] + [(500, None, 1.0, "u")], TX)
    order = sorted(df.collect(), key=lambda r: (r.TransactionDT is not None, r.TransactionDT or 0, r.TransactionID))
    for share in (0.0, 0.001, 0.5, 0.85, 1.0):
        assert {r.TransactionID for r in df.filter(fe.train_rows(df, share)).collect()} == {r.TransactionID for r in order[: int(501 * share)]}
    assert df.limit(0).filter(fe.train_rows(df.limit(0))).count() == 0
    known = [r[2] for r in rows if r[2] is not None] + [1.0]
    q = one(fe.exact_quantiles(df, "TransactionAmt", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
    assert q == pytest.approx(np.quantile(known, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).tolist())


def test_saved_models_score_alike(spark, small, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from riskengine.operators import scoring as sc
    from riskengine.sources import adapters as ad

    tx = ad.transactions(spark, small)
    df = sc.prepare(tx, ad.EPOCH)
    enc = fe.fit_encoders(df)
    ready = fe.apply_encoders(df, enc)
    trees = ml.fit_trees(ready, ["TransactionAmt", "ProductCD", "card4_fraud_rate"], "isFraud", rounds=2, depth=2)
    fitted = ml.fit_calibration(ml.score_trees(ready, trees).select(F.col("isFraud").alias("y"), F.col("probability").alias("p"), F.lit(1.0).alias("amt")), "platt")
    model = sc.ScoringModel(enc, {"trees": trees, "line": sc.LinearScorer({"TransactionAmt_log": 0.1, "absent": 3.0}, -1.0)}, {"trees": 0.5, "line": 0.5}, ad.EPOCH, fitted, rd.Settings(hard_threshold=0.6))
    model.save(spark, str(tmp_path / "m"))
    back = sc.ScoringModel.load(spark, str(tmp_path / "m"))
    assert isinstance(back.calibration, LogisticRegressionModel) and back.settings == model.settings and back.encoders.risky == enc.risky
    names = ["transaction_id", "probability", "is_fraud", "y_true", "action", "amount"]
    one_, two = (sorted(m.score(tx).select(*names).collect()) for m in (model, back))
    assert one_ == two and len(one_) == tx.count()
    lone = spark.createDataFrame([(7, 5.0, 100, "W")], "TransactionID long, TransactionAmt double, TransactionDT long, ProductCD string").unionByName(tx.limit(0), allowMissingColumns=True)
    assert back.score(lone).count() == 1


def test_stream_tables(spark, tmp_path):
    """Fan-out, histories, enrichment with moving averages, versions of the threshold, failed scoring and failed writes."""
    for k in range(3):
        spark.createDataFrame([(100 * k + i, i % 2, i / 100, float(i)) for i in range(100)], "id long, y int, p double, amt double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema("id long, y int, p double, amt double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sent = []
    tables = st.ScoringTables(str(tmp_path / "out"), refresh_seconds=0)
    q = tables.start(stream(), rd.Settings(), log=("amt",), score=lambda b: b.withColumn("p", F.col("p") * 1.0), send=lambda b: sent.append(b.count()))
    q.awaitTermination()
    assert sent == [100] * 3 and tables.predictions(spark).count() == 300 and st.throughput(q)["rows"] == 300
    assert tables.history(spark, 150).count() == 150 and tables.recent(spark, 5).count() == 5 and tables.alerts(spark).count() == 75
    assert {r.status for r in tables.enriched(spark).collect()} == {"processing"} and tables.monitored(spark) == []
    impact = lambda b: b.select("id", F.array(*[F.struct(F.lit(n).alias("feature"), (F.col("amt") * w).alias("impact")) for n, w in (("a", 2.0), ("b", -1.0))]).alias("explanations"))
    tables.enrich(spark, impact).awaitTermination()
    assert {r.feature: r.value for r in tables.importance(spark).collect()} == pytest.approx({"a": 99.0, "b": 49.5}) and tables.monitored(spark) == ["a", "b"]
    found = tables.lookup(spark, 205).first()
    assert found.status == "ready" and found.explanations[0].impact == 10.0 and tables.lookup(spark, 205, F.current_timestamp() + F.expr("INTERVAL 2 HOURS")).count() == 0
    tables.publish_threshold(spark, 0.4)
    tables.publish_threshold(spark, 0.3)
    assert tables.threshold(spark, 0.75) == 0.3
    bad = st.ScoringTables(str(tmp_path / "bad"))
    bad.start(stream(), rd.Settings(), score=lambda b: b.select(F.raise_error(F.lit("no model")).alias("id"), "y", "p", "amt")).awaitTermination()
    letters = spark.read.parquet(str(tmp_path / "bad/dead_letters"))
    assert letters.count() == 300 and "no model" in letters.first().exception
    full = st.ScoringTables(str(tmp_path / "full"))
    with pytest.raises(Exception, match="disk"):
        full.start(stream(), rd.Settings(), send=lambda b: (_ for _ in ()).throw(OSError("disk"))).awaitTermination()
    assert not (tmp_path / "full/dead_letters").exists()


def test_state_ends_with_the_watermark(spark, tmp_path):
    rows = [(k, (k + 24) * 3600, 1.0, "a" if k < 5 else "b") for k in range(200)]
    full = spark.createDataFrame(rows, TX).withColumn("ts", F.timestamp_seconds("TransactionDT"))
    for k in range(4):
        full.filter(f"TransactionID BETWEEN {50 * k} AND {50 * k + 49}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path = str(tmp_path / "out")
    q = st.keyed_velocity(stream, 24, event_time="ts", late="1 hour").writeStream.option("checkpointLocation", f"{path}-c").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    q.awaitTermination()
    got = {r.TransactionID: r.count_24h for r in spark.read.parquet(path).collect()}
    assert got == {k: min(k if k < 5 else k - 5, 24) for k in range(200)}
    # the last 26 hours of b, a piece and a sum each; nothing of a is left
    assert q.lastProgress.stateOperators[0].numRowsTotal == 2 * 26


def test_cv_averages_folds(spark):
    draw = np.random.default_rng(1)
    rows = [(k, k, float(draw.random()), float(draw.random()), 0) for k in range(400)]
    df = spark.createDataFrame([(i, t, a, b, int(a > 0.6)) for i, t, a, b, _ in rows], "TransactionID long, TransactionDT long, a double, b double, y int")
    scored, top = ml.expanding_cv(fe.time_folds(df, 2), df, "fold", ["a", "b"], "y", rounds=3, depth=2)
    found = top.collect()
    assert [r.feature for r in found] == ["a", "b"] and found[0].importance > 0.9
    assert scored.count() == 400 and one(ev.roc_auc(scored.select("y", F.col("probability").alias("p"), F.lit(1.0).alias("amt")))) > 0.99


def test_scan_reads_only_used_columns(spark, small):
    from riskengine.plans import catalog

    plan = catalog.QUERIES["roc_auc"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_windows_of_the_dashboard_shuffle_what_it_takes(spark, small):
    from riskengine.operators import scoring as sc
    from riskengine.sources import adapters as ad

    got = sc.dashboard_features(ad.transactions(spark, small), ad.EPOCH)
    made = set(got.columns) - sc._DASHBOARD_NEEDS - {"_raw"}
    assert not made & {"id_30", "id_31", "id_33", "M1", "M4", "D1", "score", "DeviceInfo", "screen_width", "product_network_combo", "TransactionAmt_decimal"}
    assert set(sc.DASHBOARD) - set(got.columns) == {"addr1_fraud_rate", "composite_risk_score", "Amt_div_card1_mean", "user_amt_zscore"}  # the encoders' own


def test_records_are_shuffled_without_the_maps_of_small_keys(spark):
    """Keys of many values are joined first: a map in each record would go through all their shuffles."""
    rows = [(k, k, float(k % 9 + 1), f"u{k % 90}", k % 80, k % 3, k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, UID string, card1 long, card4 int, isFraud int")
    enc = fe.fit_encoders(df)
    got = fe.apply_encoders(df, enc)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "LeftOuter" not in joins[0] and sum("LeftOuter" in line for line in joins) == 3
    r = got.filter("TransactionID = 7").first()
    assert (r.card1_freq_enc, r.UID_freq_enc, r.card4_freq_enc) == (5, 5, 133)
