"""Scoring from raw records to a report: prepare, encode, score, calibrate, tier. All that is learned can be saved."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.functions import clean
from riskengine.operators import evaluate, learn, monitor
from riskengine.operators import features as fe
from riskengine.session import materialize, shared_path, spread
from riskengine.sources.readers import Settings


#: Raw columns that features are made of, by kind; those that a batch lacks are null.
_RAW = {"double": ("addr1", "D1"), "string": ("ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "id_30", "id_31", "id_33", "DeviceInfo", "DeviceType")}


def prepare(tx: DataFrame, epoch: int) -> DataFrame:
    """Raw records with all features that need nothing learned: cleaned texts, codes, times, user and combined keys."""
    tx = tx.withColumns({c: F.lit(None).cast(kind) for kind, names in _RAW.items() for c in names if c not in tx.columns})
    df = clean.normalise_days(clean.time_features(tx, epoch))
    df = fe.with_user(clean.amount_features(df))
    return fe.with_combinations(clean.card_features(clean.device_features(clean.email_features(df))))


@dataclass(frozen=True)
class LinearScorer:
    """A logistic model over named features; absent and null values count 0."""

    weights: dict[str, float]
    bias: float = 0.0

    def probability(self, df: DataFrame) -> Column:
        terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in sorted(self.weights.items()) if c in df.columns]
        return clean.sigmoid(sum(terms, F.lit(self.bias)))


@dataclass
class ScoringModel:
    """Encoders, an ensemble of models with their shares, a calibration and the thresholds.

    ``calibration`` is a pair (slope, offset) of a logistic curve, a fitted MLlib model, or
    None for none. Trees take their features by name; a feature that a batch lacks is null.
    ``baseline`` holds the distributions that ``drift`` compares with.
    """

    encoders: fe.Encoders
    members: dict[str, LinearScorer | PipelineModel]
    shares: dict[str, float]
    epoch: int
    calibration: tuple[float, float] | IsotonicRegressionModel | LogisticRegressionModel | None = None
    settings: Settings = field(default_factory=Settings)
    baseline: DataFrame | None = None

    def feature_lists(self) -> dict[str, list[str]]:
        """The features of each member, in the order it takes them."""
        return {n: sorted(m.weights) if isinstance(m, LinearScorer) else list(m.stages[0].getInputCols()) for n, m in self.members.items()}

    def explain(self, tx: DataFrame, member: str, top: int = 10, keep: tuple[str, ...] = (fe.ROW,)) -> DataFrame:
        """``keep`` and the ``top`` largest contributions to a member's raw score."""
        return self.explain_features(self.features(tx), member, top, keep)

    def explain_features(self, df: DataFrame, member: str, top: int = 10, keep: tuple[str, ...] = (fe.ROW,)) -> DataFrame:
        """``explain`` for records that have their ``features``."""
        names = self.members[member].stages[0].getInputCols()
        return learn.explain_trees(df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns}), self.members[member], keep, top)

    def drift(self, tx: DataFrame) -> DataFrame:
        """How far the features of raw records have moved from the baseline."""
        return monitor.drift(self.baseline, monitor.melt(self.features(tx), [r.feature for r in self.baseline.select("feature").collect()]))

    def features(self, tx: DataFrame) -> DataFrame:
        return fe.apply_encoders(prepare(tx, self.epoch), self.encoders)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``p``, the calibrated score, beside the features."""
        for name, m in self.members.items():
            if isinstance(m, LinearScorer):
                df = df.withColumn(f"_p_{name}", m.probability(df))
            else:
                lacking = {c: F.lit(None).cast("double") for c in m.stages[0].getInputCols() if c not in df.columns}
                df = learn.score_trees(df.withColumns(lacking), m).withColumnRenamed("probability", f"_p_{name}").drop(*lacking)
        df = df.withColumn("p", evaluate.weighted_score({f"_p_{n}": w for n, w in self.shares.items()})).drop(*[f"_p_{n}" for n in self.members])
        if isinstance(self.calibration, tuple):
            return df.withColumn("p", clean.sigmoid(self.calibration[0] * F.col("p") + self.calibration[1]))
        return learn.calibrate(df, self.calibration).drop("p").withColumnRenamed("calibrated", "p")

    def score(self, tx: DataFrame, now: Column | None = None) -> DataFrame:
        """One report row a record: id as text, score (4 places), action, truth if known, amount and time in ISO form."""
        return self.report(self.features(tx), now)

    def report(self, df: DataFrame, now: Column | None = None) -> DataFrame:
        """``score`` for records that have their ``features``."""
        s, said = self.settings, now if now is not None else F.current_timestamp()
        df = self.probabilities(df)
        return df.select(
            F.col(fe.ROW).cast("string").alias("transaction_id"), F.round("p", 4).alias("probability"), (F.col("p") >= s.hard_threshold).cast("int").alias("is_fraud"),
            (F.col("isFraud").cast("int") if "isFraud" in df.columns else F.lit(None).cast("int")).alias("y_true"), clean.tier(F.col("p"), s.soft_threshold, s.hard_threshold).alias("action"),
            F.col(fe.AMOUNT).alias("amount"), iso_time(said).alias("timestamp"),
        )

    def save(self, spark: SparkSession, folder: str) -> None:
        """Encoders as tables, trees and calibration as MLlib writes them, the rest as one JSON row."""
        self.encoders.save(f"{folder}/encoders")
        for name, m in self.members.items():
            if not isinstance(m, LinearScorer):
                m.write().overwrite().save(f"{folder}/members/{name}")
        if self.baseline is not None:
            self.baseline.write.mode("overwrite").parquet(f"{folder}/baseline")
        kind = type(self.calibration).__name__
        if kind not in ("tuple", "NoneType"):
            self.calibration.write().overwrite().save(f"{folder}/calibration")
        said = {
            "linear": {n: asdict(m) for n, m in self.members.items() if isinstance(m, LinearScorer)}, "trees": [n for n, m in self.members.items() if not isinstance(m, LinearScorer)], "shares": self.shares,
            "epoch": self.epoch, "calibration": kind, "curve": self.calibration if kind == "tuple" else None, "settings": asdict(self.settings),
            "features": self.feature_lists(), "baseline": self.baseline is not None,
        }
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ScoringModel:
        said = json.loads(spark.read.text(f"{folder}/model", wholetext=True).first().value)
        members: dict[str, LinearScorer | PipelineModel] = {n: LinearScorer(**m) for n, m in said["linear"].items()}
        members |= {n: PipelineModel.load(f"{folder}/members/{n}") for n in said["trees"]}
        kinds = {"IsotonicRegressionModel": IsotonicRegressionModel, "LogisticRegressionModel": LogisticRegressionModel}
        kind = said["calibration"]
        calibration = tuple(said["curve"]) if kind == "tuple" else kinds[kind].load(f"{folder}/calibration") if kind in kinds else None
        return cls(fe.Encoders.load(spark, f"{folder}/encoders"), members, said["shares"], said["epoch"], calibration, Settings(**said["settings"]), spark.read.parquet(f"{folder}/baseline") if said.get("baseline") else None)


def numeric_features(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """The columns that models can learn from, in order."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in (fe.ROW, fe.TIME, "isFraud", *skip)]


#: Settings of the ensemble's members.
MEMBERS = {"deep": {"rounds": 50, "depth": 6}, "shallow": {"rounds": 50, "depth": 3, "seed": 7}}


def fit_model(tx: DataFrame, epoch: int, members: dict[str, dict] | None = None, share: float = 0.85, skip: tuple[str, ...] = (), settings: Settings | None = None) -> ScoringModel:
    """A model of all keys and features from labelled raw records, the first ``share`` of them by time.

    Encoders learn from these; boosted trees learn from their features and stop early on the
    records behind, by which the members' shares (in proportion to ROC AUC above one half)
    and the isotonic calibration are found too. The baseline of drift is of the first part.
    """
    cut, spark = fe.train_rows(tx, share), tx.sparkSession
    ready = materialize(prepare(spread(tx), epoch), "prepared")
    folder = shared_path(spark, "encoders")
    fe.fit_encoders(ready.filter(cut)).save(folder)
    enc = fe.Encoders.load(spark, folder)
    full = materialize(fe.apply_encoders(ready, enc), "encoded")
    names = numeric_features(full, skip)
    fitted = {n: learn.fit_trees(full, names, "isFraud", held=~cut, **s) for n, s in (members or MEMBERS).items()}
    rest = full.filter(~cut)
    for n, m in fitted.items():
        rest = learn.score_trees(rest, m).withColumnRenamed("probability", f"_p_{n}")
    rest = materialize(rest.select(F.col("isFraud").alias("y"), F.col(fe.AMOUNT).alias("amt"), *[f"_p_{n}" for n in fitted]), "held")
    better = {n: max(0.0, (evaluate.roc_auc(rest.select("y", F.col(f"_p_{n}").alias("p"), "amt")).first().roc_auc or 0.5) - 0.5) for n in fitted}
    total = sum(better.values())
    shares = {n: b / total if total else 1 / len(fitted) for n, b in better.items()}
    calibration = learn.fit_calibration(rest.withColumn("p", evaluate.weighted_score({f"_p_{n}": w for n, w in shares.items()})))
    base = materialize(monitor.baseline(monitor.melt(full.filter(cut), names)), "baseline")
    return ScoringModel(enc, fitted, shares, epoch, calibration, settings or Settings(), base)


# What the dashboard shows of a record, in its order.
DASHBOARD = (
    "P_emaildomain", "TransactionAmt", "ProductCD", "card4", "TransactionAmt_log", "TransactionAmt_suspicious", "cents_value", "country", "composite_risk_score", "DeviceType", "os_browser_combo",
    "UID_velocity_1h", "UID_velocity_12h", "UID_velocity_24h", "multi_entity_sharing", "card_email_combo", "device_info_combo", "P_emaildomain_risk_score", "email_match_status", "P_emaildomain_is_free",
    "ProductCD_switch", "user_amt_zscore", "Amt_div_card1_mean", "hour_of_day", "day_of_week", "time_gap_anomaly", "screen_area", "addr1_fraud_rate", "addr1_degree",
)


#: All that the dashboard's windows, degrees and encodings are made of.
_DASHBOARD_NEEDS = {*DASHBOARD, fe.ROW, fe.TIME, fe.AMOUNT, fe.USER, "isFraud", *fe.GROUP_KEYS, *fe.COUNT_KEYS, *fe.RISK_KEYS}


def dashboard_features(tx: DataFrame, epoch: int) -> DataFrame:
    """Prepared records with the country, the users' windows and sharing degrees; ``_raw`` has what the dashboard shows unchanged.

    Columns that neither the dashboard nor its encoders take are left out before the windows, which shuffle whole rows.
    """
    raw = F.struct(*[F.col(c) for c in DASHBOARD if c in tx.columns]).alias("_raw")
    df = prepare(clean.set_country(tx.select("*", raw)), epoch)
    df = df.select("_raw", *[c for c in df.columns if c in _DASHBOARD_NEEDS])
    return fe.sharing_degrees(fe.sequence_features(fe.velocity(df)))


def dashboard(features: DataFrame, keep: tuple[str, ...] = (fe.ROW,)) -> DataFrame:
    """``keep`` and all names of ``DASHBOARD``: a record's raw value where it came with one, else the engineered one; null for one that is not there."""
    raw = set(features.schema["_raw"].dataType.names) if "_raw" in features.columns else set()
    have = set(features.columns)
    pick = lambda c: F.col(f"_raw.{c}") if c in raw else F.col(c) if c in have else F.lit(None).cast("double")
    return features.select(*keep, *[pick(c).alias(c) for c in DASHBOARD])


def iso_time(ts: Column) -> Column:
    """A time to the second in ISO form."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def business_report(scored: DataFrame, threshold: float, latency_ms: float = 0.0, now: Column | None = None, listed: int = 1000) -> DataFrame:
    """Profit and loss in an envelope: ``queue_depth`` (of a list of ``listed``), latency, lifetime count, threshold and time."""
    report = evaluate.profit_and_loss(scored, threshold)
    return report.select(
        "*", F.least(F.col("total"), F.lit(listed)).alias("queue_depth"), F.lit(float(latency_ms)).alias("live_latency_ms"), F.col("total").alias("total_lifetime_count"),
        F.lit(float(threshold)).alias("threshold"), iso_time(now if now is not None else F.current_timestamp()).alias("updated_at"),
    )


def reoptimised(scored: DataFrame, current: float, seen: int = 0, least_new: int = 1000) -> DataFrame:
    """``threshold`` and ``n``: the cheapest threshold if enough rows are new, else the current one."""
    n = evaluate.known(scored).agg(F.count("*").alias("n"))
    best = evaluate.best_threshold_cost(scored)
    return n.crossJoin(F.broadcast(best)).select(F.when(F.col("n") - seen >= least_new, F.col("threshold")).otherwise(float(current)).alias("threshold"), "n")
