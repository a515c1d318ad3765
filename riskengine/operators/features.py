"""Identity keys, per-user windows, learned encodings and sharing degrees.

Windows per user go within spans of time, so that no user has to fit one task. Learned
state is tables that can be saved, joined back by key.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskengine.operators.ordering import exact_quantiles, first_rows, number_rows, ranged

USER, TIME, ROW, AMOUNT = "UID", "TransactionDT", "TransactionID", "TransactionAmt"


def _id_text(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-1)).cast("string")


def with_user(tx: DataFrame) -> DataFrame:
    """``UID``: card, address and the week in which the account seems to have begun; missing parts are -1 and -999."""
    day = "D1_norm" if "D1_norm" in tx.columns else "D1" if "D1" in tx.columns else None
    week = F.floor(F.coalesce(F.col(day), F.lit(-999.0)) / 7).cast("string") if day else F.lit("nan")
    return tx.withColumn(USER, F.concat_ws("_", _id_text(F.col("card1")), _id_text(F.col("addr1")), week))


def with_combinations(tx: DataFrame) -> DataFrame:
    """Joined keys of those columns that are there."""
    have = set(tx.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    pairs = {
        "device_info_combo": ("browser_type", "screen_width", True), "card_email_combo": ("card1", "P_emaildomain_vendor_id", True), "product_network_combo": ("ProductCD", "card4", False),
        "card1_addr1_combo": ("card1", "addr1", True), "os_browser_combo": ("os_type", "browser_type", False),
    }
    return tx.withColumns({n: F.concat_ws("_", *[_id_text(F.col(c)) if ids else text(c) for c in (a, b)]) for n, (a, b, ids) in pairs.items() if {a, b} <= have})


def hash_bucket(c: Column, buckets: int = 10000) -> Column:
    """The MD5 of a text as a 128-bit number, modulo ``buckets``."""
    half = lambda at: F.conv(F.substring(F.md5(c), at, 16), 16, 10).cast("decimal(20,0)") % buckets
    return ((half(1) * (2**64 % buckets) + half(17)) % buckets).cast("int")


def category_codes(df: DataFrame, columns: list[str], fitted: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Codes by the alphabetical order of a column's values; unknown and null values are -1.

    The dictionaries are fitted on ``df`` unless given, and belong with the model.
    """
    fitted, source = dict(fitted or {}), df  # not the joined rows, by which the plan would grow with each column
    for c in columns:
        if c not in fitted:
            values = source.filter(F.col(c).isNotNull()).select(F.col(c).alias("_v")).distinct()
            fitted[c] = dense_codes(values)
        df = df.join(fitted[c].withColumnRenamed("_code", f"{c}_code"), F.col(c) == F.col("_v"), "left").drop("_v")
        df = df.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df, fitted


def dense_codes(values: DataFrame) -> DataFrame:
    """Distinct ``_v`` (texts) numbered from 0 in order; ranges of texts are split by sampled beginnings."""
    leads = ranged(values.select(F.left("_v", F.lit(64)).alias("_lead")).distinct(), "_lead", bucket="_range")
    split = values.withColumn("_lead", F.left("_v", F.lit(64))).join(leads, "_lead")
    return number_rows(split, ["_v"], F.col("_range"), "_code").select("_v", F.col("_code").cast("int").alias("_code"))


def velocity(df: DataFrame, hours: tuple[int, ...] = (1, 12, 24), fill_single: bool = False) -> DataFrame:
    """Count, sum and sum per hour of a user's amounts in the hours before each record.

    Records of the same second are not counted. Users with one record have count 0 and a
    null sum unless ``fill_single``; users with several have 0 where nothing came before.
    A user's history is split into spans as long as the longest window, each with a copy of
    the span before, so a user with very many records does not meet one task. Records
    without a time or a user have no counts and sums.
    """
    span = max(hours) * 3600
    at = F.floor(F.col(TIME) / span)
    copies = F.array(F.struct(at.alias("_span"), F.lit(True).alias("_own")), F.struct((at + 1).alias("_span"), F.lit(False).alias("_own")))
    known = F.col(TIME).isNotNull() & F.col(USER).isNotNull()
    split = df.filter(known).select("*", F.inline(copies))
    # a copy only needs what the sums need
    light = split.select(*[c if c in (USER, TIME, AMOUNT) else F.when(F.col("_own"), F.col(c)).alias(c) for c in df.columns], "_span", "_own")
    sums = {}
    for h in hours:
        w = Window.partitionBy(USER, "_span").orderBy(TIME).rangeBetween(-h * 3600, -1)
        sums |= {f"{USER}_count_{h}h": F.count(AMOUNT).over(w), f"{USER}_amt_sum_{h}h": F.coalesce(F.sum(AMOUNT).over(w), F.lit(0.0))}
    out = light.withColumns(sums).filter("_own").drop("_span", "_own")
    if not fill_single:
        single = df.filter(known).groupBy(USER).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(USER, F.lit(True).alias("_single"))
        out = out.join(single, USER, "left").withColumns({f"{USER}_amt_sum_{h}h": F.when(F.col("_single").isNull(), F.col(f"{USER}_amt_sum_{h}h")) for h in hours}).drop("_single")
    out = out.withColumns({f"{USER}_velocity_{h}h": F.col(f"{USER}_amt_sum_{h}h") / h for h in hours})
    return out.unionByName(df.filter(~known), allowMissingColumns=True)


def sequence_features(df: DataFrame, span: int = 86400) -> DataFrame:
    """Place in the user's history, changes from the record before, and gaps of under 30 seconds (a first record counts as one).

    Windows go within a user's days; a day's first record takes the one before from a table
    with one row for each user and day, so a user with very many records is spread out.
    """
    changed = [c for c in ("ProductCD", "addr1", "device_vendor") if c in df.columns]
    seen = {f"_{c}": F.col(c) for c in (TIME, AMOUNT, *changed)}
    own = df.withColumn("_day", F.floor(F.col(TIME) / span))
    last = own.groupBy(USER, "_day").agg(F.max_by(F.struct(*[c.alias(n) for n, c in seen.items()]), F.struct(TIME, ROW)).alias("_r"), F.count(F.lit(1)).alias("_k"))
    days = Window.partitionBy(USER).orderBy("_day")
    before = last.select(F.col(USER).alias("_u"), F.col("_day").alias("_d"), F.lag("_r").over(days).alias("_last"), (F.sum("_k").over(days) - F.col("_k")).alias("_before"))
    w = Window.partitionBy(USER, "_day").orderBy(TIME, ROW)
    run = own.withColumns({"_prev": F.lag(F.struct(*[c.alias(n) for n, c in seen.items()])).over(w), "_place": F.row_number().over(w) - 1})
    run = run.join(before, F.col(USER).eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d"))).withColumn("_prev", F.coalesce("_prev", "_last"))
    change = lambda c: F.coalesce(F.col(c) - F.col(f"_prev._{c}"), F.lit(0))
    switches = {f"{c}_switch": F.coalesce(F.col(c) != F.col(f"_prev._{c}"), F.lit(False)).cast("int") for c in changed}
    out = run.withColumns(
        {f"{USER}_dt_diff": change(TIME), "txn_sequence": F.col("_before") + F.col("_place"), "amt_change_abs": change(AMOUNT), "time_gap_anomaly": (change(TIME) < 30).cast("int")} | switches
    )
    return out.drop("_day", "_prev", "_place", "_u", "_d", "_last", "_before")


def distinct_per_group(df: DataFrame, group: str, counted: dict[str, str]) -> DataFrame:
    """How many different values of some columns (``counted``: column to name) a row's group has; 0 where the group is null.

    Spark has no distinct window count, so all counts of a group are one aggregation (which
    makes pairs distinct first and so levels hot groups) and one join back.
    """
    n = df.filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.count_distinct(c).alias(out) for c, out in counted.items()])
    return df.join(n, group, "left").withColumns({out: F.coalesce(out, F.lit(0)) for out in counted.values()})


def sharing_degrees(df: DataFrame) -> DataFrame:
    """How many users share a device maker or an address, and how many addresses and domains a card has."""
    for group, counted in (
        ("device_vendor", {USER: "device_vendor_degree"}), ("addr1", {USER: "addr1_degree"}), ("DeviceInfo", {"card1": "cards_per_device"}),
        ("card1", {"addr1": "unique_addrs_per_card", "P_emaildomain": "unique_emails_per_card"}),
    ):
        counted = {c: out for c, out in counted.items() if c in df.columns}
        if group in df.columns and counted:
            df = distinct_per_group(df, group, counted)
    both = (F.col("device_vendor_degree") + F.col("addr1_degree")) / 2
    return df.withColumn("multi_entity_sharing", F.when(F.col("device_vendor").isNotNull() & F.col("addr1").isNotNull(), both))


# The keys that encodings are learned for.
GROUP_KEYS = ("card1", "card4", "addr1", "P_emaildomain_vendor_id", "ProductCD")
COUNT_KEYS = (USER, "card1", "addr1", "card4", "P_emaildomain_vendor_id", "device_vendor")
RISK_KEYS = ("addr1", "card4", "P_emaildomain_vendor_id", "device_vendor", "device_info_combo", "card_email_combo", "ProductCD", "card6", "os_type", "browser_type", "hour_of_day")


@dataclass
class Encoders:
    """Fitted tables: ``users``, ``keys`` (count, mean amount and labels of each key's values) and ``totals`` (one row).

    ``groups``, ``counted`` and ``risky`` are the keys that means, frequencies and rates are applied for.
    """

    users: DataFrame | None
    keys: DataFrame
    totals: DataFrame
    groups: tuple[str, ...] = ()
    counted: tuple[str, ...] = ()
    risky: tuple[str, ...] = ()
    smoothing: float = 500.0

    def save(self, folder: str) -> None:
        """Write the tables, the keys' by key, and with the totals what they are applied for; the tables are written beside each other."""
        said = {n: F.lit(json.dumps(getattr(self, n))) for n in ("groups", "counted", "risky")}
        totals = self.totals.select("log_mean", "log_std", "fraud_rate", F.struct(*[c.alias(n) for n, c in said.items()], F.lit(self.smoothing).alias("smoothing"), F.lit(self.users is not None).alias("users")).alias("applied"))
        jobs = [lambda: totals.write.mode("overwrite").parquet(f"{folder}/totals"), lambda: self.keys.write.mode("overwrite").partitionBy("key").parquet(f"{folder}/keys")]
        if self.users is not None:
            jobs.append(lambda: self.users.write.mode("overwrite").parquet(f"{folder}/users"))
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.totals.sparkSession)(job)) for job in jobs]:
                done.result()

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Encoders:
        totals = spark.read.parquet(f"{folder}/totals")
        a = totals.select("applied.*").first()
        names = (tuple(json.loads(a[n])) for n in ("groups", "counted", "risky"))
        return cls(spark.read.parquet(f"{folder}/users") if a.users else None, spark.read.schema(_KEYS_SCHEMA).parquet(f"{folder}/keys"), totals.drop("applied"), *names, a.smoothing)


_KEYS_SCHEMA = "value string, n long, mean double, labelled long, positive long, key string"


def user_statistics(df: DataFrame) -> DataFrame:
    """First time, mean and deviation of amounts of each user; a deviation of none or 0 is 1."""
    std = F.coalesce(F.nullif(F.stddev_samp(AMOUNT), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(USER).agg(F.min(TIME).alias("first_seen"), F.avg(AMOUNT).alias("user_mean"), std.alias("user_std"))


def totals(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """One row: mean and deviation of the log amount, and the fraud rate."""
    log = F.log1p(AMOUNT)
    return df.agg(F.avg(log).alias("log_mean"), F.stddev_samp(log).alias("log_std"), F.avg(label).alias("fraud_rate"))


def global_statistics(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """``totals`` with the deciles of the amount."""
    return totals(df, label).crossJoin(F.broadcast(exact_quantiles(df, AMOUNT, [k / 10 for k in range(11)]).withColumnRenamed("q", "deciles")))


def key_statistics(df: DataFrame, keys: tuple[str, ...], label: str = "isFraud") -> DataFrame:
    """``key``, ``value``, ``n``, ``mean`` (amount), ``labelled`` and ``positive`` of all keys in one aggregation; nulls are left out."""
    said = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in keys])).alias("_k")
    long = df.select(F.col(AMOUNT), F.col(label).alias("_y"), said).select(AMOUNT, "_y", "_k.*").filter("value IS NOT NULL")
    return long.groupBy("key", "value").agg(F.count("*").alias("n"), F.avg(AMOUNT).alias("mean"), F.count("_y").alias("labelled"), F.sum("_y").cast("long").alias("positive"))


def fit_encoders(df: DataFrame, groups: tuple[str, ...] = GROUP_KEYS, counted: tuple[str, ...] = COUNT_KEYS, risky: tuple[str, ...] = RISK_KEYS, label: str = "isFraud", users: bool = True) -> Encoders:
    """Fit the keys that are there, and users if wanted; each table is one aggregation over the records."""
    groups, counted, risky = (tuple(c for c in names if c in df.columns) for names in (groups, counted, risky))
    keys = tuple(dict.fromkeys((*groups, *counted, *risky)))
    found = key_statistics(df, keys, label) if keys else df.sparkSession.createDataFrame([], _KEYS_SCHEMA)
    return Encoders(user_statistics(df) if users else None, found, totals(df, label), groups, counted, risky)


def apply_users(df: DataFrame, enc: Encoders) -> DataFrame:
    """``days_since_first_txn`` and ``user_amt_zscore``; an unknown user is seen first now and has its own mean."""
    amt = F.col(AMOUNT)
    return df.join(enc.users, USER, "left").withColumns({
        "days_since_first_txn": (F.col(TIME) - F.coalesce("first_seen", TIME)) / 86400,
        "user_amt_zscore": (amt - F.coalesce(F.col("user_mean"), amt)) / F.coalesce(F.col("user_std"), F.lit(1.0)),
    }).drop("first_seen", "user_mean", "user_std")


def apply_totals(df: DataFrame, enc: Encoders) -> DataFrame:
    """``TransactionAmt_log_z``; ``_rate``, the share of fraud, stays for ``apply_keys``."""
    t = enc.totals.select(F.col("log_mean").alias("_lm"), F.col("log_std").alias("_ls"), F.col("fraud_rate").alias("_rate"))
    return df.crossJoin(F.broadcast(t)).withColumn(f"{AMOUNT}_log_z", (F.log1p(AMOUNT) - F.col("_lm")) / F.greatest(F.col("_ls"), F.lit(1e-6))).drop("_lm", "_ls")


#: A key of at most so many values is looked up in a map in one broadcast row; a larger one is joined.
_FEW = 64


def apply_keys(df: DataFrame, enc: Encoders) -> DataFrame:
    """Amounts against group means, frequencies and smoothed rates. Unknown values get the defaults of their kind.

    The driver gets one count for each key. Each key of many values is joined once, in two
    steps of columns for all of them; then those of few values make one row of maps, which is broadcast.
    """
    amt, s = F.col(AMOUNT), enc.smoothing
    keys = list(dict.fromkeys((*enc.groups, *enc.counted, *enc.risky)))
    sizes = {r.key: r["count"] for r in enc.keys.groupBy("key").count().collect()}
    few = [c for c in keys if sizes.get(c, 0) <= _FEW]
    said = F.struct("n", "mean", "labelled", "positive")
    for c in sorted(keys, key=lambda c: c != USER):  # users first, as ``apply_users`` has dealt the records by them
        if c not in few:
            t = enc.keys.filter(F.col("key") == c).select(F.col("value").alias(f"_v_{c}"), said.alias(f"_s_{c}"))
            df = df.join(t, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    if few:  # behind the joins, which would shuffle all maps with each record
        entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col("key") == c, F.struct("value", said))))
        df = df.crossJoin(F.broadcast(enc.keys.filter(F.col("key").isin(few)).agg(*[entry(c).alias(f"_m_{c}") for c in few])))
    df = df.withColumns({f"_s_{c}": F.try_element_at(f"_m_{c}", F.col(c).cast("string")) for c in few})
    out = {}
    for c in keys:
        if c in enc.groups:
            out[f"Amt_div_{c}_mean"] = amt / (F.coalesce(F.col(f"_s_{c}.mean"), amt) + 1e-5)
        if c in enc.counted:
            out[f"{c}_freq_enc"] = F.coalesce(f"_s_{c}.n", F.lit(0))
        if c in enc.risky:
            out[f"{c}_fraud_rate"] = F.coalesce((F.coalesce(f"_s_{c}.positive", F.lit(0)) + s * F.col("_rate")) / (F.col(f"_s_{c}.labelled") + s), F.col("_rate"))
    df = df.withColumns(out)
    if enc.risky:
        df = df.withColumn("composite_risk_score", sum((F.col(f"{c}_fraud_rate") for c in enc.risky), F.lit(0.0)) / len(enc.risky))
    return df.drop("_rate", *[f"{p}_{c}" for p in ("_s", "_m") for c in keys])


def apply_encoders(df: DataFrame, enc: Encoders) -> DataFrame:
    """Adds all that the tables say of each record."""
    return apply_keys(apply_users(apply_totals(df, enc), enc), enc)


def null_shares(df: DataFrame) -> DataFrame:
    """``feature`` and ``null_share`` of every column, in one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "feature", "null_share")


def droppable_columns(df: DataFrame, label: str, threshold: float = 0.99, skip: tuple[str, ...] = (ROW, TIME, AMOUNT), least_known: int = 100, least_gap: float = 0.01) -> DataFrame:
    """Columns mostly null that say little of the label, with the figures: ``feature``, ``null_share``, ``known``, ``gap``, ``drop``."""
    y, cols = F.col(label), [c for c in df.columns if c not in (*skip, label)]
    figures = lambda c: F.struct(F.avg(F.col(c).isNull().cast("int")).alias("null_share"), F.count(c).alias("known"), F.abs(F.avg(F.when(F.col(c).isNull(), y)) - F.avg(F.when(F.col(c).isNotNull(), y))).alias("gap"))
    row = df.agg(*[figures(c).alias(c) for c in cols])
    out = row.unpivot([], cols, "feature", "s").select("feature", "s.*")
    return out.withColumn("drop", ((F.col("null_share") > threshold) & ((F.col("known") < least_known) | (F.col("gap") < least_gap))).cast("int"))


def _by_time(df: DataFrame) -> DataFrame:
    return number_rows(df, [TIME, ROW], F.floor(F.col(TIME) / 3600), "_at", "_n")


def train_rows(df: DataFrame, share: float = 0.85) -> Column:
    """Whether a record is among the first int(n * share) by time and id, as a condition that scans can apply."""
    return first_rows(df, [TIME, ROW], F.floor(F.col(TIME) / 3600), share)


def time_split(df: DataFrame, share: float = 0.85) -> DataFrame:
    """``is_train``: whether a record is among the first int(n * share) by time and id."""
    return df.withColumn("is_train", train_rows(df, share).cast("int"))


def time_folds(df: DataFrame, splits: int = 5) -> DataFrame:
    """``fold``: the expanding-window fold in which a record is tested (1..splits), 0 where it only trains.

    A fold trains on all records with a smaller number.
    """
    size = F.floor(F.col("_n") / (splits + 1))
    fold = F.greatest(F.lit(0), F.lit(splits) - F.floor((F.col("_n") - 1 - F.col("_at")) / F.nullif(size, F.lit(0))))
    return _by_time(df).withColumn("fold", F.coalesce(fold, F.lit(0)).cast("int")).drop("_at", "_n")
