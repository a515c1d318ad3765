"""Serving queries: series, importances, alert lists, segment and operations figures, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.operators.graph import connected_components
from riskengine.operators.ordering import number_rows


def running_series(df: DataFrame, threshold: float, order: str = "seq") -> DataFrame:
    """Cumulative savings and losses over known fraud, by hour buckets of the order so that no task sees all rows."""
    caught = F.when((F.col("y") == 1) & (F.col("p") >= threshold), F.col("amt")).otherwise(0.0)
    missed = F.when((F.col("y") == 1) & (F.col("p") < threshold), F.col("amt")).otherwise(0.0)
    rows = df.select(order, "ts", caught.alias("s"), missed.alias("l"), F.floor(F.col("ts") / 3600).alias("_b"))
    inner = Window.partitionBy("_b").orderBy("ts", order)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_b").agg(F.sum("s").alias("bs"), F.sum("l").alias("bl")).select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("bs", "bl")])
    run = rows.withColumns({"rs": F.sum("s").over(inner), "rl": F.sum("l").over(inner)}).join(F.broadcast(shift), "_b")
    return run.select(order, "ts", (F.col("rs") + F.col("bs")).alias("cumulative_savings"), (F.col("rl") + F.col("bl")).alias("cumulative_loss"))


def drop_repeats(series: DataFrame, order: list[str], bucket: Column, measures: tuple[str, ...] = ("cumulative_savings", "cumulative_loss")) -> DataFrame:
    """Points that differ from the one before in some measure; the first is kept.

    ``bucket`` grows (or stays) with the order. Points are compared within their bucket; a
    bucket's first one is compared with the last of the bucket before, from a table with one
    row for each bucket.
    """
    now, at = F.struct(*measures), F.struct(*order)
    own = series.withColumn("_b", bucket)
    last = own.groupBy("_b").agg(F.max_by(now, at).alias("_m")).select(F.col("_b").alias("_c"), F.lag("_m").over(Window.orderBy("_b")).alias("_last"))
    run = own.withColumn("_prev", F.lag(now).over(Window.partitionBy("_b").orderBy(*order))).join(F.broadcast(last), F.col("_b").eqNullSafe(F.col("_c")))
    before = F.coalesce("_prev", "_last")
    return run.filter(before.isNull() | (before != now)).drop("_b", "_c", "_prev", "_last")


def decimate(series: DataFrame, order: list[str], bucket: Column, most: int = 1000) -> DataFrame:
    """About ``most`` points at even steps, with the last one; numbered bucket by bucket."""
    df = number_rows(series, order, bucket, "_n", "_all")
    return df.filter((F.col("_n") % F.ceil(F.col("_all") / most) == 0) | (F.col("_n") == F.col("_all") - 1)).drop("_n", "_all")


def mean_impacts(explained: DataFrame, tx_col: str = "id", list_col: str = "explanations") -> DataFrame:
    """Mean absolute impact of each feature over all records of a batch, absent ones as 0."""
    n = explained.agg(F.count("*").alias("_n"))
    flat = explained.select(F.explode(list_col).alias("e")).groupBy(F.col("e.feature").alias("feature")).agg(F.sum(F.abs("e.impact")).alias("_s"))
    return flat.crossJoin(F.broadcast(n)).select("feature", (F.col("_s") / F.col("_n")).alias("value"))


def merge_importance(old: DataFrame, new: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Moving averages of importances: features absent from the batch stay, new ones start from 0."""
    j = old.select("feature", F.col("value").alias("o")).join(new.select("feature", F.col("value").alias("n")), "feature", "full")
    return j.select("feature", F.when(F.col("n").isNull(), F.col("o")).otherwise(F.coalesce("o", F.lit(0.0)) * (1 - alpha) + F.col("n") * alpha).alias("value"))


def top_explanations(list_col: str = "explanations", n: int = 10, least: float = 1e-4) -> Column:
    """A record's strongest impacts, largest first, by feature where equal."""
    strong = F.filter(list_col, lambda e: F.abs(e["impact"]) > least)
    keyed = F.transform(strong, lambda e: F.struct((-F.abs(e["impact"])).alias("k"), e["feature"].alias("feature"), e["impact"].alias("impact")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda e: F.struct(e["feature"].alias("feature"), e["impact"].alias("impact")))


def linear_explanations(weights: dict[str, float]) -> Column:
    """A linear model's contributions as (feature, impact); absent values count 0."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w).alias("impact")) for c, w in sorted(weights.items())])


def alerts(scored: DataFrame, n: int = 50) -> DataFrame:
    return scored.orderBy(F.col("p").desc(), F.col("id")).limit(n)


def hierarchy_totals(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Sums of all levels of a hierarchy with a grouping level (0: all levels given); null labels are ``Unknown``."""
    known = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in levels], value)
    return known.rollup(*levels).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def segment_performance(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg("p").alias("avg_score"), F.avg("y").alias("avg_truth"), F.count("*").alias("n"))


def alerts_by_hour(df: DataFrame, ts: Column, threshold: float) -> DataFrame:
    return df.filter(F.col("p") >= threshold).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def ops_figures(df: DataFrame, now: Column, block: float = 0.8) -> DataFrame:
    """Queue health: ``alerts`` and their ``load``, ``mttr_minutes``, ``risk_velocity`` and ``auto_resolution``."""
    s = df.agg(F.count_if(F.col("p") > block).alias("alerts"), F.count("*").alias("n"), F.min("ts").alias("oldest"), F.count_if((F.col("p") < 0.15) | (F.col("p") >= 0.75)).alias("auto"))
    load = F.when(F.col("alerts") > 20, "CRITICAL").when(F.col("alerts") > 10, "HIGH").otherwise("NORMAL")
    return s.select(
        "alerts", load.alias("load"), F.greatest(F.lit(2.0), (now - F.col("oldest")) / 60 / 2).alias("mttr_minutes"),
        F.floor(F.col("alerts") / 10).alias("risk_velocity"), F.coalesce(F.try_divide(100 * F.col("auto"), F.col("n")), F.lit(0.0)).alias("auto_resolution"),
    )


def strategy_figures(df: DataFrame, soft: float, hard: float, challenge_cost: float = 15.0) -> DataFrame:
    hit = F.col("p") >= hard
    s = df.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("alerts"), F.count_if((F.col("p") >= soft) & ~hit).alias("challenged"),
        F.coalesce(F.sum(F.when((F.col("y") == 1) & ~hit, F.col("amt"))), F.lit(0.0)).alias("missed"), F.coalesce(F.sum(F.when(hit, F.col("amt"))), F.lit(0.0)).alias("at_risk"),
    )
    return s.select(
        (1 - F.try_divide("alerts", "n")).alias("approval_rate"), F.try_divide("challenged", "n").alias("challenge_rate"), F.col("at_risk").alias("revenue_at_risk"), (F.col("missed") + challenge_cost * F.col("alerts")).alias("total_cost")
    )


def fraud_rings(tx: DataFrame, user: str, device: str, label: str = "isFraud", top: int = 3, least_fraud: int = 1) -> DataFrame:
    """The largest groups of users and devices that records link: ``ring`` (smallest node), ``size``, ``users``, ``devices``.

    Only devices with more than ``least_fraud`` fraudulent records link.
    """
    bad = tx.filter(F.col(device).isNotNull() & F.col(user).isNotNull()).groupBy(device).agg(F.sum(label).alias("_f")).filter(F.col("_f") > least_fraud).select(device)
    edges = tx.join(bad, device, "left_semi").filter(F.col(user).isNotNull()).select(F.concat(F.lit("d:"), F.col(device).cast("string")).alias("src"), F.concat(F.lit("u:"), F.col(user).cast("string")).alias("dst"))
    of = connected_components(edges)
    sizes = of.groupBy(F.col("component").alias("ring")).agg(F.count("*").alias("size"), F.count_if(F.col("node").startswith("u:")).alias("users"), F.count_if(F.col("node").startswith("d:")).alias("devices"))
    return sizes.orderBy(F.col("size").desc(), "ring").limit(top)


def feature_log(scored: DataFrame, features: list[str], seq: str) -> DataFrame:
    """``feature``, ``value``, ``seq`` rows of a batch, for drift."""
    return scored.select(F.col(seq).alias("seq"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["seq"], features, "feature", "value")


def drift_report(log: DataFrame, importance: DataFrame, base: DataFrame, top: int = 30, least: int = 10) -> DataFrame:
    """Drift of the most important features that have enough values in the log."""
    from riskengine.operators.monitor import drift

    wanted = importance.orderBy(F.col("value").desc(), "feature").limit(top).select("feature")
    enough = log.filter("value IS NOT NULL").groupBy("feature").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("feature")
    picked = wanted.join(enough, "feature", "left_semi")
    return drift(base.join(F.broadcast(picked), "feature", "left_semi"), log, least_live=least)
