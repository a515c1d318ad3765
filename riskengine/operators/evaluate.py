"""Evaluation of scores against truth: ranking metrics, thresholds, costs, calibration.

Scored tables have ``y`` (0 or 1), ``p`` and ``amt``. Rows are first summed up by distinct
score or by grid bucket, which is one partial aggregation; only these small sums are
ordered. Rows without truth or score are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.operators.ordering import ranged

FEE_FRAUD, FEE_FALSE_ALARM, FALSE_ALARM_SHARE = 30.0, 12.5, 0.15


def known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("y").isNotNull() & F.col("p").isNotNull())


def by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return known(df).groupBy("p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def _cumulated(scores: DataFrame, ascending: bool, ranges: int = 256) -> DataFrame:
    """Running ``tp``/``fp`` over the order of scores, and the totals ``all_pos``/``all_neg``.

    Runs within sampled ranges of scores are shifted by the sums of the ranges before, so
    many distinct scores do not meet in one task, however close together they are.
    """
    order = (F.col("p").asc() if ascending else F.col("p").desc(),)
    split = ranged(scores, "p", (), ranges)
    inner = Window.partitionBy("_b").orderBy(*order)
    sums = split.groupBy("_b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    outer = Window.orderBy(F.col("_b").asc() if ascending else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shift = sums.select("_b", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"before_{c}") for c in ("bp", "bn")], F.sum("bp").over(whole).alias("all_pos"), F.sum("bn").over(whole).alias("all_neg"))
    run = split.withColumns({"tp": F.sum("pos").over(inner), "fp": F.sum("neg").over(inner)}).join(shift, "_b")
    return run.withColumns({"tp": F.col("tp") + F.col("before_bp"), "fp": F.col("fp") + F.col("before_bn")}).drop("_b", "before_bp", "before_bn")


def roc_auc(df: DataFrame) -> DataFrame:
    """``roc_auc``, exact with ties counting half; 0.5 if a class is missing."""
    return roc_auc_of(by_score(df))


def roc_auc_of(scores: DataFrame) -> DataFrame:
    """``roc_auc`` of distinct scores with their positives and negatives (``by_score``)."""
    c = _cumulated(scores, ascending=True)
    won = F.sum(F.col("pos") * (F.col("fp") - F.col("neg")) + F.col("pos") * F.col("neg") / 2)
    return c.agg((won / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))).alias("a")).select(F.coalesce("a", F.lit(0.5)).alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """``average_precision``: the sum of recall steps times precision; 0 without positives."""
    c = _cumulated(by_score(df), ascending=False)
    got = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("all_pos"), F.lit(0))
    return c.agg(got.alias("a")).select(F.coalesce("a", F.lit(0.0)).alias("average_precision"))


def roc_points(df: DataFrame) -> DataFrame:
    """Each distinct score as a threshold with its ``tpr``, ``fpr`` and ``precision``."""
    c = _cumulated(by_score(df), ascending=False)
    return c.select(F.col("p").alias("threshold"), F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + k * (hi - lo) / (n - 1) for k in range(n)]


def at_thresholds(df: DataFrame, grid: list[float]) -> DataFrame:
    """What each threshold of a grid calls fraud: counts and amounts (tp, fp, fn, tn, tp_amt, fp_amt, fn_amt).

    A row goes to the highest grid point that its score reaches (one array search with the
    same doubles), buckets are summed, and sums over the grid's few rows make the rest;
    nothing is multiplied by the grid.
    """
    spark, grid = df.sparkSession, sorted(grid)
    steps = F.array(*map(F.lit, grid))
    i = F.aggregate(steps, F.lit(-1), lambda n, t: n + (F.col("p") >= t).cast("int")) if len(grid) <= 8 else _bucket(grid)
    y, amt = F.col("y") == 1, F.coalesce("amt", F.lit(0.0))
    part = known(df).withColumn("i", i).groupBy("i").agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.sum(F.when(y, amt).otherwise(0.0)).alias("pos_amt"), F.sum(F.when(y, 0.0).otherwise(amt)).alias("neg_amt")
    )
    points = spark.createDataFrame(list(enumerate(grid)) + [(-1, None)], "i int, threshold double").join(part, "i", "left")
    up, all_ = Window.orderBy(F.col("i").desc()), Window.partitionBy()
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    out = points.select("i", "threshold", *[sums(c, up).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"), ("pos_amt", "tp_amt"), ("neg_amt", "fp_amt"))], *[sums(c, all_).alias(f"all_{c}") for c in ("pos", "neg", "pos_amt")])
    return out.filter("i >= 0").select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"), "tp_amt", "fp_amt", (F.col("all_pos_amt") - F.col("tp_amt")).alias("fn_amt"))


def _bucket(grid: list[float]) -> Column:
    """The highest i with p >= grid[i], by a decision tree of comparisons; -1 below all."""

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("p") >= grid[mid], tree(mid, hi)).otherwise(tree(lo, mid))

    return F.when(F.col("p") >= grid[0], tree(0, len(grid))).otherwise(-1)


def cost_at(points: DataFrame, fee_fraud: float = FEE_FRAUD, fee_alarm: float = FEE_FALSE_ALARM, share: float = FALSE_ALARM_SHARE) -> DataFrame:
    """``cost``: missed fraud with its fee, and false alarms with theirs and a share of the amount."""
    return points.withColumn("cost", F.col("fn_amt") + fee_fraud * F.col("fn") + fee_alarm * F.col("fp") + share * F.col("fp_amt"))


def cost_curve(df: DataFrame, points: int = 50) -> DataFrame:
    return cost_at(at_thresholds(df, linspace(0.01, 0.99, points))).select(F.round("threshold", 3).alias("threshold"), F.round("cost", 2).alias("total_loss"))


def best_threshold_cost(df: DataFrame, points: int = 100) -> DataFrame:
    """The lowest of the cheapest thresholds; 0.5 for an empty table."""
    costs = cost_at(at_thresholds(df, linspace(0.01, 0.99, points)))
    best = costs.agg(F.min_by("threshold", F.struct(F.round("cost", 6), "threshold")).alias("t"), F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    return best.select(F.when(F.col("n") > 0, F.col("t")).otherwise(0.5).alias("threshold"))


def best_threshold_fbeta(df: DataFrame, beta: float = 2.0) -> DataFrame:
    """The lowest score with the highest F-beta; 0.5 for an empty table."""
    c = _cumulated(by_score(df), ascending=False)
    precision, recall, b = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide("tp", "all_pos"), beta * beta
    f = F.round(F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0)), 9)
    return c.agg(F.max_by("p", F.struct(f, -F.col("p"))).alias("t")).select(F.coalesce("t", F.lit(0.5)).alias("threshold"))


def best_threshold_fpr(df: DataFrame, most: float = 0.02) -> DataFrame:
    """The score with most recall among those whose false-positive rate is at most ``most``; else 0.5."""
    c = _cumulated(by_score(df), ascending=False).filter(F.coalesce(F.try_divide("fp", "all_neg"), F.lit(0.0)) <= most)
    return c.agg(F.min_by("p", F.struct(-F.col("tp"), F.col("p"))).alias("t")).select(F.coalesce("t", F.lit(0.5)).alias("threshold"))


def simulation_table(df: DataFrame, points: int = 101) -> DataFrame:
    """Precision (1 where nothing is called fraud), recall and insult rate at each threshold, to 4 places."""
    c = at_thresholds(df, linspace(0.0, 1.0, points))
    share = lambda a, b, none: F.round(F.coalesce(F.try_divide(a, b), F.lit(none)), 4)
    return c.select(F.round("threshold", 2).alias("threshold"), share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn"), 0.0).alias("recall"), share(F.col("fp"), F.col("fp") + F.col("tn"), 0.0).alias("insult_rate"))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    return known(df).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))


def profit_and_loss(df: DataFrame, threshold: float) -> DataFrame:
    """One row: performance, money and counts at a threshold. One class alone does no harm."""
    y, hit, amt = F.col("y") == 1, F.col("p") >= threshold, F.coalesce("amt", F.lit(0.0))
    s = known(df).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
        *[F.coalesce(F.sum(F.when(m, amt)), F.lit(0.0)).alias(n) for m, n in ((y & hit, "tp_amt"), (~y & hit, "fp_amt"), (y & ~hit, "fn_amt"))],
    )
    gross = F.col("tp_amt") + FEE_FRAUD * F.col("tp")
    loss = FEE_FALSE_ALARM * F.col("fp") + FALSE_ALARM_SHARE * F.col("fp_amt")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-6), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-6)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return s.select(
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-6), 4).alias("f1"),
        F.round(F.col("fp") / (F.col("fp") + F.col("tn") + 1e-6), 4).alias("fpr_insult_rate"), F.round(gross, 2).alias("gross_savings"), F.round(loss, 2).alias("false_positive_loss"),
        F.round(gross - loss, 2).alias("net_savings"), F.round(F.col("fn_amt"), 2).alias("fraud_loss_missed"), "tp", "fp", "fn", "tn", n.alias("total"),
        F.round(F.coalesce(F.try_divide(100 * (F.col("tp") + F.col("fn")), n), F.lit(0.0)), 2).alias("fraud_rate"),
    )


def calibration_curve(df: DataFrame, bins: int = 10, least: int = 10) -> DataFrame:
    """Mean truth and mean score of each non-empty equal bin; nothing for under ``least`` rows."""
    b = known(df).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    sums = b.groupBy("bin").agg(F.avg("y").alias("prob_true"), F.avg("p").alias("prob_pred"), F.count("*").alias("n"))
    return sums.withColumn("_all", F.sum("n").over(Window.partitionBy())).filter(F.col("_all") >= least).drop("_all")


def class_balance(df: DataFrame) -> DataFrame:
    """``scale``: the root of negatives over positives."""
    return df.agg(F.sqrt(F.try_divide(F.count_if(F.col("y") == 0).cast("double"), F.count_if(F.col("y") == 1))).alias("scale"))


def ensemble_scores(models: list[str]) -> dict[str, dict[str, float]]:
    """The weightings that are tried: each model, each pair at 50:50, 70:30 and 30:70, and a triple in equal parts."""
    out = {m: {m: 1.0} for m in models}
    for k, a in enumerate(models):
        for b in models[k + 1 :]:
            out |= {f"{a}:{b}:{w:g}": {a: w, b: 1 - w} for w in (0.5, 0.7, 0.3)}
    if len(models) == 3:
        out[":".join(models)] = {m: 1 / 3 for m in models}
    return out


def weighted_score(weights: dict[str, float]) -> Column:
    return sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0))


def ensemble_report(df: DataFrame, models: list[str], threshold: float) -> DataFrame:
    """``net_savings`` of every weighting; all of them are worked out in one pass over the rows."""
    weights = ensemble_scores(models)
    wide = df.select("y", "amt", F.explode(F.array(*[F.struct(F.lit(n).alias("ensemble"), weighted_score(w).alias("p")) for n, w in weights.items()])).alias("_e")).select("y", "amt", "_e.*")
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    gain = F.when(y & hit, F.col("amt") + FEE_FRAUD).when(~y & hit, -(FEE_FALSE_ALARM + FALSE_ALARM_SHARE * F.col("amt"))).otherwise(0.0)
    return wide.groupBy("ensemble").agg(F.round(F.sum(gain), 2).alias("net_savings"))


def nearest_point(curve: DataFrame, x: str, value: float) -> DataFrame:
    """The curve's row nearest to a value; the smaller of two as near."""
    return curve.agg(F.min_by(F.struct("*"), F.struct(F.round(F.abs(F.col(x) - value), 9), F.col(x))).alias("_r")).select("_r.*")


