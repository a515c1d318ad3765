"""Distribution baselines, drift and feature quality over many columns at once.

Wide tables are melted to (feature, value) first, so that any number of features is one
grouped aggregation instead of one huge expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.operators.ordering import grouped_quantiles, ranged
from riskengine.session import materialize

SPARSE, PSI_RED, NULL_RED = 0.8, 0.2, 0.1


def finite(c: Column) -> Column:
    """The value, or null for NaN and the infinities."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def melt(df: DataFrame, columns: list[str], ids: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*ids, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(list(ids), columns, "feature", "value")


def baseline(long: DataFrame, bins: int = 10, least: int = 100) -> DataFrame:
    """For each feature: ``n``, ``null_share``, ``is_sparse``, ``edges`` and ``shares`` of equal-width bins.

    Edges are null for at most ``least`` values. The last bin takes its upper edge; a
    constant feature has the edges half below and above it.
    """
    s = long.groupBy("feature").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = s.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    s = materialize(s, "spans")  # a row for each feature, used twice
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    hist = long.filter("value IS NOT NULL").join(F.broadcast(s.select("feature", "lo", "hi")), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("m"))
    maps = hist.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("h"))
    j = s.join(maps, "feature", "left")
    enough = F.col("known") > least
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0)) / F.col("known"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.col("lo") + k * width)
    return j.select(
        "feature", "n", (1 - F.col("known") / F.col("n")).alias("null_share"), (1 - F.col("known") / F.col("n") > SPARSE).alias("is_sparse"),
        F.when(enough, edges).alias("edges"), F.when(enough, shares).alias("shares"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin``, ``lo``, ``hi``, ``n`` of equal-width bins over the finite values; the last bin takes the maximum."""
    v = df.select(finite(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    got = v.crossJoin(F.broadcast(span)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return got.select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def histogram_on(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Shares of all finite values on given edges; values outside count in the denominator only."""
    v = df.select(finite(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL")
    at = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        upper = F.col("v") <= edges[k + 1] if k == len(edges) - 2 else F.col("v") < edges[k + 1]
        at = F.when((F.col("v") >= edges[k]) & upper, k).otherwise(at)
    sums = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).filter("bin IS NOT NULL")


def psi(expected: Column, actual: Column, floor: float = 1e-6) -> Column:
    """The population stability index of two arrays of shares."""
    clip = lambda c: F.greatest(c, F.lit(floor))
    terms = F.zip_with(expected, actual, lambda e, a: (clip(a) - clip(e)) * F.ln(clip(a) / clip(e)))
    return F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)


def drift(base: DataFrame, live: DataFrame, least_live: int = 50) -> DataFrame:
    """``psi``, ``null_drift`` and ``status`` of each feature of a baseline in a live (feature, value) table.

    PSI is 0 for sparse features, without edges, or with at most ``least_live`` live values.
    """
    spread = base.select("feature", "null_share", "is_sparse", "edges", "shares")
    j = live.join(F.broadcast(spread.select("feature", "edges")), "feature")
    size = F.size("edges") - 1
    inside = (F.col("value") >= F.get("edges", F.lit(0))) & (F.col("value") <= F.element_at("edges", -1))
    at = F.when(inside, F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, size - 1))
    s = j.groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"), F.count("value").alias("known"))
    live_sums = s.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.map_from_entries(F.filter(F.collect_list(F.struct("bin", "known")), lambda x: x["bin"].isNotNull())).alias("h"))
    g = spread.join(live_sums, "feature", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "known": F.coalesce("known", F.lit(0))})
    got = F.transform(F.sequence(F.lit(0), F.size("shares") - 1), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0)) / F.col("known"))
    fit = ~F.col("is_sparse") & F.col("edges").isNotNull() & (F.col("known") > least_live)
    g = g.withColumns({"psi": F.when(fit, psi(F.col("shares"), got)).otherwise(0.0), "null_drift": F.abs(1 - F.coalesce(F.try_divide("known", "n"), F.lit(1.0)) - F.col("null_share"))})
    return g.select("feature", "psi", "null_drift", F.when((F.col("psi") > PSI_RED) | (F.col("null_drift") > NULL_RED), "RED").otherwise("GREEN").alias("status"))


def drift_between(long: DataFrame, bins: int = 10, least: int = 100, least_live: int = 50) -> DataFrame:
    """``drift(baseline(...))`` of a (feature, live, value) table, the live rows against the others.

    Both sides go through the same two aggregations, with ``live`` as a key; what they leave
    has a row for each feature and bin.
    """
    s = long.groupBy("feature", "live").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = F.col("lo") == F.col("hi")
    old = s.filter("live = 0").select("feature", F.col("n").alias("n0"), F.col("known").alias("known0"), F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    old = old.withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.col("lo") + k * ((F.col("hi") - F.col("lo")) / bins)))
    # old values are binned by division, live ones on the edges (off by one at most), as stored baselines are
    by_width = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    edge = lambda k: F.get("edges", k)
    by_edge = F.least(by_width + F.when(edge(by_width + 1) <= F.col("value"), 1).when(edge(by_width) > F.col("value"), -1).otherwise(0), F.lit(bins - 1))
    at = F.when(F.col("live") == 0, by_width).when((F.col("value") >= F.col("lo")) & (F.col("value") <= F.element_at("edges", -1)), by_edge)
    joined = long.filter("value IS NOT NULL").join(F.broadcast(old), "feature")
    hist = joined.groupBy("feature", "live", at.alias("bin")).agg(F.count("*").alias("m")).filter("bin IS NOT NULL")
    side = lambda k: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("live") == k, F.struct("bin", "m"))), lambda x: x.isNotNull()))
    maps = hist.groupBy("feature").agg(side(0).alias("h0"), side(1).alias("h1"))
    new = s.filter("live = 1").select("feature", F.col("n").alias("n1"), F.col("known").alias("known1"))
    j = old.join(maps, "feature", "left").join(new, "feature", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n1", "known1")})
    share = lambda side: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at(f"h{side}", k), F.lit(0)) / F.col(f"known{side}"))
    null_share = 1 - F.col("known0") / F.col("n0")
    fit = ~(null_share > SPARSE) & (F.col("known0") > least) & (F.col("known1") > least_live)
    j = j.withColumns({"psi": F.when(fit, psi(share(0), share(1))).otherwise(0.0), "null_drift": F.abs(1 - F.coalesce(F.try_divide("known1", "n1"), F.lit(1.0)) - null_share)})
    return j.select("feature", "psi", "null_drift", F.when((F.col("psi") > PSI_RED) | (F.col("null_drift") > NULL_RED), "RED").otherwise("GREEN").alias("status"))


def ks_scores(long: DataFrame, label: str = "y") -> DataFrame:
    """``ks``, means by class, ``null_share`` and ``strength`` of each (feature, label, value) table's feature.

    Values are counted by class first. Running sums go within sampled ranges of values,
    shifted by the ranges before, so features with many values are spread out.
    """
    v = long.filter(F.col("value").isNotNull() & F.col(label).isNotNull())
    points = v.groupBy("feature", "value").agg(F.sum(label).alias("a"), F.sum(1 - F.col(label)).alias("b"))
    split = ranged(points, "value", ("feature",), 256)
    inner = Window.partitionBy("feature", "_b").orderBy("value")
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy("feature", "_b").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    whole = Window.partitionBy("feature")
    shift = sums.select(
        "feature", "_b", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"), F.sum("sa").over(whole).alias("all_a"), F.sum("sb").over(whole).alias("all_b")
    )
    run = split.withColumns({"ra": F.sum("a").over(inner), "rb": F.sum("b").over(inner)}).join(shift, ["feature", "_b"])
    gap = F.abs(F.try_divide(F.col("ra") + F.col("pa"), F.col("all_a")) - F.try_divide(F.col("rb") + F.col("pb"), F.col("all_b")))
    ks = run.groupBy("feature").agg(F.max(gap).alias("ks"))
    means = long.groupBy("feature").agg(F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("mean_fraud"), F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("mean_legit"), F.avg(F.col("value").isNull().cast("int")).alias("null_share"))
    strength = F.when(F.col("ks") > 0.4, "strong").when(F.col("ks") > 0.2, "good").when(F.col("ks") > 0.05, "weak").otherwise("useless")
    return means.join(ks, "feature", "left").withColumn("ks", F.coalesce("ks", F.lit(0.0))).withColumn("strength", strength)


#: Columns in a block of a matrix of products, and bytes of such blocks that a task adds up at a time.
_BLOCK, _HELD = 64, 64 << 20


def _add_up(group: pa.Table) -> np.ndarray:
    return np.sum(np.asarray(group.column("g").combine_chunks().flatten()).reshape(group.num_rows, -1), axis=0)


def product_blocks(df: DataFrame, columns: list[str], block: int = _BLOCK, held: int = _HELD) -> tuple[DataFrame, int]:
    """The sums of products of all pairs of columns around their means, as blocks (``i``, ``j``, ``g``) with i <= j, and the number of rows.

    A task multiplies its rows by BLAS, one batch at a time, and gives one row for each
    block; blocks of many tasks are added up in two rounds, about a thousand at a time. Where
    all blocks take more than ``held`` bytes, the table is read once for each part of them.
    """
    means = df.agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns]).first()
    mean = np.array([means[c] or 0.0 for c in columns])
    size = range(0, len(columns), block)
    todo = [(i, j) for i in range(len(size)) for j in range(i, len(size))]
    most = max(1, held // (8 * block * block))
    schema = "i int, j int, part int, g array<double>"

    def part(some: list[tuple[int, int]]) -> DataFrame:
        need = sorted({c for i, j in some for k in (i, j) for c in range(k * block, min(len(columns), (k + 1) * block))})
        place = {c: k for k, c in enumerate(need)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(need))]) - mean[need][:, None]
                cut = {k: x[place[k * block] : place[k * block] + min(block, len(columns) - k * block)] for k in {k for p in some for k in p}}
                for i, j in some:
                    g = cut[i] @ cut[j].T
                    total[i, j] = total[i, j] + g if (i, j) in total else g
            if total:
                keys = list(total)
                number = TaskContext.get().partitionId() % 1024
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([number] * len(keys), pa.int32()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], ["i", "j", "part", "g"])

        return df.select(*[columns[c] for c in need]).mapInArrow(run, schema)

    def add(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([_add_up(group)], pa.list_(pa.float64()))], [*["i", "j", "part"][: len(key)], "g"])

    out = None
    for k in range(0, len(todo), most):
        once = part(todo[k : k + most]).groupBy("i", "j", "part").applyInArrow(add, schema)
        both = once.groupBy("i", "j").applyInArrow(add, "i int, j int, g array<double>")
        out = both if out is None else out.unionByName(both)
    return out, means["_n"]


def correlated_pairs(df: DataFrame, columns: list[str], most: float = 0.0, null_value: float = -999.0, block: int = _BLOCK) -> DataFrame:
    """``a``, ``b``, ``r``: absolute correlations of at least ``most`` of each pair of columns; nulls and NaN count as a value.

    Work and plan grow with the columns' products in blocks, not with an expression for each
    pair; the driver gets one variance for each column. Pairs with a constant column have no row.
    """
    full = df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(null_value)).alias(c) for c in columns])
    schema = "a string, b string, r double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    blocks, n = product_blocks(full, columns, block)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    blocks = materialize(blocks, "products")
    spread = np.zeros(len(columns))
    wide = lambda k: min(block, len(columns) - k * block)
    own = blocks.filter("i = j").select("i", F.col("g"))
    step = F.expr("transform(sequence(0, CAST(sqrt(size(g)) AS INT) - 1), k -> g[k * CAST(sqrt(size(g)) AS INT) + k])")
    for r in own.select("i", step.alias("s")).collect():
        spread[r.i * block : r.i * block + len(r.s)] = r.s
    root = np.sqrt(np.maximum(spread, 0.0))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows, cols = np.divmod(np.arange(wide(i) * wide(j)), wide(j))
                rows, cols = rows + i * block, cols + j * block
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.abs(np.asarray(g.values) / (root[rows] * root[cols]))
                keep = np.flatnonzero((rows < cols) & (root[rows] * root[cols] > 0) & (r >= most))
                names = np.array(columns, object)
                yield pa.RecordBatch.from_arrays([pa.array(names[rows[keep]], pa.string()), pa.array(names[cols[keep]], pa.string()), pa.array(r[keep], pa.float64())], ["a", "b", "r"])

    return blocks.select("i", "j", "g").mapInArrow(pairs, schema)


def psi_between(long: DataFrame, bins: int = 10) -> DataFrame:
    """``feature`` and ``psi`` of a (feature, live, value) table: live rows against the others on their quantiles; empty bins count as 1e-4.

    Features are the groups of each aggregation: how often the table is read does not grow with them.
    """
    v = long.filter("value IS NOT NULL")
    q = grouped_quantiles(v.filter("live = 0"), [k / bins for k in range(bins + 1)]).select("feature", F.array_distinct("q").alias("q"))
    inside = (F.col("value") >= F.get("q", F.lit(0))) & (F.col("value") <= F.element_at("q", -1))
    at = F.when(inside, F.least(F.size(F.filter("q", lambda e: e <= F.col("value"))) - 1, F.size("q") - 2))
    n = v.join(F.broadcast(q), "feature").groupBy("feature", at.alias("bin")).agg(F.count_if(F.col("live") == 0).alias("e"), F.count_if(F.col("live") == 1).alias("o"))
    share = lambda c: F.when(F.col(c) > 0, F.col(c) / F.sum(c).over(Window.partitionBy("feature"))).otherwise(1e-4)
    e, o = F.col("_e"), F.col("_o")
    shares = n.select("feature", "bin", share("e").alias("_e"), share("o").alias("_o")).filter("bin IS NOT NULL")
    return shares.groupBy("feature").agg(F.sum((e - o) * F.ln(e / o)).alias("psi"))


def psi_by_quantiles(a: DataFrame, b: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``psi_between`` of one column of two tables, as one row; 0 without a bin."""
    side = lambda t, live: t.select(F.lit(value).alias("feature"), F.lit(live).alias("live"), F.col(value).cast("double").alias("value"))
    return psi_between(side(a, 0).unionByName(side(b, 1)), bins).agg(F.coalesce(F.first("psi"), F.lit(0.0)).alias("psi"))


def psi_by_categories(a: DataFrame, b: DataFrame, value: str, top: int = 50) -> DataFrame:
    """PSI of a categorical column between two tables over the first one's ``top`` most frequent values."""
    counts = lambda t: t.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("c")).agg(F.count("*").alias("n"))
    share = lambda t, n: t.withColumn(n, F.col("n") / F.sum("n").over(Window.partitionBy()))
    base = share(counts(a), "e").orderBy(F.col("n").desc(), "c").limit(top).select("c", "e")
    j = base.join(share(counts(b), "o").select("c", "o"), "c", "left")
    o = F.coalesce("o", F.lit(1e-4))
    return j.agg(F.coalesce(F.sum((F.col("e") - o) * F.ln(F.col("e") / o)), F.lit(0.0)).alias("psi"))


def daily_trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean and deviation of each day from the first to the last, days without rows included."""
    day = F.to_date(ts)
    per = df.groupBy(day.alias("day")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def density(df: DataFrame, value: str, points: int = 100, fine: int = 256, reach: float = 9.0) -> DataFrame:
    """A Gaussian kernel density at ``points`` places between the extremes, by Scott's bandwidth.

    Values are put on a grid of a ``fine``-th of the bandwidth, each on the four nodes around
    it by cubic interpolation (an error of some 1e-11 of the largest density), of which three
    powers of the place within a cell are summed up; only the nodes then meet the places
    within ``reach`` bandwidths. The work after the one aggregation does not grow with the rows.
    """
    v = df.select(finite(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL")
    s = v.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("sd > 0")
    s = s.select("n", "lo", "hi", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h")).withColumn("d", F.col("h") / fine)
    spot = (F.col("v") - F.col("lo")) / F.col("d")
    cells = v.crossJoin(F.broadcast(s.select("lo", "d"))).select(F.floor(spot).alias("cell"), (spot - F.floor(spot)).alias("t"))
    sums = cells.groupBy("cell").agg(F.count("*").cast("double").alias("s0"), F.sum("t").alias("s1"), F.sum(F.col("t") * F.col("t")).alias("s2"), F.sum(F.col("t") * F.col("t") * F.col("t")).alias("s3"))
    s0, s1, s2, s3 = (F.col(f"s{k}") for k in range(4))
    # the weights of the nodes before, at, after and behind the cell, summed over its values
    weights = {-1: (-s3 + 3 * s2 - 2 * s1) / 6, 0: (s3 - 2 * s2 - s1 + 2 * s0) / 2, 1: (-s3 + s2 + 2 * s1) / 2, 2: (s3 - s1) / 6}
    nodes = sums.select(F.inline(F.array(*[F.struct((F.col("cell") + k).alias("node"), w.alias("w")) for k, w in weights.items()]))).groupBy("node").agg(F.sum("w").alias("w"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    near = nodes.crossJoin(F.broadcast(s)).withColumns({"at": F.col("lo") + F.col("node") * F.col("d"), "step": step})
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - reach * F.col("h") - F.col("lo")) / F.col("step")))
    last = F.least(F.lit(points - 1), F.floor((F.col("at") + reach * F.col("h") - F.col("lo")) / F.col("step")))
    met = near.filter(first <= last).select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("k"))
    z = (F.col("lo") + F.col("k") * F.col("step") - F.col("at")) / F.col("h")
    found = met.groupBy("k").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("t"))
    grid = s.select("n", "lo", "hi", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    got = F.greatest(F.coalesce("t", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return grid.join(found, "k", "left").select("k", (F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), got.alias("density"))


def psi_table(a: DataFrame, b: DataFrame, columns: list[str], top: int = 15) -> DataFrame:
    """``feature``, ``psi`` and ``status`` of numeric columns between two tables; the ``top`` largest, largest first."""
    side = lambda t, live: t.select(*[F.col(c).cast("double").alias(c) for c in columns], F.lit(live).alias("live")).unpivot(["live"], columns, "feature", "value")
    known = a.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = known.join(psi_between(side(a, 0).unionByName(side(b, 1))), "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    status = F.when(F.col("psi") > 0.2, "critical").when(F.col("psi") > 0.1, "warning").otherwise("stable")
    return out.withColumn("status", status).orderBy(F.col("psi").desc(), "feature").limit(top)


def quality_report(a: DataFrame, b: DataFrame, columns: list[str], label: str, tested: int = 20) -> DataFrame:
    """Signal, redundancy and stability of features of two tables with a label: ``feature``, ``ks``, ``strength``, ``twin``
    (the column it correlates with most) and ``twin_r``, ``psi`` and ``status`` (of the first ``tested``), strongest first."""
    ks = ks_scores(melt(a.unionByName(b), columns, (label,)).withColumnRenamed(label, "y")).select("feature", "ks", "strength")
    pairs = correlated_pairs(a, columns)
    both = pairs.select(F.col("a").alias("feature"), F.col("b").alias("twin"), "r").unionByName(pairs.select(F.col("b").alias("feature"), F.col("a").alias("twin"), "r"))
    twin = both.groupBy("feature").agg(F.max_by("twin", F.struct("r", "twin")).alias("twin"), F.max("r").alias("twin_r"))
    drifted = psi_table(a, b, columns[:tested], tested)
    return ks.join(twin, "feature", "left").join(drifted, "feature", "left").orderBy(F.col("ks").desc(), "feature")
