"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, order: list[str], bucket: Column, number: str = "_at", total: str | None = None) -> DataFrame:
    """``number``: the place from 0 of each row in the order of ``order``; ``total``: the number of rows.

    ``bucket`` has to grow (or stay) with the order, like the hour of a time. Rows are
    ranked within their bucket and shifted by the sizes of the buckets before; the table of
    sizes has a row for each bucket only.
    """
    df = df.withColumn("_bucket", bucket)
    ranked = df.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_size"))
    shift = sizes.select(
        F.col("_bucket").alias("_b"), (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_all")
    )
    out = ranged_join(ranked, shift).withColumn(number, F.col("_in") - 1 + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_bucket", "_in", "_b", "_before", "_all")


def ranged_join(ranked: DataFrame, shift: DataFrame) -> DataFrame:
    return ranked.join(shift, F.col("_bucket").eqNullSafe(F.col("_b")))


def first_rows(df: DataFrame, order: list[str], bucket: Column, share: float) -> Column:
    """Whether a row is among the first int(n * share) in the order of two columns, as a condition on them.

    Up to three counts find the row where the rest begins: of the buckets, of the first
    column's values in one bucket, and of the rows with one value if there are several. The
    driver gets one row of each, and rows are neither numbered nor joined. Nulls go first.
    """
    at, row = order

    def reach(counts: DataFrame, key: str, wanted: Column) -> DataFrame:
        """The key in which place ``wanted`` (from 0) lies, and the rows before it."""
        run = counts.withColumns({"_upto": F.sum("_n").over(Window.orderBy(F.col(key).asc_nulls_first())), "_all": F.sum("_n").over(Window.partitionBy())})
        return run.withColumn("_want", wanted).filter((F.col("_upto") > F.col("_want")) & (F.col("_upto") - F.col("_n") <= F.col("_want"))).select(key, "_want", "_n", (F.col("_upto") - F.col("_n")).alias("_before"))

    keyed = df.select(F.col(at).alias("_t"), F.col(row).alias("_r"), bucket.alias("_b"))
    found = reach(keyed.groupBy("_b").agg(F.count("*").alias("_n")), "_b", F.floor(F.col("_all") * share)).first()
    if found is None:  # share 1, or no rows
        return F.lit(True)
    inside = keyed.filter(F.col("_b").eqNullSafe(F.lit(found["_b"])))
    second = reach(inside.groupBy("_t").agg(F.count("*").alias("_n")), "_t", F.lit(found["_want"] - found["_before"])).first()

    def before(c: str, value) -> Column:
        return F.lit(False) if value is None else F.col(c).isNull() | (F.col(c) < value)

    if second["_n"] == 1:  # the rest begins with the one row of this value
        return F.coalesce(before(at, second["_t"]), F.lit(False))
    same = inside.filter(F.col("_t").eqNullSafe(F.lit(second["_t"])))
    edge = reach(same.groupBy("_r").agg(F.count("*").alias("_n")), "_r", F.lit(second["_want"] - second["_before"])).first()

    return F.coalesce(before(at, second["_t"]) | (F.col(at).eqNullSafe(F.lit(second["_t"])) & before(row, edge["_r"])), F.lit(False))


#: Sampled values for each range, and how many ranges the first of two looks leaves.
_SAMPLED, _LOOK = 16, 32


def ranged(points: DataFrame, value: str, keys: tuple[str, ...] = (), ranges: int = 1024, bucket: str = "_b") -> DataFrame:
    """``bucket``: the range, from 0, of a value that is not null; of each of ``keys`` about equally many rows are in one.

    ``points`` has each value once. Some 16 for each range are sampled by a hash of the
    value, sorted, and every 16th splits two ranges, so that a few values far from the rest
    do not leave all others in one range. The sample is the same whenever it is drawn. The
    splitters are broadcast: ``ranges`` values for each of ``keys``, which are features or the like.
    """
    rows = points.withColumn("_all", F.lit(0)) if not keys else points
    by = keys or ("_all",)
    size = rows.groupBy(*by).agg(F.count(value).alias("_size"))
    drawn = rows.join(F.broadcast(size), [*by]).filter(F.pmod(F.xxhash64(value), F.col("_size")) < ranges * _SAMPLED)
    sample = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_s"))
    spots = F.sequence(F.lit(1), F.lit(max(1, ranges - 1)))
    cuts = sample.select(*by, F.array_distinct(F.transform(spots, lambda k: F.get("_s", F.floor(k * F.size("_s") / ranges).cast("int")))).alias("_cuts"))
    cuts = cuts.withColumn("_first", F.filter("_cuts", lambda _, k: k % _LOOK == 0))
    # the range is the number of splitters up to the value, found in two looks
    block = F.size(F.filter("_first", lambda x: x <= F.col(value)))
    inside = F.size(F.filter(F.slice("_cuts", (block - 1) * _LOOK + 1, F.lit(_LOOK)), lambda x: x <= F.col(value)))
    at = F.when(block == 0, 0).otherwise((block - 1) * _LOOK + inside)
    return rows.join(F.broadcast(cuts), [*by]).withColumn(bucket, at).drop("_cuts", "_first", "_all")


def grouped_quantiles(long: DataFrame, shares: list[float], keys: tuple[str, ...] = ("feature",), value: str = "value", ranges: int = 256) -> DataFrame:
    """``keys`` and the array ``q`` of quantiles (linear between neighbours) of the values that are not null, of all groups at once.

    Equal values are counted first; running counts go within sampled ranges of values and
    are shifted by those of the ranges before, so no task gets all different values of a
    group. The table is read once for any number of groups; one without values has no row.
    """
    points = long.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    split = ranged(points, "v", keys, ranges)
    sums = split.groupBy(*keys, "_b").agg(F.sum("m").alias("_n"))
    whole = Window.partitionBy(*keys)
    shift = sums.select(*keys, "_b", (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_of"))
    run = split.withColumn("_in", F.sum("m").over(Window.partitionBy(*keys, "_b").orderBy("v"))).join(shift, [*keys, "_b"]).withColumn("_upto", F.col("_before") + F.col("_in"))
    spot = lambda p, how: how((F.col("_of") - 1) * p)
    place = lambda p, how: F.max(F.when((spot(p, how) < F.col("_upto")) & (spot(p, how) >= F.col("_upto") - F.col("m")), F.col("v")))
    row = run.groupBy(*keys).agg(F.max("_of").alias("n"), *[place(p, how).alias(f"{name}{k}") for k, p in enumerate(shares) for name, how in (("a", F.floor), ("b", F.ceil))])
    part = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    return row.select(*keys, F.array(*[F.col(f"a{k}") + part(p) * (F.col(f"b{k}") - F.col(f"a{k}")) for k, p in enumerate(shares)]).alias("q"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], ranges: int = 1024) -> DataFrame:
    """One row with the array ``q`` of ``grouped_quantiles`` over all rows; nulls in it if there is no value."""
    one = grouped_quantiles(df.select(F.lit(0).alias("_one"), F.col(value).cast("double").alias("_value")), shares, ("_one",), "_value", ranges)
    return one.agg(F.coalesce(F.first("q"), F.array(*[F.lit(None).cast("double")] * len(shares))).alias("q"))
