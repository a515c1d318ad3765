"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are broadcast; there are fewer of them than this.
PARTS = 1000


def frequent_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of more than one row in ``PARTS``, fewer than ``PARTS`` by their share; None where there is none."""
    least = rows.count() / PARTS
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(1.0, least)).select(key).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema) if found else None


def join_by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to ``table``, which has one row for each ``key``.

    Rows of frequent keys meet theirs in a broadcast of fewer than ``PARTS`` rows and are
    not shuffled; of the others no key has more than one row in ``PARTS``. Both inputs are
    read twice, so they should be tables. Null keys match nothing.
    """
    hot = frequent_keys(rows, key)
    if hot is None:
        return rows.join(table, key, how)
    few = table.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))
