"""Bounded training samples in which copies count once and no frequent label is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def fair_part(sizes: list[int], most: int, least: int = 16) -> float:
    """What each label may have so that all have ``most`` together; what small labels leave goes to the others."""
    left = most
    for k, n in enumerate(sorted(sizes)):
        part = left / (len(sizes) - k)
        if n >= part:
            return max(part, least)
        left -= n
    return float(max(most, least))


def draw_by_label(rows: DataFrame, label: str, hash_col: str, most: int, most_labels: int | None = None) -> DataFrame:
    """The rows whose hash chooses them: about ``most`` distinct hashes, up to a fair part of each label.

    A label with fewer distinct hashes than its part keeps all rows; any label has a part of
    16 at least. There are ``most_labels`` at most, by default as many as have 16 in ``most``
    (but 16): those of most distinct hashes, of equal ones the first; rows of the others are not drawn.
    """
    most_labels = most_labels or max(16, most // 16)
    # about 2 % off; one small sketch for each task and label is shuffled
    found = rows.groupBy(label).agg(F.approx_count_distinct(hash_col, 0.02).alias("_n")).orderBy(F.col("_n").desc(), label).limit(most_labels)
    sizes = {r[0]: max(1, r[1]) for r in found.collect()}
    part = fair_part(list(sizes.values()), most)
    cuts = [(k, max(1, int(min(1.0, part / n) * _RANGE))) for k, n in sizes.items()]
    cut = rows.sparkSession.createDataFrame(cuts, rows.select(label).schema.add("_cut", "long"))
    return rows.join(F.broadcast(cut), label).filter(F.pmod(hash_col, F.lit(_RANGE)) < F.col("_cut")).select(*rows.columns)


def keep_bytes(rows: DataFrame, label: str, hash_col: str, of: str, most: int) -> DataFrame:
    """The rows whose hash chooses them: about ``most`` bytes of column ``of``, up to a fair part of each label.

    A label with no more bytes than its part keeps all its rows. ``rows`` is read twice.
    """
    sizes = {r[0]: r[1] or 0 for r in rows.groupBy(label).agg(F.sum(F.octet_length(of))).collect()}
    part = fair_part(list(sizes.values()), most, 0)
    cuts = [(k, int(min(1.0, part / max(1, n)) * _RANGE)) for k, n in sizes.items()]
    if all(c == _RANGE for _, c in cuts):
        return rows
    cut = rows.sparkSession.createDataFrame(cuts, rows.select(label).schema.add("_cut", "long"))
    chosen = F.pmod(F.xxhash64(hash_col, F.lit("bytes")), F.lit(_RANGE)) < F.col("_cut")
    return rows.join(F.broadcast(cut), label).filter(chosen).select(*rows.columns)
