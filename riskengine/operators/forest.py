"""Random forests by sums over cells: records that fall into the same bins are one cell, with its count of each class.

The learner is MLlib's (Gini impurity, 32 bins, roots of features for each split, equal
predictions merged), but a bag of Poisson(1) of each record is Poisson(n) of a cell's n
records, so a pass costs the cells and not the records. Every record is in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskengine.operators.boosting import _SAMPLE, BINS, Grown, _added, _split, thresholds
from riskengine.session import materialize

#: Cells of a block, which one draw of bags is for.
_BLOCK = 1 << 13


@dataclass
class Cells:
    """A block: a byte for each feature of a cell, and the counts of its records without and with the label."""

    bins: np.ndarray
    n: np.ndarray
    key: int

    def bag(self, seed: int, tree: int, bootstrap: bool) -> np.ndarray:
        """How often a tree sees the records; the same whenever it is drawn."""
        return np.random.default_rng([seed, tree, self.key]).poisson(self.n) if bootstrap else self.n


@dataclass
class Forest:
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Grown]

    def importances(self) -> np.ndarray:
        """Each feature's gains by the records that its splits part, of every tree alike."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            own = np.zeros(len(total))
            for f, gain, (w, _, _) in zip(t.feature, t.gain, t.sums, strict=True):
                if f >= 0:
                    own[f] += gain * w
            total += own / own.sum() if own.sum() > 0 else own
        return total / total.sum() if total.sum() > 0 else total

    def probability(self, bins: np.ndarray) -> np.ndarray:
        """The mean of the trees' shares of the label; 0.5 where no tree saw a record."""
        p = np.zeros(bins.shape[1])
        for t in self.trees:
            p += np.array(t.value)[t.places(bins)]
        return p / len(self.trees) if self.trees else p + 0.5


def to_cells(rows: DataFrame, features: list[str], label: Column, cuts: list[np.ndarray]) -> DataFrame:
    """``bins``, a byte for each feature (the number of thresholds below a value), and the counts ``n0`` and ``n1`` of such records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.zeros((b.num_rows, len(cuts)), np.uint8)
            for k, t in enumerate(cuts):
                bins[:, k] = np.searchsorted(t, b.column(k).to_numpy(zero_copy_only=False), "left")
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(len(cuts))
            coded = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([coded, b.column(len(cuts))], ["bins", "y"])

    coded = rows.select(*features, label.alias("y")).mapInArrow(run, "bins binary, y boolean")
    return coded.groupBy("bins").agg(F.count_if(~F.col("y")).alias("n0"), F.count_if("y").alias("n1"))


def _bytes(column: pa.Array, features: int) -> np.ndarray:
    """A row of bytes for each feature."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features).T)


def _blocks(cells: DataFrame, features: int) -> RDD:
    """The cells in blocks by a hash of their bins, so bags do not change with the partitions."""
    n, spark = cells.count(), cells.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, n * (features + 16) // 2**26)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("bins").combine_chunks()
        of = [b"".join(t.column("bins").to_pylist()), *[t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("n0", "n1")]]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in of]], ["key", "bins", "n0", "n1"])

    def unpack(r) -> tuple[int, Cells]:
        bins = np.frombuffer(bytes(r.bins), np.uint8).reshape(-1, features)
        return r.key, Cells(np.ascontiguousarray(bins.T), np.stack([np.frombuffer(bytes(x), np.int64) for x in (r.n0, r.n1)]), r.key)

    keyed = cells.withColumn("key", F.pmod(F.xxhash64("bins"), F.lit(-(-n // _BLOCK) or 1).cast("long")))
    return keyed.groupBy("key").applyInArrow(pack, "key long, bins binary, n0 binary, n1 binary").rdd.map(unpack).partitionBy(parts).values()


def _level(state: RDD, trees: list[Grown], active: list[list[int]], level: int, last: bool, chosen: int, features: int, bootstrap: bool, seed: int) -> list[tuple[int, Grown, list[int]]]:
    """Splits the active nodes of all trees by one pass over the cells; tasks add up and split, the driver gets the trees."""

    def subset(t: int) -> np.ndarray:
        """The features that each node may be split by."""
        if chosen == features:
            return np.repeat(np.arange(features)[:, None], len(active[t]), axis=1)
        return np.argsort(np.random.default_rng([seed, t, level]).random((features, len(active[t]))), axis=0)[:chosen]

    def run(blocks: Iterator[Cells]) -> Iterator[tuple[int, list]]:
        held = list(blocks)
        for t, tree in enumerate(trees):
            k = len(active[t])
            if not k or not held:
                continue
            slots, among = np.full(len(tree.feature), -1), subset(t)
            slots[active[t]] = np.arange(k)
            nodes, sums = np.zeros((2, k)), np.zeros((2, chosen, k * BINS))
            for b in held:
                n = b.bag(seed, t, bootstrap)
                slot = slots[tree.places(b.bins)]
                at = np.flatnonzero((slot >= 0) & (n.sum(axis=0) > 0))
                slot, n = slot[at], n[:, at].astype(float)
                w = n[0] + n[1]
                nodes += [np.bincount(slot, x, k) for x in (w, n[1])]
                for j in range(chosen):
                    where = slot * BINS + b.bins[among[j][slot], at]
                    sums[0, j] += np.bincount(where, w, k * BINS)
                    sums[1, j] += np.bincount(where, n[1], k * BINS)
            yield t, [nodes, sums]

    def split(found: tuple[int, list]) -> tuple[int, Grown, list[int]]:
        t, (nodes, sums) = found
        tree, own, among = trees[t], active[t], subset(t)
        if not nodes[0].all():  # the bag is empty
            return t, tree, []
        # for a label of 0 or 1 the variance is half the Gini impurity, so splits are the same
        after = _split(tree, own, np.stack([nodes[0], nodes[1], nodes[1]]), sums, last, 1, 0.0, np.ones((chosen, len(own)), bool))
        for slot, node in enumerate(own):
            if tree.feature[node] >= 0:
                tree.feature[node] = int(among[tree.feature[node], slot])
        return t, tree, after

    return state.mapPartitions(run).reduceByKey(_added, min(len(trees), state.getNumPartitions())).map(split).collect()


def _merged(tree: Grown) -> Grown:
    """Splits into two leaves of one prediction are leaves, as in MLlib's classifiers."""
    for j in reversed(range(len(tree.feature))):
        a = tree.left[j]
        if tree.feature[j] >= 0 and tree.feature[a] < 0 and tree.feature[a + 1] < 0 and (tree.value[a] > 0.5) == (tree.value[a + 1] > 0.5):
            tree.feature[j], tree.left[j], tree.gain[j] = -1, -1, -1.0
    return tree


def fit_forest(rows: DataFrame, features: list[str], label: Column, trees: int = 100, depth: int = 6, bootstrap: bool = True, chosen: int | None = None, seed: int = 42) -> tuple[Forest, DataFrame]:
    """A forest of all records, whose ``features`` are doubles without nulls, and its cells (``to_cells``).

    ``chosen`` features, their number's root if not told, may split a node. Thresholds are
    chosen by some 20,000 records (MLlib: 10,000); trees learn from all.
    """
    n = rows.count()
    some = (rows.sample(fraction=min(1.0, 1.2 * _SAMPLE / n), seed=seed) if n > 1.2 * _SAMPLE else rows).select(*features).toPandas().to_numpy(float)
    cuts = [thresholds(some[:, k], np.ones(len(some))) for k in range(len(features))]
    cells = materialize(to_cells(rows, features, label, cuts), "cells")
    state = _blocks(cells, len(features)).persist(StorageLevel.MEMORY_AND_DISK)
    if chosen is None:
        chosen = len(features) if trees == 1 else int(np.ceil(np.sqrt(len(features))))
    grown, active = [Grown() for _ in range(trees)], [[0]] * trees
    for level in range(depth):
        found = _level(state, grown, active, level, level + 1 == depth, chosen, len(features), bootstrap, seed)
        active = [[] for _ in range(trees)]
        for t, tree, after in found:
            grown[t], active[t] = tree, after
        if not any(active):
            break
    state.unpersist()
    return Forest(features, cuts, [_merged(t) for t in grown if t.sums[0][0] > 0]), cells


def score_cells(cells: DataFrame, forest: Forest) -> DataFrame:
    """Each score ``p`` with its records: ``pos`` with the label, ``neg`` without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = forest.probability(_bytes(b.column(0), len(forest.features)))
            yield pa.RecordBatch.from_arrays([pa.array(p), b.column(1), b.column(2)], ["p", "pos", "neg"])

    scored = cells.select("bins", "n1", "n0").mapInArrow(run, "p double, pos long, neg long")
    return scored.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
