"""Boosted trees by sums over bins: records as blocks of bytes, one pass over all of them for each level of a tree.

The learner is MLlib's (logistic loss, variance as impurity, 32 bins, stopping on held records)
and what it gives is MLlib's model. A record is one byte for each feature, and a task adds up
its blocks with numpy, so a pass costs a fraction of one over a record's objects. Records
of the same bytes may be one cell with their number (``auc_by_cells``).
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskengine.session import shared_path

BINS = 32
_BLOCK = 1 << 15
#: Records that thresholds are chosen by (MLlib takes 10,000); trees learn from all.
_SAMPLE = 20000


@dataclass
class Grown:
    """A tree's nodes in order of levels; the right child is behind the left one, and a leaf has no feature (-1)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    sums: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    count: np.ndarray | None = None
    depth: int = 0

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each record is in so far."""
        feature, upto, left = np.array(self.feature), np.array(self.upto), np.array(self.left)
        at, rows = np.zeros(bins.shape[1], np.intp), np.arange(bins.shape[1])
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, left[at] + (bins[f, rows] > upto[at]), at)
        return at


@dataclass
class Block:
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    margin: np.ndarray
    key: int
    n: np.ndarray | None = None  # how many records each cell is; None: one

    def taken(self, share: float, seed: int) -> np.ndarray:
        """How many records a round learns from: each with chance ``share``, so of a cell's n a binomial number."""
        if self.n is not None:
            return np.where(self.held, 0, self.n if share >= 1 else np.random.default_rng([seed, self.key]).binomial(self.n, share))
        return ~self.held if share >= 1 else ~self.held & (np.random.default_rng([seed, self.key]).random(len(self.y)) < share)


def thresholds(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The middles between values; of more than 32 different ones those that part them into 32 bins of like weight."""
    known = np.isfinite(values)
    at, which = np.unique(values[known], return_inverse=True)
    if len(at) < 2:
        return np.zeros(0)
    cut = np.arange(len(at) - 1)
    if len(at) > BINS:
        mass = np.cumsum(np.bincount(which, weights[known]))
        cut = np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, BINS) / BINS))
        cut = cut[cut < len(at) - 1]
    return (at[cut] + at[cut + 1]) / 2


def _blocks(rows: DataFrame, cuts: list[np.ndarray], parts: int) -> RDD:
    """Records as bytes: the number of thresholds below each value."""
    n = len(cuts)

    def encode(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [c.to_numpy() for c in pa.Table.from_batches(kept).columns]
        bins = np.stack([np.searchsorted(t, x, "left").astype(np.uint8) for t, x in zip(cuts, columns[:n], strict=True)])
        y, w, held = columns[n] * 2.0 - 1.0, columns[n + 1], columns[n + 2].astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y, w, held)], ["bins", "y", "w", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            if b.num_rows:
                kept.append(b)
                size += b.num_rows
            if size >= _BLOCK:
                yield encode(kept)
                kept, size = [], 0
        if kept:
            yield encode(kept)

    def decode(r) -> Block:
        y = np.frombuffer(bytes(r.y))
        return Block(np.frombuffer(bytes(r.bins), np.uint8).reshape(n, len(y)), y, np.frombuffer(bytes(r.w)), np.frombuffer(bytes(r.held), bool), np.zeros(len(y)), zlib.crc32(r.bins))

    return rows.mapInArrow(run, "bins binary, y binary, w binary, held binary").repartition(parts).rdd.map(decode)


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def _sums(blocks: Iterable[Block], tree: Grown, active: list[int], first: bool, counted: bool, share: float, seed: int, before: tuple[Grown, int] | None, features: int) -> list:
    """Sums over blocks: of the ``active`` nodes (weight, target, its square), of their bins, the tree ``before``'s counts and the held records' loss."""
    k = len(active)
    slots = np.full(len(tree.feature), -1)
    slots[active] = np.arange(k)
    nodes, sums = np.zeros((3, k)), np.zeros((3 if counted else 2, features, k * BINS))
    counts, loss = np.zeros(len(before[0].feature) if before else 0), np.zeros(2)
    for b in blocks:
        if before:
            counts += np.bincount(before[0].places(b.bins), b.taken(share, before[1]), len(counts))
            h = b.held
            loss += (b.w[h] * 2 * np.logaddexp(0, -2 * b.y[h] * b.margin[h])).sum(), b.w[h].sum()
        if not k:
            continue
        slot, taken = slots[tree.places(b.bins)], b.taken(share, seed)
        at = np.flatnonzero((taken > 0) & (slot >= 0))
        every = len(at) == len(slot)
        y, w, slot, bins = (b.y, b.w, slot, b.bins) if every else (b.y[at], b.w[at], slot[at], b.bins[:, at])
        n = None if b.n is None else taken[at]
        target = y if first else 4 * y / (1 + np.exp(2 * y * (b.margin if every else b.margin[at])))
        w = w if n is None else w * n
        wt = w * target
        nodes += [np.bincount(slot, x, k) for x in (w, wt, wt * target)]
        base = slot * BINS
        for f in range(features):
            where = base + bins[f]
            sums[0, f] += np.bincount(where, w, k * BINS)
            sums[1, f] += np.bincount(where, wt, k * BINS)
            if counted:
                sums[2, f] += np.bincount(where, n, k * BINS)
    return [nodes, sums, counts, loss]


def _pass(state: RDD, active: int, features: int, *what) -> list:
    """``_sums`` over all records."""
    found = state.mapPartitions(lambda blocks: [_sums(blocks, *what, features)])
    if features * active * BINS * 16 > 1 << 21:  # large sums are added up by tasks first
        return found.treeReduce(_added)
    return [sum(x) for x in zip(*found.collect(), strict=True)]


def _split(tree: Grown, active: list[int], nodes: np.ndarray, sums: np.ndarray, last: bool, least_rows: int, least_gain: float, allowed: np.ndarray) -> list[int]:
    """Splits the active nodes where that gains most; the new nodes to go on with."""
    k = len(active)
    sums = sums.reshape(*sums.shape[:2], k, BINS)
    low, high = np.cumsum(sums, axis=-1)[..., :-1], np.cumsum(sums[..., ::-1], axis=-1)[..., ::-1][..., 1:]
    w, s, squares = nodes
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (low[1] ** 2 / low[0] + high[1] ** 2 / high[0] - (s**2 / w)[:, None]) / w[:, None]
    fits = (low[0] > 0) & (high[0] > 0) & allowed[:, :, None]
    if len(sums) > 2:
        fits &= (low[2] >= least_rows) & (high[2] >= least_rows)
    gain = np.where(fits, gain, -np.inf).transpose(1, 0, 2).reshape(k, -1)
    best = gain.argmax(axis=1)
    most = gain[np.arange(k), best]
    for node, x in zip(active, zip(w.tolist(), s.tolist(), squares.tolist(), strict=True), strict=True):
        tree.sums[node] = x
    if active[0] == 0:
        tree.value[0] = float(s[0] / w[0])
    j = np.flatnonzero((most > 1e-14) & (most >= least_gain))
    f, at = np.divmod(best[j], BINS - 1)
    start = len(tree.feature)
    out = list(range(start, start + 2 * len(j)))
    for node, *split in zip(j.tolist(), f.tolist(), at.tolist(), out[::2], most[j].tolist(), strict=True):
        node = active[node]
        tree.feature[node], tree.upto[node], tree.left[node], tree.gain[node] = split
    pw, ps = (np.stack([part[x, f, j, at] for part in (low, high)], axis=1).ravel() for x in (0, 1))
    for column, leaf in ((tree.feature, -1), (tree.upto, 0), (tree.left, -1), (tree.gain, -1.0)):
        column.extend([leaf] * len(out))
    tree.value.extend((ps / pw).tolist())
    tree.sums.extend(zip(pw.tolist(), ps.tolist(), (ps * ps / pw).tolist(), strict=True))
    tree.depth += bool(out)
    return [] if last else out


def _boost(p: dict, features: int, measure: Callable[[Grown, list[int], int, tuple[Grown, int] | None], list], further: Callable[[Grown, np.ndarray], None], checked: bool, least: Callable[[], None] = lambda: None) -> int:
    """Grow trees as MLlib's settings ``p`` say; the number of them to keep.

    ``measure`` gives the ``_sums`` of a tree's nodes in a round and of the tree before,
    ``further`` takes a finished tree and its values, and ``least`` is told that the sums of
    the tree before are there. Unless ``checked``, the last tree's counts are not asked for.
    """
    rounds, depth, step, seed = p["maxIter"], p["maxDepth"], p["stepSize"], p["seed"]
    validated, strategy = "validationIndicatorCol" in p, p["featureSubsetStrategy"]
    chosen = features if strategy == "all" else max(1, int(np.ceil(float(strategy) * features)))
    draw = np.random.default_rng(seed)
    best, kept, before, grown = np.inf, 0, None, 0
    for m in range(rounds + checked):
        tree, active = Grown(), [0] if m < rounds else []
        for level in range(max(1, depth)):
            nodes, sums, counts, loss = measure(tree, active, m, before if level == 0 and checked else None)
            if level == 0 and before and checked:
                before[0].count = counts
                least()
                if validated and loss[1]:
                    now = loss[0] / loss[1]
                    if kept and best - now < p["validationTol"] * max(now, 0.01):
                        active = []
                        break
                    best, kept = min(best, now), grown if now < best else kept
            if not active:
                break
            allowed = np.ones((features, len(active)), bool)
            if chosen < features:
                allowed = np.argsort(np.argsort(draw.random(allowed.shape), axis=0), axis=0) < chosen
            active = _split(tree, active, nodes, sums, level + 1 == depth, p["minInstancesPerNode"], p["minInfoGain"], allowed)
            if not active:
                break
        if m == rounds or (validated and kept and before and kept < grown):
            break
        grown, before = grown + 1, (tree, seed + m)
        further(tree, np.array(tree.value) * (1.0 if m == 0 else step))
    return kept or grown


def sampled_thresholds(learned: DataFrame, features: list[str], n: int, seed: int) -> list[np.ndarray]:
    """Each feature's thresholds by about ``_SAMPLE`` of the ``n`` records to learn from."""
    some = (learned.sample(min(1.0, 1.2 * _SAMPLE / n), seed=seed) if n > 1.2 * _SAMPLE else learned).select(*features, "_w").toPandas().to_numpy(float)
    return [thresholds(some[:, k], some[:, -1]) for k in range(len(features))]


def fit_boosted(rows: DataFrame, features: list[str], gbt: GBTClassifier) -> GBTClassificationModel:
    """What ``gbt`` learns from ``rows``: ``features``, ``label`` (0 or 1), ``_w`` and ``_held``, all doubles but the last, without nulls."""
    spark, p = rows.sparkSession, {x.name: v for x, v in gbt.extractParamMap().items()}
    share, counted = p["subsamplingRate"], p["minInstancesPerNode"] > 1
    learned = rows.filter(~F.col("_held"))
    n = learned.count()
    if not n:
        raise ValueError("no records to learn from")
    cuts = sampled_thresholds(learned, features, n, p["seed"])
    parts = max(spark.sparkContext.defaultParallelism, int(n * (len(features) + 25) / 2**28))
    held: list[RDD] = [_blocks(rows.select(*features, "label", "_w", "_held"), cuts, parts).persist(StorageLevel.MEMORY_AND_DISK)]
    trees: list[Grown] = []

    def measure(tree: Grown, active: list[int], m: int, before: tuple[Grown, int] | None) -> list:
        return _pass(held[-1], len(active), len(features), tree, active, m == 0, counted, share, p["seed"] + m, before)

    def further(tree: Grown, value: np.ndarray) -> None:
        trees.append(tree)
        held.append(held[-1].map(lambda b: Block(b.bins, b.y, b.w, b.held, b.margin + value[tree.places(b.bins)], b.key)).persist(StorageLevel.MEMORY_AND_DISK))

    def least() -> None:
        while len(held) > 1:
            held.pop(0).unpersist()

    kept = _boost(p, len(features), measure, further, True, least)
    for state in held:
        state.unpersist()
    return _model(rows, trees[:kept], cuts, gbt, p)


#: Cells of a table that are learned from and scored in place of its records; more are not gathered.
MOST_CELLS = 1 << 16


def cells(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> Block | None:
    """Records (as for ``fit_boosted``) of the same bytes, label, weight and ``_held`` as one cell each; None if there may be over ``MOST_CELLS`` cells of features.

    One aggregation over all records; the driver gets the cells, which are as many however large the table is.
    """
    if np.prod([len(t) + 1.0 for t in cuts]) > MOST_CELLS:
        return None

    def below(c: str, t: np.ndarray) -> Column:
        return F.size(F.filter(F.lit(t.tolist()).cast("array<double>"), lambda x: x < F.col(c))).cast("int")

    kinds = rows.select(*[below(c, t).alias(f"_b{k}") for k, (c, t) in enumerate(zip(features, cuts, strict=True))], "label", "_w", "_held").groupBy(*[f"_b{k}" for k in range(len(features))], "label", "_w", "_held")
    found = kinds.agg(F.count(F.lit(1)).alias("n")).toPandas()
    found = found.sort_values(list(found.columns)).to_numpy(float)
    bins = np.ascontiguousarray(found[:, : len(features)].T.astype(np.uint8))
    y, w, held, n = found[:, len(features) :].T
    return Block(bins, y * 2 - 1, w, held > 0, np.zeros(len(y)), zlib.crc32(bins), n.astype(np.int64))


def auc_by_cells(block: Block, p: dict) -> float:
    """The ROC AUC, over the held records, of the trees that MLlib's settings ``p`` learn from the others; 0.5 without both classes among them."""
    b = replace(block, margin=np.zeros(len(block.y)))
    features, counted = len(b.bins), p["minInstancesPerNode"] > 1

    def further(tree: Grown, value: np.ndarray) -> None:
        b.margin += value[tree.places(b.bins)]

    if not b.held.all():
        _boost(p, features, lambda tree, active, m, before: _sums([b], tree, active, m == 0, counted, p["subsamplingRate"], p["seed"] + m, before, features), further, False)
    _, place = np.unique(b.margin[b.held], return_inverse=True)
    good, bad = (np.bincount(place, np.where(b.y[b.held] > 0, k, 1 - k) * b.n[b.held]) for k in (0, 1))
    if not good.sum() or not bad.sum():
        return 0.5
    return float((bad * (np.cumsum(good) - good / 2)).sum() / good.sum() / bad.sum())


def _model(rows: DataFrame, trees: list[Grown], cuts: list[np.ndarray], gbt: GBTClassifier, params: dict) -> GBTClassificationModel:
    """The trees as MLlib saves and loads them."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "boosted")
    said = lambda kind, uid, params: {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": {}}
    whole = said("classification.GBTClassificationModel", gbt.uid, params) | {"numFeatures": len(cuts), "numTrees": len(trees)}
    weights = [(k, json.dumps(said("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {"maxDepth": params["maxDepth"]})), 1.0 if k == 0 else params["stepSize"]) for k in range(len(trees))]
    nodes = []
    for k, t in enumerate(trees):
        count = t.count.copy()
        for j in reversed(range(len(t.feature))):
            if t.feature[j] >= 0:
                count[j] = count[t.left[j]] + count[t.left[j] + 1]
        for j, f in enumerate(t.feature):
            w, s, squares = t.sums[j]
            split = (f, [float(cuts[f][t.upto[j]])], -1) if f >= 0 else (-1, [], -1)
            nodes.append((k, (j, t.value[j], max(0.0, (squares - s * s / w) / w), [w, s, squares], int(count[j]), t.gain[j], t.left[j], t.left[j] + 1 if f >= 0 else -1, split)))
    kind = "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, kind).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
