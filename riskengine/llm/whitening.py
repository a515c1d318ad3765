"""Whitening of embeddings by an exact covariance, from products of digit slices.

Entries become integers (256 times the value, rounded down). Centred by integers too,
y = n*x - S, they are split into limbs of 20 bits; the product of two limb matrices of
8,192 rows stays below 2^53, so float64 BLAS gives it exactly. A task recombines the
products to big integers, which are merged in Spark as digits, and the driver gets one
number for each pair of dimensions. The covariance is thus exact up to the one rounding
before its eigendecomposition, whatever the order or number of tasks.

Defined results: vectors that are null, empty, or hold null or non-finite entries give no
row; nor do vectors of another length than most of the distinct vectors have (of equally
common lengths the longer counts); values beyond a long's range after scaling are cut to
it; equal vectors count once in the fit, and every remaining row is transformed, repeated
rows each; components without variance have no ``whitened`` value; a deviation too large
for a long is null; an empty table gives an empty one. The driver holds the square of the
number of dimensions, and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.session import materialize

SCALE = 256
#: Bits of a limb and rows of a block: LIMB + LIMB + log2(ROWS) is 53.
LIMB, ROWS = 20, 1 << 13
#: Bits of the digits in which big integers are merged.
DIGIT = 40
_SUMS = "pos int, digit int, value long"
_LONG = 1 << 63


def scaled(vector: str | Column, scale: int = SCALE) -> Column:
    """The entries as integers; null where the vector cannot be used."""
    c = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole & (F.size(c) > 0), F.transform(c, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list array of equally long lists as a matrix of int64."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums; int64 where that surely fits, Python integers otherwise."""
    most = max((int(x.max()), -int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of float64, the sum of which times 2^20, 2^40 and so on is ``y``; the last has the sign."""
    out, low = [], (1 << LIMB) - 1
    while True:
        if not y.size or max(abs(int(y.max())), abs(int(y.min()))) <= low:
            return [*out, y.astype(np.float64)]
        out.append((y & low).astype(np.float64))
        y = y >> LIMB


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y as a matrix of Python integers."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    for at in range(0, len(y), ROWS):
        part = limbs(y[at : at + ROWS])
        for j, a in enumerate(part):
            for k in range(j, len(part)):
                product = (a.T @ part[k]).astype(np.int64).astype(object) << (LIMB * (j + k))
                out += product if j == k else product + product.T
    return out


def _digits(pos: np.ndarray, values: list[int]) -> pa.RecordBatch:
    """Signed integers as rows of (place, digit number, digit); zero digits are left out."""
    rows = []
    for p, v in zip(pos.tolist(), values, strict=True):
        k, sign, v = 0, -1 if v < 0 else 1, abs(v)
        while v:
            if v & ((1 << DIGIT) - 1):
                rows.append((p, k, sign * (v & ((1 << DIGIT) - 1))))
            v >>= DIGIT
            k += 1
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["pos", "digit", "value"])


def _merged(parts: DataFrame) -> dict[int, int]:
    """The sum of all tasks' integers at each place."""
    total: dict[int, int] = {}
    for r in parts.groupBy("pos", "digit").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        total[r.pos] = total.get(r.pos, 0) + (int(r.value) << (DIGIT * r.digit))
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place -1 has the number of rows, place k the sum of dimension k."""
    n, total = 0, None
    for b in batches:
        x = matrix(b.column(0)) if b.num_rows else np.zeros((0, 0), np.int64)
        n += len(x)
        if len(x):
            # halves of 32 bits: sums of a batch stay within a long
            own = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            total = own if total is None else total + own
    if n:
        yield _digits(np.arange(-1, len(total)), [n, *[int(v) for v in total]])


@dataclass
class Whitening:
    """A fitted model: ``axes`` has a unit eigenvector in each column, by falling ``eigenvalue``."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalue: np.ndarray
    axes: np.ndarray
    identity_error: float | None = None

    @property
    def variance(self) -> float:
        return float(np.trace(self.covariance))

    def has_variance(self, k: int) -> bool:
        """Whether an eigenvalue is more than what rounding leaves of none."""
        return bool(self.eigenvalue[k] > len(self.sums) * np.finfo(float).eps * max(self.eigenvalue[0], 0.0))

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` components of the rows, with unit variance; NaN for those without any."""
        most = min(most, len(self.sums))
        root = np.array([np.sqrt(self.eigenvalue[k]) if self.has_variance(k) else np.nan for k in range(most)])
        return (centred(x, self.n, self.sums).astype(np.float64) / self.n) @ self.axes[:, :most] / root


def distinct_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``x``: each distinct vector of integers once, of the most common length."""
    x = df.select(scaled(vector, scale).alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.lit(1).alias("_one")).select("x")
    x = materialize(x, "vectors")
    usual = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return x.filter(F.size("x") == (usual.d if usual else 0))


def fit(df: DataFrame, vector: str = "embedding", scale: int = SCALE, checked: int = 4) -> Whitening | None:
    """The model of a table's distinct vectors; None where there is none. ``identity_error`` is over ``checked`` components."""
    x = distinct_vectors(df, vector, scale)
    total = _merged(x.mapInArrow(_sums, _SUMS))
    if not total:
        return None
    n, d = total[-1], x.first().x.__len__()
    sums = [total.get(k, 0) for k in range(d)]
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d), object)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                gram += exact_gram(centred(matrix(b.column(0).slice(at, ROWS)), n, sums))
        yield _digits(upper[0] * d + upper[1], [int(v) for v in gram[upper]])

    gram = _merged(x.mapInArrow(products, _SUMS))
    # the quotient of two integers is rounded once
    v = np.zeros((d, d))
    for i, j in zip(*(u.tolist() for u in upper), strict=True):
        v[i, j] = v[j, i] = gram.get(i * d + j, 0) / n**3
    value, axes = np.linalg.eigh(v)
    model = Whitening(n, sums, v, value[::-1].copy(), axes[:, ::-1].copy())
    model.identity_error = identity_error(x, model, checked)
    return model


def identity_error(x: DataFrame, model: Whitening, most: int) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity; None without a component of variance."""
    some = [k for k in range(min(most, len(model.sums))) if model.has_variance(k)]
    if not some:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch: its sums, the products around its own means, and those of the means."""
        for b in batches:
            if b.num_rows:
                w = model.whiten(matrix(b.column(0)), most)[:, some]
                mean = w.mean(axis=0)
                own = w - mean
                values = np.concatenate([w.sum(axis=0), (own.T @ own + len(w) * np.outer(mean, mean)).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["pos", "value"])

    got = x.mapInArrow(moments, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(len(some) * (len(some) + 1))
    for r in got:
        values[r.pos] = r.value / model.n
    mean, second = values[: len(some)], values[len(some) :].reshape(len(some), -1)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(some))).max())


def transform(df: DataFrame, model: Whitening | None, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", scale: int = SCALE, most: int = 4) -> DataFrame:
    """For each usable row and component: ``keep``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    raw = df.select(F.struct(*keep).alias("_key"), scaled(vector, scale).alias("_x"))
    got = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([raw.schema["_key"], *[T.StructField(*c) for c in got]])
    if model is None:
        return df.sparkSession.createDataFrame([], schema).select("_key.*", *[c for c, _ in got])
    d = len(model.sums)
    k = min(most, d)
    share = [float(e / model.variance) if model.variance > 0 else None for e in model.eigenvalue[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x, m = matrix(b.column(1)), b.num_rows
                y = centred(x, model.n, model.sums)
                small = y.dtype != object and d * int(np.abs(y).max()) ** 2 < _LONG
                off = (y * y).sum(axis=1).tolist() if small else [v if v < _LONG else None for v in (sum(int(e) ** 2 for e in r) for r in y)]
                flat = model.whiten(x, k).ravel()
                each = np.repeat(np.arange(m), k)
                columns = [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(off, pa.int64()).take(pa.array(each)),
                    pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(share * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return raw.filter(F.size("_x") == d).mapInArrow(run, schema).select("_key.*", *[c for c, _ in got])
