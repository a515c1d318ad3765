"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, pairs of neighbours and pairs with one word
between, each counted as present or not. Training goes over a bounded sample in hash
order, with a learning rate per coordinate; L1 leaves few weights, which workers get as
two short arrays.

Defined results: null and empty texts have the intercept's score; null labels are not
learned from; a text with several labels is toxic if one says so; of several texts with
one id the first in byte order is learned from; repeated rows are scored each; without
labelled rows every score is 0.5 less a hair, so nothing is predicted toxic; extra
columns do not matter. Texts of any length are learned from and scored whole, long ones
piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.samples import draw_by_label, keep_bytes
from riskengine.llm.words import Words, combine, keyed_text, mix, slices, split_words, text_bytes, text_slices
from riskengine.session import materialize

#: Letters, digits and all bytes beyond ASCII make words.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


#: Bytes of a long text whose features are worked out at once.
_PIECE = 1 << 20


def _cut(raw: np.ndarray, most: int = _PIECE) -> list[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes between words, each beginning two words before the end of the one before.

    A range of two words or fewer is made longer, so no pair of neighbours is lost.
    """
    out, at, to = [], 0, 0
    while True:
        to += most
        while to < len(raw) and WORD_BYTES[raw[to]]:
            to += 1
        if to >= len(raw):
            return [*out, (at, len(raw))]
        back = to
        for _ in range(2):
            while back > at and not WORD_BYTES[raw[back - 1]]:
                back -= 1
            while back > at and WORD_BYTES[raw[back - 1]]:
                back -= 1
        if back > at:
            out.append((at, to))
            at = back


def text_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, feature) of every occurrence in a batch, and the number of texts.

    The features of one text that is longer than a piece come once each.
    """
    raw, off = text_bytes(texts)
    if len(texts) == 1 and len(raw) > _PIECE:
        seen = np.zeros(1 << bits, bool)
        for a, b in _cut(raw):
            seen[_features(split_words(pa.array([raw[a:b].tobytes()], pa.binary()), WORD_BYTES), bits)[1]] = True
        what = np.flatnonzero(seen)
        return np.zeros(len(what), np.int64), what, 1
    words = split_words(texts, WORD_BYTES)
    return *_features(words, bits), words.n_docs


def _features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes()
    who, what = [words.doc], [mix(h + np.uint64(1))]
    for gap in (1, 2):
        near = words.doc[:-gap] == words.doc[gap:]
        who.append(words.doc[:-gap][near])
        what.append(combine(h[:-gap][near], h[gap:][near] + np.uint64(gap)))
    return np.concatenate(who), (np.concatenate(what) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class FtrlModel:
    """Sparse weights of a logistic regression over 2**bits hashed features."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def fit_ftrl(examples: list[np.ndarray], labels: list[int], bits: int, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 10) -> FtrlModel:
    """FTRL-proximal over examples of distinct feature numbers, in the given order, ``epochs`` times."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rate = np.full((1 << bits) + 1, l1)
    rate[-1] = 0  # the intercept is not shrunk

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= rate[i], 0.0, (np.sign(zi) * rate[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for features, y in zip(examples, labels, strict=True):
            x = np.append(features, np.uint32(1 << bits))
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha * w
            n[x] += g * g
    w = weights(np.arange((1 << bits) + 1))
    index = np.flatnonzero(w[:-1])
    return FtrlModel(bits, index, w[index], float(w[-1]) if labels else -1e-6)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 16384, max_bytes: int = 32 << 20, bits: int = 20, **rates) -> FtrlModel:
    """Fit on a sample of about ``max_rows`` labelled texts, whole ones of any length.

    The sample is chosen by a hash of the id, up to a fair part of each label. Where the
    features of the chosen texts have more than ``max_bytes`` in all (a text has four bytes
    for each different feature, at most ``4 << bits``), a fair part in bytes of each label
    is kept, so what the driver gets is bounded by about that whatever the corpus. The
    intercept is moved by what the labels' shares in the sample differ from those in the
    table.
    """
    known = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.withColumn("_h", F.xxhash64("_id", F.lit("sample")))
    chosen = draw_by_label(known, "_y", "_h", max_rows).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(F.col(text_col), "UTF-8").alias("_raw"))
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_raw").alias("_raw"), F.max("_y").alias("_y"))
    rows = rows.select(F.xxhash64("_id").alias("_order"), "_raw", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw", _PIECE):
            who, what, count = text_features(b.column(1), bits)
            key = np.unique(who << bits | what)
            cut = np.searchsorted(key, np.arange(count + 1) << bits)
            found = [(key[i:j] & ((1 << bits) - 1)).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["o", "y", "x"])

    drawn = materialize(rows.mapInArrow(run, "o long, y int, x binary"), "toxicity-features")
    got = keep_bytes(drawn, "y", "o", "x", max_bytes).toArrow().combine_chunks().sort_by([("o", "ascending"), ("y", "ascending"), ("x", "ascending")])
    raw, off = text_bytes(got.column("x"))
    numbers, first, y = np.frombuffer(raw, "<u4"), off // 4, got.column("y").to_numpy()
    model = fit_ftrl([numbers[i:j] for i, j in zip(first[:-1], first[1:], strict=True)], y.tolist(), bits, **rates)
    model.intercept += _shift({r[0]: r[1] for r in known.groupBy("_y").count().collect()}, y)
    return model


def _shift(table: dict[int, int], sample: np.ndarray) -> float:
    """The logit of label 1 in the table less that in the sample; 0 where either lacks a label."""
    pos, neg, mine, rest = table.get(1, 0), table.get(0, 0), int(sample.sum()), int((1 - sample).sum())
    return float(np.log(pos / neg) - np.log(mine / rest)) if min(pos, neg, mine, rest) else 0.0


def score(docs: DataFrame, model: FtrlModel, text_col: str = "text", keep: tuple[str, ...] | None = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``toxicity``, the probability of label 1, for every whole text.

    Without ``keep`` the whole row comes along in one column ``row``, and its text is not sent to Python twice.
    """
    kept = keyed_text(docs, text_col, keep)
    schema = T.StructType([kept.schema["row"], T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.dense()
        for row, texts in text_slices(batches, text_col, _PIECE):
            who, what, count = text_features(texts, model.bits)
            used = np.flatnonzero(weight[what])
            key = np.unique(who[used] << model.bits | what[used])
            logit = model.intercept + np.bincount(key >> model.bits, weight[key & ((1 << model.bits) - 1)], count)
            yield pa.RecordBatch.from_arrays([row, pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["row", "toxicity"])

    found = kept.mapInArrow(run, schema)
    return found if keep is None else found.select("row.*", "toxicity")


def is_toxic(threshold: float = 0.5) -> Column:
    return F.col("toxicity") >= threshold
