"""Interpolated modified Kneser-Ney n-gram model over a corpus.

Spark counts words, then n-grams of the highest order, and from the distinct ones of each
order how many different words stand before those of the next lower order. Tasks sum their
own texts first; partial counts are dealt by hash into shards, and each shard's exact sums
are stored as sorted hash arrays in the shared folder. Workers memory-map these and look
n-grams up by binary search of sorted needles. A word's id is its place among all sorted
word hashes, ids go through the shuffles, and an n-gram's key is a 64-bit hash of its ids.
N-grams are dealt by their context; a context of frequent words only (each over 1/1024 of
the corpus) is dealt by the last word as well, and what its parts say is summed after.

Layout under the model's folder: ``w<s>.hash.npy``/``w<s>.count.npy`` (words and counts),
``w<s>.left.npy`` (distinct left neighbours); for each order k from 2 on ``g<k>.<s>.one.npy``
(n-grams of count 1), ``g<k>.<s>.many.npy``/``g<k>.<s>.count.npy`` (the others),
``c<k>.<s>.one.npy`` (contexts of total 1), ``c<k>.<s>.key.npy``/``c<k>.<s>.stat.npy`` (total
and numbers of n-grams with count 1, 2, 3 and more of the others), and ``h<k>.<s>`` the same
for contexts of frequent words. A shard without rows has no files. Of more than 1,024 shards,
those that share their first ten bits are put into one file each, with ``.off.npy`` for where
a shard begins, and their own files go; needles are then searched for within their shards'
parts of a file all at once, so what a batch does grows with the logarithm of the corpus only.

Texts begin with as many start marks as the order asks for. Defined results: null and
empty texts are the end token alone; repeated rows count each time; a null id counts as
training; with no training text every score is zero; an empty table gives an empty one;
extra columns are carried by ``score`` only if asked for.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.words import combine, mix, slices, split_words, text_bytes
from riskengine.session import shared_path

END_HASH = np.uint64(0x0E1D0E1D0E1D0E1D)
HOT_SHARE = 1024
_BATCH = 1 << 20
#: Files of shards are put together by so many first bits.
FILE_BITS = 10


def local_folder(uri: str) -> str:
    """The mount point of a shared folder; memory mapping needs one."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped, so {uri} has to be a mounted shared folder")
    return found.path


_EMPTY = {"count": np.uint32, "left": np.uint32, "stat": np.uint32}


def _save(path: str, array: np.ndarray) -> None:
    """Write an array whole or not at all, so a repeated task does no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _shrink(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


#: Mapped files that a worker keeps: all of an order-2 model with room, 19 kinds of 1,024 files at most. With fewer each batch would open all again.
MAPPED = 1 << 15


@lru_cache(maxsize=MAPPED)
def _map(path: str) -> np.ndarray:
    """A stored array, mapped without keeping its file open; an empty one where no row went to the shard."""
    if not os.path.exists(path):
        kind = path.split(".")[-2]
        return np.zeros((0, 4) if kind == "stat" else 0, _EMPTY.get(kind, np.uint64))
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if 0 in shape:
            return np.zeros(shape, dtype)
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        return np.frombuffer(held, dtype, int(np.prod(shape)), f.tell()).reshape(shape)


def _find(sorted_array: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted needles in a sorted array and whether they are there."""
    at = np.searchsorted(sorted_array, needles)
    safe = np.minimum(at, max(0, len(sorted_array) - 1))
    return safe, (sorted_array[safe] == needles) if len(sorted_array) else np.zeros(len(needles), bool)


def _find_within(stored: np.ndarray, lo: np.ndarray, hi: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of needles, each in its own sorted part ``lo:hi`` of an array, and whether they are there; all are halved at once."""
    end, lo, hi = hi, lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        less = open_ & (np.asarray(stored[np.minimum(middle, len(stored) - 1)]) < needles)
        lo = np.where(less, middle + 1, lo)
        hi = np.where(open_ & ~less, middle, hi)
    hit = lo < end
    hit[hit] = np.asarray(stored[lo[hit]]) == needles[hit]
    return lo, hit


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of entries with count 1 to 4; with too few of them, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((d > 0) & (d < [1, 2, 3]), d, [0.5, 1.0, 1.5])


@dataclass
class Model:
    """What workers need besides the mapped files; its size does not grow with the corpus but for the shard count."""

    folder: str
    order: int
    word_bits: int
    gram_bits: int
    base: np.ndarray  # first id of each word shard, and the number of words
    n_tokens: int
    hot: np.ndarray  # sorted ids of frequent words
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # of counts 1, 2, 3+ by order
    left_total: int = 0
    left_counts: np.ndarray = field(default_factory=lambda: np.zeros(3))  # words with 1, 2, 3+ left neighbours
    file_bits: int = FILE_BITS

    @property
    def n_words(self) -> int:
        return int(self.base[-1])

    def _spots(self, bits: int, prefix: str, name: str, keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, str, int, np.ndarray, np.ndarray]]:
        """Keys by file: which they are, the file's name without its kind, its first shard, their places in it and whether they are there."""
        step = max(0, bits - self.file_bits)
        file = shard >> step
        for f, at in _runs(file, np.argsort(file, kind="stable")):
            if not step:
                path = f"{self.folder}/{prefix}{f}"
                yield at, path, f, *_find(_map(f"{path}.{name}.npy"), keys[at])
                continue
            path = f"{self.folder}/{prefix}f{f}"
            stored, off = _map(f"{path}.{name}.npy"), _map(f"{path}.{name}.off.npy")
            if len(stored):
                own = shard[at] - (f << step)
                yield at, path, f << step, *_find_within(stored, off[own], off[own + 1], keys[at])

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; n_words + 1 where unknown. n_words itself is the start."""
        out = np.full(len(hashes), self.n_words + 1, np.int64)
        shard = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64) if self.word_bits else np.zeros(len(hashes), np.int64)
        for at, _, first, where, hit in self._spots(self.word_bits, "w", "hash", hashes, shard):
            out[at[hit]] = where[hit] + self.base[first]
        return out

    def of_words(self, ids: np.ndarray, name: str) -> np.ndarray:
        """A stored value of sorted ids; 0 for the start and unknown words."""
        out, step = np.zeros(len(ids), np.int64), max(0, self.word_bits - self.file_bits)
        known = np.flatnonzero((ids >= 0) & (ids < self.n_words))
        file = (np.searchsorted(self.base, ids[known], "right") - 1) >> step
        for f, at in _runs(file, np.arange(len(file))):
            stored = _map(f"{self.folder}/w{'f' if step else ''}{f}.{name}.npy")
            if len(stored):
                out[known[at]] = stored[ids[known[at]] - self.base[f << step]]
        return out

    def are_hot(self, ids: np.ndarray) -> np.ndarray:
        return _find(self.hot, ids)[1]

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.gram_bits)).astype(np.int64) if self.gram_bits else np.zeros(len(keys), np.int64)

    def counts(self, k: int, keys: np.ndarray, dealt: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct n-grams of order ``k``, which are dealt by the hashes ``dealt``."""
        out, shard = np.zeros(len(keys), np.int64), self.shard(dealt)
        for at, _, _, _, hit in self._spots(self.gram_bits, f"g{k}.", "one", keys, shard):
            out[at[hit]] = 1
        for at, path, _, where, hit in self._spots(self.gram_bits, f"g{k}.", "many", keys, shard):
            out[at[hit]] = _map(f"{path}.count.npy")[where[hit]]
        return out

    def contexts(self, k: int, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Total and numbers of n-grams with count 1, 2 and 3+ behind sorted distinct contexts of order ``k``; zeros where unseen."""
        out, shard = np.zeros((len(keys), 4), np.int64), self.shard(keys)
        for name, some in (("c", np.flatnonzero(~hot)), ("h", np.flatnonzero(hot))):
            for at, _, _, _, hit in self._spots(self.gram_bits, f"{name}{k}.", "one", keys[some], shard[some]):
                out[some[at[hit]]] = (1, 1, 0, 0)
            for at, path, _, where, hit in self._spots(self.gram_bits, f"{name}{k}.", "key", keys[some], shard[some]):
                out[some[at[hit]]] = _map(f"{path}.stat.npy")[where[hit]]
        return out


def _runs(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its rows, which ``order`` sorts by shard."""
    if len(order):
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for at in np.split(order, cut):
            yield int(shard[at[0]]), at


def _fold(hashed: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    """The hash of n-grams from that of all words but the last, and the last words' ids."""
    last = ids.astype(np.uint64) + np.uint64(1)
    return mix(last) if hashed is None else combine(hashed, last)


def _tokens(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens of a batch with start marks, the places of those that are predicted, and the number of these before each text's end."""
    words, pad = split_words(texts), model.order - 1
    distinct, place = np.unique(np.append(words.hashes(), END_HASH), return_inverse=True)
    ids = model.word_ids(distinct)[place]
    n = words.n_docs
    seq = np.full(len(words.start) + n * (pad + 1), model.n_words, np.int64)
    at = np.arange(len(words.start)) + words.doc * (pad + 1) + pad
    ends = words.first[1:] + np.arange(n) * (pad + 1) + pad
    seq[at], seq[ends] = ids[:-1], ids[-1]
    return seq, np.sort(np.concatenate([at, ends])), words.first[1:] + np.arange(n) + 1


def _hashes(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 on, the hashes of the n-grams that end at each place; the first places have none of their own."""
    out = [_fold(None, seq)]
    for _ in range(order - 1):
        before = np.concatenate([out[-1][:1], out[-1][:-1]]) if len(seq) else out[-1]
        out.append(_fold(before, seq))
    return out


def _all_hot(hot: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` tokens before each place are all frequent."""
    out = np.ones(len(hot), bool)
    for k in range(1, width + 1):
        out[k:] &= hot[:-k]
    return out


def _bits(size: int, per_shard: int) -> int:
    return max(0, size // per_shard).bit_length()


def _put_together(folder: str, prefix: str, name: str, file: int, step: int) -> int:
    """The arrays of one kind of all shards of a file, one after the other; their own files go. The number of rows."""
    path = f"{folder}/{prefix}f{file}.{name}.npy"
    shards = [f"{folder}/{prefix}{s}.{name}.npy" for s in range(file << step, (file + 1) << step)]
    if not os.path.exists(path):  # else a lost task got so far
        held = [np.load(p, mmap_mode="r") if os.path.exists(p) else None for p in shards]
        off = np.concatenate([[0], np.cumsum([0 if h is None else len(h) for h in held])]).astype(np.int64)
        if off[-1]:
            some, part = [h for h in held if h is not None], f"{path}.{uuid.uuid4().hex}"
            whole = np.lib.format.open_memmap(part, "w+", max((h.dtype for h in some), key=lambda d: d.itemsize), (int(off[-1]), *some[0].shape[1:]))
            for h, a, b in zip(held, off[:-1], off[1:], strict=True):
                if h is not None:
                    whole[a:b] = h
            whole.flush()
            _save(f"{path.removesuffix('.npy')}.off.npy", off)
            os.replace(part, path)
    for p in shards:
        if os.path.exists(p):
            os.remove(p)
    return len(np.load(path, mmap_mode="r")) if os.path.exists(path) else 0


def _bundle(spark: SparkSession, folder: str, bits: int, file_bits: int, kinds: list[tuple[str, str]]) -> None:
    """Put the shards' files of some kinds together where there are many; a task has one file at a time."""
    step = bits - file_bits
    if step <= 0:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                prefix, name = kinds[n >> file_bits]
                rows = _put_together(folder, prefix, name, n & ((1 << file_bits) - 1), step)
                yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    spark.range(0, len(kinds) << file_bits, 1, min(len(kinds) << file_bits, 1024)).mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


_ROWS = "kind int, shard int, rows long, packed binary"
_GRAMS, _CONTEXTS, _FIGURES = 0, 1, 2


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as their bytes, place by place (which compresses well), with their widths before."""
    parts = []
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(c) or int(c.max()) < 1 << 8 * w)
        parts.append(bytes([width]) + np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int) -> list[np.ndarray]:
    raw, at, out = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(raw):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, rows * width, at + 1).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64))
        at += 1 + rows * width
    return out


def _rows(kind: int, shard: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One packed row for each shard; the columns' rows keep their order within it."""
    order = np.argsort(shard, kind="stable")
    found = [(s, len(at), _pack([c[at] for c in columns])) for s, at in _runs(shard, order)]
    return pa.table([pa.array([kind] * len(found), pa.int32()), pa.array([s for s, _, _ in found], pa.int32()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.binary())], ["kind", "shard", "rows", "packed"])


def _columns(t: pa.Table) -> list[np.ndarray]:
    """The columns of all packed rows, one after the other."""
    parts = [_unpack(x, n) for x, n in zip(t.column("packed").to_pylist(), t.column("rows").to_pylist(), strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _figures(order: int, *n: int) -> pa.Table:
    return _rows(_FIGURES, np.array([order]), *[np.array([x], np.int64) for x in (*n, *[0] * (4 - len(n)))])


def train(docs: DataFrame, text_col: str = "text", order: int = 2, bytes_per_shard: int = 12 << 20, file_bits: int = FILE_BITS) -> Model:
    """Count all texts and store the model in the shared folder.

    The driver gets some rows for each word shard and each frequent word only. A shard is as
    large as ``bytes_per_shard`` of text make it, however large the corpus is; the files that
    are left hold all shards of equal first ``file_bits`` bits.
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    uri = shared_path(docs.sparkSession, "kneser-ney")
    folder = local_folder(uri)
    os.makedirs(folder)
    texts = docs.select(F.encode(F.col(text_col), "UTF-8").alias("_raw"))
    size = texts.agg(F.sum(F.octet_length("_raw"))).first()[0] or 0
    model = Model(folder, order, _bits(size, bytes_per_shard), _bits(2 * size, bytes_per_shard), np.zeros(2, np.int64), 0, np.zeros(0, np.int64), file_bits=file_bits)
    word_bits = model.word_bits

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw", _BATCH):
            words = split_words(b.column(0))
            h, n = np.unique(words.hashes(), return_counts=True)
            h, n = np.append(h, END_HASH), np.append(n, words.n_docs)
            shard = (h >> np.uint64(64 - word_bits)).astype(np.int32) if word_bits else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["shard", "word", "n"])

    def store_words(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        h, n = _sum_by_key(t.column("word").to_numpy().view(np.uint64), t.column("n").to_numpy())
        _save(f"{folder}/w{s}.hash.npy", h)
        _save(f"{folder}/w{s}.count.npy", _shrink(n))
        top = np.flatnonzero(n * HOT_SHARE >= n.sum())
        return pa.table({"shard": pa.array(np.full(len(top) + 1, s, np.int32)), "at": pa.array(np.append(top, -1)), "n": pa.array(np.append(n[top], n.sum())), "words": pa.array(np.full(len(top) + 1, len(h)))})

    counted = texts.mapInArrow(word_counts, "shard int, word long, n long")
    rows = counted.groupBy("shard").applyInArrow(store_words, "shard int, at long, n long, words long").collect()
    sizes = np.zeros(1 << word_bits, np.int64)
    for r in rows:
        sizes[r.shard] = r.words
    model.base = np.concatenate([[0], np.cumsum(sizes)])
    if model.n_words >= (1 << 32) - 2:
        raise ValueError("over 2^32 distinct words do not fit the ids")
    _bundle(docs.sparkSession, folder, word_bits, file_bits, [("w", "hash"), ("w", "count")])
    model.n_tokens = sum(r.n for r in rows if r.at < 0)
    hot = [int(model.base[r.shard]) + r.at for r in rows if r.at >= 0 and r.n * HOT_SHARE >= model.n_tokens]
    model.hot = np.array(sorted([*hot, model.n_words]), np.int64)  # the start mark is always one

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw", _BATCH):
            seq, pred, _ = _tokens(model, b.column(0))
            h = _hashes(seq, order)
            key, first, n = np.unique(h[-1][pred], return_index=True, return_counts=True)
            by = np.lexsort([seq[pred[first] - k] for k in range(order)])  # by the first word, then the others
            key, n, at = key[by], n[by], pred[first][by]
            ids = [seq[at - k] for k in range(order - 1, -1, -1)]
            dealt = np.where(_all_hot(model.are_hot(seq), order - 1)[at], key, h[-2][at - 1]) if order > 1 else key
            if order > 1:
                yield from _rows(_GRAMS, model.shard(dealt), *ids, n).to_batches()
            else:  # of order 1 the counts themselves are discounted
                word = np.searchsorted(model.base, ids[0], "right") - 1
                yield from _rows(_GRAMS, word, *ids, n).to_batches()

    def stage(k: int):
        """Store the n-grams of order ``k`` of one shard and count what stands before those of order ``k - 1``."""

        def run(t: pa.Table) -> pa.Table:
            kind, s = t.column("kind")[0].as_py(), t.column("shard")[0].as_py()
            if kind == _FIGURES:
                return t
            *found, n = _columns(t)
            if kind == _CONTEXTS:  # the parts of frequent contexts of the order above
                parts = [_sum_by_key(found[0], x.astype(np.int64)) for x in (*found[1:], n)]
                _store_contexts(f"{folder}/h{k + 1}.{s}", parts[0][0], np.stack([x for _, x in parts], axis=1))
                return _figures(0, 0)
            n, ids = n.astype(np.int64), np.stack(found, axis=1).astype(np.uint32)
            del found
            h, above = None, None
            for col in ids.T:
                h, above = _fold(h, col), h
            if k == 1:
                found, n = _sum_by_key(ids[:, 0].astype(np.int64), n)
                left = np.zeros(model.base[s + 1] - model.base[s], np.int64)
                left[found - model.base[s]] = n
                _save(f"{folder}/w{s}.left.npy", _shrink(left))
                return pa.concat_tables([_figures(1, *[(n == c).sum() for c in (1, 2, 3, 4)]), _figures(0, (n == 1).sum(), (n == 2).sum(), (n > 2).sum(), n.sum())])
            place = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[place][1:] != h[place][:-1]])
            first = np.flatnonzero(new)
            n, place = np.add.reduceat(n[place], first), place[first]
            h, above, ids = h[place], above[place], ids[place]
            _save(f"{folder}/g{k}.{s}.one.npy", h[n == 1])
            _save(f"{folder}/g{k}.{s}.many.npy", h[n > 1])
            _save(f"{folder}/g{k}.{s}.count.npy", _shrink(n[n > 1]))
            by = np.argsort(above, kind="stable")
            key, first = np.unique(above[by], return_index=True)
            stat = np.stack([np.add.reduceat(x[by].astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)], axis=1)
            hot = np.logical_and.reduce([model.are_hot(ids[by[first], j].astype(np.int64)) for j in range(k - 1)])
            _store_contexts(f"{folder}/c{k}.{s}", key[~hot], stat[~hot])
            out = [_figures(k, *[(n == c).sum() for c in (1, 2, 3, 4)]), _rows(_CONTEXTS, model.shard(key[hot]), key[hot], *stat[hot].T)]
            lower = ids[:, 1:]
            g, ctx = None, None
            for col in lower.T:
                g, ctx = _fold(g, col), g
            g, at, left = np.unique(g, return_index=True, return_counts=True)
            if k == 2:
                shard = np.searchsorted(model.base, lower[at, 0], "right") - 1
            else:
                frequent = np.logical_and.reduce([model.are_hot(lower[at, j].astype(np.int64)) for j in range(k - 2)])
                shard = model.shard(np.where(frequent, g, ctx[at]))
            by = np.lexsort(lower[at].T[::-1])
            out.append(_rows(_GRAMS, shard[by], *lower[at][by].T, left[by]))
            return pa.concat_tables(out)

        return run

    df = texts.mapInArrow(gram_counts, _ROWS)
    for k in range(order, 0, -1):
        df = df.groupBy("kind", "shard").applyInArrow(stage(k), _ROWS)
    few = {k: np.zeros(4, np.int64) for k in range(order + 1)}
    for k, n in _summed_figures(df):
        few[k] += n
    _bundle(docs.sparkSession, folder, word_bits, file_bits, [("w", "left")])
    kinds = [(f"{p}{k}.", name) for k in range(2, order + 1) for p, names in (("g", ("one", "many", "count")), ("c", ("one", "key", "stat")), ("h", ("one", "key", "stat"))) for name in names]
    _bundle(docs.sparkSession, folder, model.gram_bits, file_bits, kinds)
    model.discounts = {k: _discounts(few[k]) for k in range(1, order + 1)}
    model.left_total, model.left_counts = int(few[0][3]), few[0][:3].astype(float)
    return model


def _summed_figures(df: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The figures of all shards, added up in tasks first; the driver gets a row for each task and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.array(_unpack(x, n), np.int64)[:, 0]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["k", "n"])

    got = df.mapInArrow(run, "k int, n array<long>").select("k", F.posexplode("n").alias("at", "n")).groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r.k, np.zeros(4, np.int64))[r.at] = r.n
    return list(out.items())


def _store_contexts(path: str, key: np.ndarray, stat: np.ndarray) -> None:
    one = stat[:, 0] == 1
    _save(f"{path}.one.npy", key[one])
    _save(f"{path}.key.npy", key[~one])
    _save(f"{path}.stat.npy", _shrink(stat[~one].ravel()).reshape(-1, 4))


def log_probabilities(model: Model, seq: np.ndarray, pred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted token: log10 of the model's and of the base probability, and whether training has it."""
    ids, word = np.unique(seq[pred], return_inverse=True)
    count, left = model.of_words(ids, "count"), model.of_words(ids, "left")
    cut = lambda n, k: np.concatenate([[0.0], model.discounts[k]])[np.minimum(n, 3)]
    if model.left_total:
        uniform = (model.left_counts @ model.discounts[1]) / model.left_total / (model.n_words + 1)
        p = ((left - cut(left, 1)) / model.left_total + uniform)[word]
    else:
        p = np.ones(len(pred))
    base = np.log10((count + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
    h, hot = _hashes(seq, model.order), model.are_hot(seq)
    for k in range(2, model.order + 1):
        gram, above, frequent = h[k - 1][pred], h[k - 2][pred - 1], _all_hot(hot, k - 1)[pred]
        key, first, back = np.unique(gram, return_index=True, return_inverse=True)
        n = model.counts(k, key, np.where(frequent[first], key, above[first]))[back]
        key, first, back = np.unique(above, return_index=True, return_inverse=True)
        stat = model.contexts(k, key, frequent[first])[back]
        total = np.maximum(stat[:, 0], 1)
        p = np.where(stat[:, 0] > 0, (n - cut(n, k)) / total + stat[:, 1:] @ model.discounts[k] / total * p, p)
    return np.log10(p), base[word], count[word] > 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10) and ``perplexity`` of every text."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw", _BATCH):
            seq, pred, ends = _tokens(model, b.column(1))
            p, base, known = log_probabilities(model, seq, pred)
            first = np.concatenate([[0], ends[:-1]])
            n, total = ends - first, np.add.reduceat(p, first)
            cols = [b.column(0), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** np.minimum(300, -total / n))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("_raw")).mapInArrow(run, T.StructType(fields))
