"""Vectorised word splitting and hashing of whole Arrow text columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; A-Z are
lower-cased. Both rules act on bytes, so UTF-8 text needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h = h * _C1
    h ^= h >> _S33
    h *= _C2
    h ^= h >> _S33
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """The words of a batch of texts, in order: byte spans in ``lower`` and the text each lies in."""

    lower: np.ndarray  # lower-cased bytes of all texts, one after the other
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first[i]:first[i+1] are the words of text i

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        return hash_spans(self.lower, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the n+1 offsets of its texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def split_words(texts: pa.Array, word_bytes: np.ndarray | None = None) -> Words:
    """The words of each text. ``word_bytes`` (256 flags) replaces the rule of what belongs to a word."""
    raw, off = text_bytes(texts)
    lower = _LOWER[raw]
    keep = ~_SPACE[raw] if word_bytes is None else word_bytes[lower]
    st, en = keep.copy(), keep.copy()
    if len(raw):
        st[1:] &= ~keep[:-1]
        en[:-1] &= ~keep[1:]
        inner = off[1:-1]
        at = inner[inner < len(raw)]
        st[at] = keep[at]
        at = inner[inner > 0] - 1
        en[at] = keep[at]
    start = np.flatnonzero(st)
    first = np.searchsorted(start, off).astype(np.int64)
    return Words(lower, start, np.flatnonzero(en) + 1, np.repeat(np.arange(len(off) - 1), np.diff(first)), first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - k
        h[live] = mix(h[live] ^ (at8[start[live] + k] & _TAIL[np.minimum(left, 8)]))
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 1)
    return h


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most_bytes`` of text at most; a longer text stands alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most_bytes, "right")))
            yield b.slice(at, to - at)
            at = to


def keyed_text(df: DataFrame, text_col: str, keep: tuple[str, ...] | None) -> DataFrame:
    """``row``, the columns ``keep`` in one, and the text as bytes; without ``keep`` the whole row, text and all."""
    if keep is None:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.select(F.struct(*keep).alias("row"), F.encode(F.col(text_col), "UTF-8").alias("_raw"))


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 2 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The rows and texts of ``keyed_text`` in runs as ``slices`` cuts them."""
    for b in batches:
        row = b.column(0)
        texts = b.column(1) if b.num_columns > 1 else row.field(text_col)
        named = pa.RecordBatch.from_arrays([row, texts], ["row", "_raw"])
        for part in slices(iter([named]), "_raw", most_bytes):
            yield part.column(0), part.column(1)
