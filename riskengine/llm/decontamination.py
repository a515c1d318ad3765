"""Benchmark decontamination by SimHash of item-sized windows, verified by weighted shingles.

A window as long as an item (in words) slides over every start in a text where it can
hold a shingle of that item. Windows and items have four SimHash fingerprints each of
their five-word shingles; a multi-index over six blocks of the 64 bits, each searched to a
radius of two bits, finds every item of the window's size within 17 bits in any of the
four. What it finds, and nothing else, is verified exactly: the weighted shingles that
window and item share, twice, over the weight of both, has to be at least 0.8.

The index holds all fingerprints within the radius; how many pairs of similarity 0.8 lie
within it is a matter of chance (of pairs just at 0.8 about 0.9 by one fingerprint and
0.999 by one of four; where a fifth of the window is one word again and again, 0.54 and 0.97; more similar pairs are closer). An item of fewer than 16 different
shingles has a fingerprint that a few of them decide (where two shingles alternate, A B A B
A against B A B A B, every second pair is over 31 bits apart), so such items, and they
alone, are searched for by their shingles.

An occurrence of an item's shingle counts for the starts whose window holds it and fewer
than the item's weight of the same shingle before it, and these starts are one interval.
The number of intervals over a start is thus its exact shared weight, and all starts of a
text are weighed at the cost of sorting the intervals' ends.

Items come in blocks of bounded size. Up to ``pass_bytes`` of them are broadcast for one
pass over the texts, in which a worker holds one block at a time; a larger benchmark is
scanned in several passes, each written before the next.

Defined results: null and empty texts and items match nothing; an item of fewer than
five words is one shingle, its whole sequence; a text shorter than an item is one window;
for each text and item the most similar window is given, the first of equal ones;
repeated rows are scanned each; empty tables give empty results; where the id columns
share a name, the item's is called ``item_`` and that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskengine.llm.words import Words, combine, keyed_text, mix, slices, split_words, text_slices
from riskengine.session import materialize

WIDTH = 5
#: Fingerprints within this many bits are found by the index: one of the blocks differs in BLOCK_RADIUS bits at most.
RADIUS, BLOCK_RADIUS = 17, 2
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: What each of the fingerprints adds to the shingles' hashes before they are mixed again.
SEEDS = tuple(np.uint64(k) for k in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Items of fewer different shingles are not left to the fingerprints.
LEAST_DISTINCT = 16
_MOST_ITEMS = 1 << 14
_STARTS = 1 << 13
#: Up to so many items of one size are compared with a window one by one, which finds the same ones.
_DIRECT = 1 << 10


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` word hashes; runs may cross from one text to the next."""
    n = max(0, len(hashes) - width + 1)
    out = mix(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        out = combine(out, hashes[k : k + n])
    return out


def bit_sums(s: np.ndarray) -> np.ndarray:
    """How many of some hashes have each of the 64 bits, some thousand hashes at a time."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(s), 1 << 16):
        out += _bits(s[k : k + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return out


def _bits(s: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_prints(s: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
    """SimHash fingerprints of the windows of ``n`` shingles that start at ``first`` to ``last``."""
    count = np.empty((last - first + 1, 64), np.int64)
    count[0] = bit_sums(s[first : first + n])
    if last > first:
        count[1:] = _bits(s[first + n : last + n]).astype(np.int8) - _bits(s[first:last]).astype(np.int8)
    np.cumsum(count, axis=0, out=count)
    return np.packbits(2 * count > n, axis=1, bitorder="little").view(np.uint64).ravel()


def seeded(s: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The shingles' hashes of one of the fingerprints."""
    return mix(s + seed) if seed else s


def _near(width: int) -> np.ndarray:
    """All differences of a block that the radius allows."""
    return np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(width), r)], np.int64)


@dataclass
class HammingIndex:
    """Fingerprints by size, and by size, block and value; a search looks under all values within the block radius."""

    prints: np.ndarray
    order: np.ndarray  # items by size
    size: np.ndarray  # in that order
    key: np.ndarray  # sorted: size, block and value
    item: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, size: np.ndarray) -> HammingIndex:
        order = np.argsort(size, kind="stable").astype(np.int32)
        keys = [((size * len(BLOCKS) + k) << 11) | ((prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)) for k, (at, width) in enumerate(BLOCKS)]
        key, item = np.concatenate(keys), np.tile(np.arange(len(prints), dtype=np.int32), len(BLOCKS))
        at = np.argsort(key, kind="stable")
        return cls(prints, order, size[order], key[at], item[at])

    def search(self, prints: np.ndarray, size: int) -> np.ndarray:
        """The items of a size within ``RADIUS`` bits of some fingerprint."""
        lo, hi = np.searchsorted(self.size, [size, size + 1])
        if lo == hi:
            return np.zeros(0, np.int32)
        if hi - lo <= _DIRECT:
            mine, out = self.order[lo:hi], np.zeros(hi - lo, bool)
            for k in range(0, len(prints), 1 << 10):
                out |= (np.bitwise_count(prints[k : k + (1 << 10), None] ^ self.prints[mine]) <= RADIUS).any(axis=0)
            return np.sort(mine[out])
        return self.look_up(prints, size)

    def look_up(self, prints: np.ndarray, size: int) -> np.ndarray:
        """``search`` by the blocks: of two fingerprints within ``RADIUS`` bits one block is within ``BLOCK_RADIUS``."""
        out = [np.zeros(0, np.int32)]
        for k, (at, width) in enumerate(BLOCKS):
            near = _near(width)
            for j in range(0, len(prints), 1 << 9):
                part = prints[j : j + (1 << 9)]
                value = (part >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
                key = (((size * len(BLOCKS) + k) << 11) | (value[:, None] ^ near)).ravel()
                lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                some = np.flatnonzero(hi > lo)
                n = hi[some] - lo[some]
                item = self.item[_spread(lo[some], n)]
                out.append(np.unique(item[np.bitwise_count(self.prints[item] ^ np.repeat(part[some // len(near)], n)) <= RADIUS]))
        return np.unique(np.concatenate(out))


@dataclass
class ItemIndex:
    """One block of items: the shingles of each with their weights, and the fingerprints; ``plain`` items are searched for by shingles."""

    ids: list
    size: np.ndarray  # words of each item
    width: np.ndarray  # words of its shingles
    n_shingles: np.ndarray
    shingle: np.ndarray  # sorted, with item: each pair once
    item: np.ndarray
    weight: np.ndarray
    plain: np.ndarray
    hamming: list[HammingIndex]

    @classmethod
    def build(cls, items: list[tuple[object, bytes]]) -> ItemIndex:
        words = split_words(pa.array([t for _, t in items], pa.binary()))
        hashes, size = words.hashes(), np.diff(words.first)
        keep = np.flatnonzero(size)
        width = np.minimum(size, WIDTH)
        found = [shingles(hashes[words.first[i] : words.first[i + 1]], int(width[i])) for i in keep]
        n = np.array([len(x) for x in found], np.int64)
        prints = [np.array([window_prints(seeded(x, seed), 0, 0, len(x))[0] for x in found], np.uint64) for seed in SEEDS]
        s, item = np.concatenate([np.zeros(0, np.uint64), *found]), np.repeat(np.arange(len(keep)), n)
        order = np.lexsort((item, s))
        s, item = s[order], item[order]
        begin = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (item[1:] != item[:-1])])[: len(s)])
        distinct = np.bincount(item[begin], minlength=len(keep))
        return cls(
            [items[i][0] for i in keep], size[keep], width[keep], n, s[begin], item[begin].astype(np.int32), np.diff(begin, append=len(s)).astype(np.int32), distinct < LEAST_DISTINCT,
            [HammingIndex.build(p, size[keep]) for p in prints],
        )


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, n[i] of them, for each i."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _similarity(shared: np.ndarray, doc: np.ndarray, item: np.ndarray, words: Words, index: ItemIndex) -> np.ndarray:
    span = np.diff(words.first)
    return 2 * shared / (np.minimum(index.size[item], span[doc]) - index.width[item] + 1 + index.n_shingles[item])


def _occurrences(words: Words, s: np.ndarray, near: np.ndarray, index: ItemIndex, some: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, entry) of the index's entries ``some`` in the shingles at ``near``, of texts and items that share enough."""
    lo, hi = np.searchsorted(index.shingle[some], s[near], "left"), np.searchsorted(index.shingle[some], s[near], "right")
    at, entry = np.repeat(near, hi - lo), some[_spread(lo, hi - lo)]
    pair, n = np.unique(words.doc[at] * len(index.ids) + index.item[entry], return_inverse=True, return_counts=True)[1:]
    enough = _similarity(n[pair], words.doc[at], index.item[entry], words, index) >= least
    return at[enough], entry[enough]


def _starts(words: Words, at: np.ndarray, item: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of a window, as long as the item, that holds the shingle at a place."""
    doc = words.doc[at]
    first = words.first[doc]
    last = np.maximum(first, words.first[doc + 1] - index.size[item])
    return np.maximum(at - index.n_shingles[item] + 1, first), np.minimum(at, last)


def _indexed(words: Words, s: np.ndarray, at: np.ndarray, entry: np.ndarray, index: ItemIndex) -> np.ndarray:
    """text * items + item of all that the fingerprint index finds for the windows around some occurrences."""
    item = index.item[entry]
    low, high = _starts(words, at, item, index)
    doc, size = words.doc[at], index.size[item]
    order = np.lexsort((low, size, doc))
    doc, size, low, high, width = doc[order], size[order], low[order], high[order], index.width[item[order]]
    span, found = np.diff(words.first), [np.zeros(0, np.int64)]
    for run in np.split(np.arange(len(order)), np.flatnonzero((np.diff(doc) != 0) | (np.diff(size) != 0)) + 1) if len(order) else []:
        d, n = int(doc[run[0]]), int(size[run[0]])
        reach = np.maximum.accumulate(high[run])
        new = np.flatnonzero(np.concatenate([[True], low[run][1:] > reach[:-1] + 1]))
        for a, b in zip(low[run][new].tolist(), reach[np.append(new[1:], len(run)) - 1].tolist(), strict=True):
            for k in range(a, b + 1, _STARTS):
                last, m = min(b, k + _STARTS - 1), min(n, int(span[d])) - int(width[run[0]]) + 1
                for seed, hamming in zip(SEEDS, index.hamming, strict=True):
                    prints = window_prints(seeded(s[k : last + m], seed), 0, last - k, m)
                    found.append(hamming.search(np.unique(prints), n) + np.int64(d) * len(index.ids))
    return np.unique(np.concatenate(found))


def _verified(words: Words, at: np.ndarray, entry: np.ndarray, index: ItemIndex, least: float) -> list[np.ndarray]:
    """The best window of each text and item with some occurrences, if it is similar enough."""
    n_words = len(words.doc)
    order = np.lexsort((at, entry, words.doc[at]))
    at, entry = at[order], entry[order]
    doc, who = words.doc[at], index.item[entry]
    # an occurrence counts from the start behind the one that is the item's weight of occurrences before it
    number = np.arange(len(at))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (entry[1:] != entry[:-1])])[: len(at)]
    before = number - index.weight[entry]
    behind = np.where(before >= np.maximum.accumulate(np.where(new, number, 0)), at[np.maximum(before, 0)], -1)
    low, high = _starts(words, at, who, index)
    low = np.maximum(low, behind + 1)
    ok = low <= high
    ends = np.concatenate([who[ok] * (n_words + 1) + low[ok], who[ok] * (n_words + 1) + high[ok] + 1])
    spot, back = np.unique(ends, return_inverse=True)
    cover = np.cumsum(np.bincount(back, np.repeat([1, -1], ok.sum()), len(spot)).astype(np.int64))
    over = np.flatnonzero(cover)
    item, start = np.divmod(spot[over], n_words + 1)
    alike = _similarity(cover[over], words.doc[start], item, words, index)
    item, start, alike = (x[alike >= least] for x in (item, start, alike))
    order = np.lexsort((start, -alike, item, words.doc[start]))
    item, start, alike = (x[order] for x in (item, start, alike))
    pair = words.doc[start] * len(index.ids) + item
    best = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
    item, start, alike = (x[best] for x in (item, start, alike))
    doc = words.doc[start]
    end = np.minimum(start + index.size[item], words.first[doc + 1])
    return [doc, item, start - words.first[doc], end - words.first[doc], alike]


def find_items(texts: pa.Array, index: ItemIndex, least: float = 0.8) -> list[np.ndarray]:
    """Text number, item number, first word, last word + 1 and similarity of each match."""
    words = split_words(texts)
    hashes = words.hashes()
    found = [[np.zeros(0, np.int64)] * 5]
    for width in sorted(set(index.width.tolist())):
        # shingles that reach into the next text are left out
        s = shingles(hashes, width)
        whole = words.doc[: len(s)] == words.doc[width - 1 :] if len(s) else np.zeros(0, bool)
        mine = np.flatnonzero(index.width[index.item] == width)
        known = index.shingle[mine]
        table = np.zeros(1 << 20, bool)
        table[known & np.uint64((1 << 20) - 1)] = True
        near = np.flatnonzero(table[s & np.uint64((1 << 20) - 1)] & whole)
        lo, hi = np.searchsorted(known, s[near], "left"), np.searchsorted(known, s[near], "right")
        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
        # items in blocks of a bounded number of shared shingles; one item shares as many as the texts have at most
        uses = np.cumsum(np.bincount(lo, minlength=len(known) + 1) - np.bincount(hi, minlength=len(known) + 1))[:-1]
        shared = np.bincount(index.item[mine], uses, len(index.ids)).astype(np.int64)
        block = (np.cumsum(shared) - shared) >> 20
        for b in np.unique(block[shared > 0]):
            at, entry = _occurrences(words, s, near, index, mine[(block[index.item[mine]] == b) & (uses > 0)], least)
            plain = index.plain[index.item[entry]]
            named = _indexed(words, s, at[~plain], entry[~plain], index)
            some = plain | np.isin(words.doc[at] * len(index.ids) + index.item[entry], named)
            found.append(_verified(words, at[some], entry[some], index, least))
    out = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> Iterator[tuple[ItemIndex, int]]:
    """Blocks of items of about ``block_bytes`` of text, and their bytes; the benchmark is read once, a partition at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t")).filter("octet_length(t) > 0")
    held: list[tuple[object, bytes]] = []
    size = 0
    for r in items.toLocalIterator():
        held.append((r.i, bytes(r.t)))
        size += len(r.t)
        if size >= block_bytes or len(held) == _MOST_ITEMS:
            yield ItemIndex.build(held), size
            held, size = [], 0
    if held:
        yield ItemIndex.build(held), size


def _passes(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, pass_bytes: int) -> Iterator[list[Broadcast]]:
    """The blocks of each pass over the texts, broadcast."""
    spark, blocks, size = benchmark.sparkSession, [], 0
    for index, n in item_blocks(benchmark, item_col, text_col, block_bytes):
        blocks.append(spark.sparkContext.broadcast(index))
        size += n
        if size >= pass_bytes:
            yield blocks
            blocks, size = [], 0
    if blocks:
        yield blocks


def _each_block(blocks: list[Broadcast]) -> Iterator[ItemIndex]:
    """The indexes one after the other; of several a worker holds one at a time and reads it from its file again."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, block_bytes: int = 4 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """``id_col``, ``item_col``, ``start_word``, ``end_word`` and ``similarity`` of every text that holds an item."""
    raw = docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("_raw"))
    said = T.StructField(item_col if item_col != id_col else f"item_{item_col}", benchmark.schema[item_col].dataType)
    schema = T.StructType([raw.schema[id_col], said, T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("similarity", T.DoubleType())])

    kind = to_arrow_type(said.dataType)

    def scan(blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "_raw"):
                for index in _each_block(blocks):
                    doc, who, start, end, alike = find_items(b.column(1), index, least)
                    if len(doc):
                        items = pa.array([index.ids[k] for k in who], kind)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), items, pa.array(start), pa.array(end), pa.array(alike.astype(float))], schema.names)

        return raw.mapInArrow(run, schema)

    out = None
    for blocks in _passes(benchmark, item_col, item_text_col, block_bytes, pass_bytes):
        if out is not None:
            out = materialize(out, "contaminated")
        found = scan(blocks)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, block_bytes: int = 4 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""

    def clean(blocks: list[Broadcast], df: DataFrame) -> DataFrame:
        rows = keyed_text(df, text_col, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, texts in text_slices(batches, text_col):
                keep = np.ones(len(texts), bool)
                for index in _each_block(blocks):
                    keep[find_items(texts, index, least)[0]] = False
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(keep))], ["row"])

        return rows.mapInArrow(run, rows.schema).select("row.*")

    passes = 0
    for blocks in _passes(benchmark, item_col, item_text_col, block_bytes, pass_bytes):
        docs = clean(blocks, materialize(docs, "clean-so-far") if passes else docs)
        passes += 1
    return docs
