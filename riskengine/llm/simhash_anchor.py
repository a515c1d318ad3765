"""SimHash near-duplicates by anchor-point covering.

Fingerprints are grouped first, so copies cost nothing further. The anchors are the
words of a covering code over all 64 bits: the direct product of four perfect cyclic
codes, [23,12] twice (covering radius 3), [15,11] and [3,1] (covering radius 1). Every
fingerprint has one home anchor, the code word within the covering radius of it in each
block, and is replicated to every anchor that lies within covering radius plus threshold:
the blocks' distances beyond their radii add up to the threshold at most. If x and y
differ in at most that many bits, x's home is such an anchor of y, so an equi-join of
homes and replicas on the anchor meets every linked pair, and an exact count of differing
bits decides it. There are 2**36 anchors and 166 replicas of a fingerprint on average
(threshold 2), so a thousand million unlinked fingerprints meet about 2.4 times each.

Defined results: null and empty texts have fingerprint zero, linked like any other;
texts of one or two words have the hash of their whole word sequence; repeated rows and
ties share a fingerprint; a component whose ids are all null has a null id; an empty
table gives an empty one; extra columns are not carried by ``fingerprints``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.words import slices
from riskengine.operators.graph import connected_components
from riskengine.session import materialize

#: Length, generator polynomial and covering radius of the perfect cyclic codes, from the lowest bits on.
_CODES = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1), (3, 0b111, 1))


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    n = max(1, len(words) - width + 1)
    start, end = (end - size + 1)[:n].tolist(), end[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, n)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes, the bits that are set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    run: list[int] = []
    held = 0
    for i, h in enumerate(hashes):
        if len(h):
            run.append(i)
            held += len(h)
        if run and (held > 1 << 16 or i + 1 == len(hashes)):
            sizes = np.array([len(hashes[k]) for k in run])
            all_h = np.concatenate([hashes[k] for k in run])
            total, starts = np.zeros((len(run), 64), np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(run)), sizes)
            for at in range(0, len(all_h), 1 << 16):  # a very long text is summed part by part
                part = np.unpackbits(all_h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                who = owner[at : at + (1 << 16)]
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                total[who[first]] += np.add.reduceat(part, first, axis=0, dtype=np.int32)
            out[run] = ((2 * total > sizes[:, None]) * weight).sum(axis=1, dtype=np.uint64)
            run, held = [], 0
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit long."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw", 1 << 20):
            fp = majority_bits([shingle_hashes(x.as_py() or b"", width, seed) for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("_raw")).mapInArrow(run, schema)


@lru_cache(maxsize=16)
def _code(length: int, generator: int, radius: int, threshold: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each bit and, for each excess distance 0..threshold, error patterns by syndrome.

    ``lists[c]`` is (patterns, first): the words at distance radius+c (or at most the radius,
    for 0) from v are v ^ patterns[first[s]:first[s+1]], with s the syndrome of v.
    """
    checks = generator.bit_length() - 1
    bit = np.zeros(length, np.int64)
    for k in range(length):
        v = 1 << k
        for j in range(length - 1, checks - 1, -1):
            if v >> j & 1:
                v ^= generator << (j - checks)
        bit[k] = v
    lists = []
    for c in range(threshold + 1):
        sets = [s for w in (range(radius + 1) if c == 0 else [radius + c]) for s in combinations(range(length), w)]
        pattern = np.array([sum(1 << k for k in s) for s in sets], np.int64)
        syndrome = np.array([np.bitwise_xor.reduce(bit[list(s)]) if s else 0 for s in sets], np.int64)
        order = np.argsort(syndrome, kind="stable")
        lists.append((pattern[order], np.searchsorted(syndrome[order], np.arange((1 << checks) + 1))))
    return bit, lists


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of all anchors in reach of each fingerprint (int64); excess 0 is its home."""
    rows, anchor, excess, at = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.int64), 0
    for length, generator, radius in _CODES:
        bit, lists = _code(length, generator, radius, threshold)
        word = (fp >> at & ((1 << length) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fp), np.int64)
        for k in range(length):
            syndrome ^= bit[k] * (word >> k & 1)
        found: list[tuple[np.ndarray, ...]] = []
        for c, (pattern, first) in enumerate(lists):
            near = np.flatnonzero(excess + c <= threshold)
            s = syndrome[rows[near]]
            n = first[s + 1] - first[s]
            near = np.repeat(near, n)
            code = word[rows[near]] ^ pattern[np.repeat(first[s] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append((rows[near], anchor[near] | code.astype(np.uint64) << np.uint64(at), excess[near] + c))
        rows, anchor, excess = (np.concatenate(x) for x in zip(*found, strict=True))
        at += length
    return rows, anchor.view(np.int64), excess


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``fp_a`` < ``fp_b`` of distinct fingerprints that differ in at most ``threshold`` bits.

    ``prints`` has distinct, non-null fingerprints in ``fp``; it is read twice. The join is told
    to shuffle, as Spark sizes replicas like the fingerprints they are made of, some 166 times
    too low, and would broadcast them.
    """

    def run(home: bool):
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                    rows, anchor, _ = anchors(fp, 0 if home else threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[rows])], ["anchor", "fp_a" if home else "fp_b"])

        return prints.select("fp").mapInArrow(spread, f"anchor long, {'fp_a' if home else 'fp_b'} long")

    return run(True).join(run(False).hint("merge"), "anchor").filter(F.expr(f"fp_a < fp_b AND bit_count(fp_a ^ fp_b) <= {int(threshold)}")).select("fp_a", "fp_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, width: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct-fingerprints")
    group = connected_components(links(distinct, threshold), "fp_a", "fp_b")
    named = distinct.join(group, distinct.fp == group.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = materialize(named.join(least, "component").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select(id_col, "fp", "component_id")
