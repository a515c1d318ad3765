"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised and cut into pieces of at most ``capacity`` ids; pieces are
dealt at random (by a hash) into groups of bounded expected size, and each group is
packed on its own. Only piece lengths and the caller's small columns have to move.

Defined results: a null text is an empty one and has the end id alone; repeated rows
are packed once each, and rows with a null id or the same id are dealt apart like any
others; ties in length go by id and start; an empty table gives an empty one; other
columns of the input are not carried by ``tokenize_pieces`` and all carried by ``pack``,
whose own columns (``sequence_id``, ``offset``, ``padded_length``) replace input columns
of the same names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word or white-space run longer than this goes to the reference tokenizer.
LONG_RUN = 4096
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from a text to its ids (uint32), without special tokens.

    ``path`` is a `tokenizers` JSON file. Where it is a plain byte-level BPE whose ids
    are its merge ranks, the same vocabulary is run by the faster tiktoken, and the file
    itself is loaded only for a text with a long run; tests hold the two against each other.
    """

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        return found

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = _ranks(path)
    if ranks is None:
        return by_tokenizers
    import re

    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and long_run.search(text):
            return by_tokenizers(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings by rank, if the file is a byte-level BPE without normaliser whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in printable}
    char |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in char)}
    byte = {c: b for b, c in char.items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, merged = model["vocab"], {"".join(m) for m in pairs}
    if [vocab.get("".join(m)) for m in pairs] != [*range(256, 256 + len(pairs))]:
        return None
    return {bytes(byte[c] for c in tok): i for tok, i in vocab.items() if len(tok) == 1 or tok in merged}


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens`` and ``ids`` (little-endian uint32 bytes).

    A document's ids are its text's and ``end_id``; it is cut at every multiple of ``capacity``.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer_path)
        for batch in batches:
            names, held = [id_col, "start", "length", "doc_tokens", "ids"], 0
            rows: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    for col, x in zip(rows, (i, at, len(part), len(ids), part.tobytes()), strict=True):
                        col.append(x)
                held += len(ids)
                if held > 1 << 21 or i + 1 == batch.num_rows:
                    key = batch.column(0).take(pa.array(rows[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, *(pa.array(c, pa.int64()) for c in rows[1:4]), pa.array(rows[4], pa.binary())], names)
                    rows, held = [[], [], [], [], []], 0

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def estimate_pieces(docs: DataFrame, text_col: str = "text", capacity: int = 2048, bytes_per_id: int = 4) -> int:
    """About how many pieces ``tokenize_pieces`` makes, from the bytes of all texts."""
    return docs.select(F.sum(1 + F.floor(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / (capacity * bytes_per_id)))).first()[0] or 0


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit in the given order: each item's bin and offset in it.

    The tree's leaves are the bins' free room; each inner node holds the larger of its
    two, so the leftmost bin with room is found by one walk down.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        if not 0 <= size <= capacity:
            raise ValueError(f"a piece of {size} does not fit {capacity}")
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def pack(pieces: DataFrame, n_items: int, keys: tuple[str, ...] = ("doc_id", "start"), length_col: str = "length", capacity: int = 2048, group_size: int = 2048) -> DataFrame:
    """Pack rows with a length into sequences of at most ``capacity``.

    ``n_items`` is the number of rows, or one near it: it sets how many groups there are.
    ``pieces`` should come straight from stored rows (a scan and per-row steps), as a row's
    place in it takes part in dealing, so that rows alike in their keys do not meet in one group.
    ``sequence_id`` is unique over all groups, ``offset`` gapless from 0 in each sequence.
    ``padded_length`` is the sequence's length if that is a power of two, else ``capacity``.
    """
    groups = max(1, round(n_items / group_size))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "padded_length")]
    kept = pieces.select(*names)
    out = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "padded_length"))])

    def run(key, group):
        # Arrow keeps long ids whole beside nulls, which pandas would turn into doubles
        order = pc.sort_indices(group, [(length_col, "descending"), *[(c, "ascending") for c in keys]])
        group = group.select(names).take(order)
        sizes = group.column(length_col).to_numpy()
        bins, offsets = first_fit(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)[bins]
        padded = np.where((fill & (fill - 1)) == 0, fill, capacity)
        for c, x in (("sequence_id", (key[0].as_py() << 32) + bins), ("offset", offsets), ("padded_length", padded)):
            group = group.append_column(c, pa.array(x.astype(np.int64)))
        return group

    dealt = kept.withColumn("_group", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, out)
