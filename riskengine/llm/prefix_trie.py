"""The prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. All nodes are ranked lexicographically, so
that each subtree is one interval of ranks: from the node to the largest last rank of the
conversations that begin with it. What a subtree holds is then the difference of two
prefix sums over the ranks, and no path is ever walked.

Ranks. A turn's symbol is a 128-bit hash of role and text; any order of symbols will do.
Sequences are cut into blocks of 32 turns. The paths within a block, 32 symbols at most,
are sorted and ranked; in the next round the ranks of whole blocks, and of the path into
the last one, are the symbols, and so on until one block holds a conversation. Rounds
grow with the logarithm of the longest conversation, and no key is longer than 32 symbols.

Nothing gathers a conversation or a node's members. Rows are placed by ranges of sampled
keys of bounded length, numbered within them and shifted by the sizes of the ranges
before; keys with more than a thousandth of the rows meet theirs in a broadcast. The list
of a node's ends is hashed from pieces in order, as a stream; a digest is sequential by
nature, so one task reads the pieces of one node, one at a time.

Defined results: null roles and texts are empty; turns are ordered by number (null
first), those of one number by role and text (by the first 64 characters of both, then by
symbol), and repeated rows are turns each; rows without a conversation id belong to none; the root has no turns, and every conversation is a member of it; empty
tables give no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskengine.llm.skew import join_by_key
from riskengine.session import materialize

#: Turns, or blocks of them, that make one sort key.
BLOCK = 32
#: Characters of role and text that order turns of one number.
_LEAD = 64
#: Conversations that share their opening, and what their ids leave when divided by 6 says how much of it.
SHARED, MOST = 100, 6
#: Characters of ids in a piece of a list.
_PIECE = 1 << 12
#: The position of a row as monotonically_increasing_id gives it: the partition from bit 33 on.
_PART = 33


def placed(df: DataFrame, by: list[Column], within: list[Column], place: str, name: str) -> DataFrame:
    """The rows written in the order of ``by`` and ``within``, with ``place``, a number that grows with it (not without gaps).

    ``by`` decides the range a row goes to and has to be short, as a sample of it is
    gathered; rows equal in it are in one range and are ordered by ``within``.
    """
    at = df.repartitionByRange(*by).sortWithinPartitions(*by, *within).withColumn(place, F.monotonically_increasing_id())
    return materialize(at, name)


def before_part(df: DataFrame, place: str, sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``_part`` and each of ``sums`` over the ranges before this one; a row for each range (and key) that has rows."""
    per = df.groupBy(*keys, F.shiftright(place, _PART).alias("_part")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])


def running(df: DataFrame, place: str, sums: dict[str, Column]) -> DataFrame:
    """Each of ``sums`` added up over all rows up to and with this one. ``df`` is as ``placed`` gave it.

    The table of what came before has a row for each range, as many as the shuffle has partitions.
    """
    upto = Window.partitionBy("_part").orderBy(place)
    part = df.withColumn("_part", F.shiftright(place, _PART))
    got = part.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(before_part(df, place, sums)), "_part")
    return got.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_part", *[f"_before_{n}" for n in sums])


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c``, ``i`` (from 0), ``symbol`` and ``chars`` (code points of the text) of each turn, in the conversation's order."""
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    symbol = F.unhex(F.left(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), F.lit(32)))
    # equal rows are dealt by their place in the input, so that many of them are not one range
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))
    rows = rows.withColumns({"symbol": symbol, "_role": F.left("role", F.lit(_LEAD)), "_lead": F.left("text", F.lit(_LEAD)), "_deal": deal}).withColumn("chars", F.length("text").cast("long")).drop("role", "text")
    keys = ["c", F.col("t").asc_nulls_first(), "_role", "_lead", "symbol", "_deal"]
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = materialize(at.select("c", "_at", "symbol", "chars"), "turns")
    part = at.withColumn("_part", F.shiftright("_at", _PART))
    inner = part.withColumn("_in", F.row_number().over(Window.partitionBy("c", "_part").orderBy("_at")) - 1)
    shift = before_part(at, "_at", {"rows": F.lit(1)}, ("c",))
    return inner.join(shift, ["c", "_part"]).select("c", (F.col("_in") + F.col("_before_rows")).cast("long").alias("i"), "symbol", "chars")


def share_openings(turns: DataFrame, shared: int = SHARED, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: ids ``c``, and their turns ``c``, ``i``, ``symbol``, ``chars``.

    The first h = crc32(c) % ``most`` turns are those of conversation c - c % ``shared``
    (fewer, or none, where it has no more); the conversation's own follow after its first h.
    """
    turns = materialize(turns, "numbered")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    heads = turns.filter(F.col("i") < most).select(F.col("c").alias("base"), "i", "symbol", "chars")
    heads = materialize(heads.filter(F.col("base") % shared == 0), "heads")
    sizes = heads.groupBy("base").agg(F.count("*").alias("_size"))
    ids = turns.select("c").distinct().withColumns({"base": F.col("c") - F.col("c") % shared, "h": h})
    ids = materialize(ids.join(sizes, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("_size", F.lit(0))).alias("got")), "conversations")
    opening = ids.filter("got > 0").join(heads, "base").filter(F.col("i") < F.col("got")).select("c", "i", "symbol", "chars")
    own = join_by_key(turns, ids.select("c", "h", "got"), "c").filter(F.col("i") >= F.col("h")).select("c", (F.col("i") - F.col("h") + F.col("got")).alias("i"), "symbol", "chars")
    return ids.select("c"), opening.unionByName(own)


def _keys(rows: DataFrame, size: int) -> DataFrame:
    """``key`` of each row: the symbols of the whole sub-blocks of ``size`` turns before it in its block, and its own."""
    block = F.floor(F.col("i") / (size * BLOCK)).alias("_block")
    if size == 1:
        path = rows.groupBy("c", block).agg(F.array_sort(F.collect_list(F.struct("i", "symbol", "chars"))).alias("_p"))
        one = path.select("c", F.col("_p")["symbol"].alias("_s"), F.posexplode("_p").alias("_at", "_r"))
        return one.select("c", "_r.i", "_r.chars", F.slice("_s", F.lit(1), F.col("_at") + 1).alias("key"))
    rows = rows.withColumn("_block", block)
    full = rows.filter((F.col("i") + 1) % size == 0).groupBy("c", "_block").agg(F.array_sort(F.collect_list(F.struct("i", "symbol")))["symbol"].alias("_s"))
    done = F.floor((F.col("i") % (size * BLOCK)) / size).cast("int")
    path = F.concat(F.slice(F.coalesce("_s", F.array().cast("array<bigint>")), F.lit(1), done), F.array("symbol"))
    return rows.join(full, ["c", "_block"], "left").select("c", "i", "chars", path.alias("key"))


def ranked(turns: DataFrame) -> DataFrame:
    """``c``, ``i``, ``chars`` and ``rank`` of the sequence that ends there: larger for lexicographically later ones, equal for equal ones."""
    rows = materialize(turns, "rebuilt")
    longest = rows.agg(F.max("i")).first()[0]
    size = 1
    while True:
        keyed = materialize(_keys(rows, size), "keys")
        rank = placed(keyed.groupBy("key").agg(F.lit(1).alias("_one")).select("key"), [F.col("key")], [], "rank", "ranks")
        rows = materialize(join_by_key(keyed, rank, "key").select("c", "i", "chars", "rank"), "ranked")
        size *= BLOCK
        if longest is None or longest < size:
            return rows
        rows = rows.withColumnRenamed("rank", "symbol")


def _digests(ends: DataFrame) -> DataFrame:
    """``rank`` and ``ends_sha256`` of the ids ``c`` at each rank, ascending and joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one rank as texts of bounded length; the first id gives their order."""
        out: list[tuple[int, int, str]] = []
        rank, first, held, size = None, None, [], 0
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (r != rank or size >= _PIECE):
                    out.append((rank, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    rank, first = r, c
                held.append(str(c))
                size += len(held[-1])
            if out:
                yield _columns(out)
                out = []
        if held:
            yield _columns([(rank, first, ",".join(held))])

    def _columns(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rank", "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, state = None, None
        for b in batches:
            done = []
            for r, text in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if r != rank:
                    if state is not None:
                        done.append((rank, state.hexdigest()))
                    rank, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["rank", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([state.hexdigest()])], ["rank", "ends_sha256"])

    cut = ends.select("rank", F.col("c").cast("long").alias("c")).repartitionByRange("rank", "c").sortWithinPartitions("rank", "c").mapInArrow(pieces, "rank long, first long, text string")
    return cut.repartition("rank").sortWithinPartitions("rank", "first").mapInArrow(digest, "rank long, ends_sha256 string")


def build(conversations: tuple[DataFrame, DataFrame]) -> DataFrame:
    """All nodes of the ids ``c`` and their turns (``c``, ``i``, ``symbol``, ``chars``), as a table with

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, and with the node's interval:
    ``position`` (of the root: -1) and ``subtree_end``, the position of the last node below it.
    """
    ids, turns = conversations
    rows = ranked(turns)
    last = materialize(rows.groupBy("c").agg(F.max("rank").alias("last")), "last")
    above = rows.select("c", (F.col("i") + 1).alias("i"), F.col("rank").alias("parent"))
    path = materialize(join_by_key(rows, last, "c").join(above, ["c", "i"], "left").withColumn("parent", F.coalesce("parent", F.lit(-1))), "paths")
    nodes = path.groupBy("rank").agg(F.min("c").alias("conv_id"), (F.min("i") + 1).alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("last").alias("subtree_end"), F.min("chars").alias("chars"))
    # the root has a row for each conversation
    ended = ids.join(last, "c", "left")
    root = ended.agg(F.lit(-1).cast("long").alias("rank"), F.min("c").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n_convs"), F.coalesce(F.max("last"), F.lit(-1)).alias("subtree_end"), F.lit(0).cast("long").alias("chars"))
    nodes = materialize(nodes.unionByName(root.filter("n_convs > 0")), "nodes")

    children = materialize(nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("rank")).agg(F.count("*").alias("n_children")), "children")
    nodes = nodes.join(children, "rank", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    sums = {"leaves_upto": leaf, "saved_upto": saved}
    ordered = placed(nodes, [F.col("rank")], [], "at", "preorder")
    summed = materialize(running(ordered, "at", sums), "sums")
    # up to the node before, and up to the last of the subtree
    begin = summed.withColumns({"_leaves": F.col("leaves_upto") - leaf, "_saved": F.col("saved_upto") - saved})
    at_end = summed.select(F.col("rank").alias("subtree_end"), F.col("leaves_upto").alias("_leaves_end"), F.col("saved_upto").alias("_saved_end"))
    whole = join_by_key(begin.drop("leaves_upto", "saved_upto"), at_end, "subtree_end")
    whole = materialize(whole.withColumns({"n_leaves": F.col("_leaves_end") - F.col("_leaves"), "saved_tokens": F.col("_saved_end") - F.col("_saved")}), "intervals")

    parents = nodes.select(F.col("rank").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = join_by_key(whole, materialize(parents, "parents"), "parent", "left")
    ends = materialize(_digests(ended.select(F.coalesce("last", F.lit(-1)).alias("rank"), "c")), "ends")
    out = named.join(ends, "rank", "left")
    cast = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    return out.select(
        "conv_id", *cast("depth"), "parent_conv_id", *cast("n_convs", "n_children", "n_leaves", "saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("rank").alias("position"), "subtree_end",
    )


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, CAST(k AS INT), 1))::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"

ORACLE = f"""
WITH o AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, left(coalesce(role, ''), {_LEAD}), left(coalesce(text, ''), {_LEAD}), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, turns, c - c % 100 AS base, CAST({_CRC} % 6 AS INT) AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.c = h.base),
p AS (SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns FROM r),
n AS (SELECT turns[:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs,
  string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len(turns)) AS ends FROM p GROUP BY ALL),
k AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.path[d].text) ELSE 0 END AS own FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT m.path[:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) m GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.path = m.path LEFT JOIN m q ON m.d > 0 AND q.path = m.path[:m.d - 1]"""
