"""Preference formatting with DataFrame functions only.

The longest prefix of turns that chosen and rejected conversations have in common is
rendered once as the prompt; what follows in each is rendered as its completion, with a
mask of the character spans that are trained on: the assistant's texts with their end
marks.

Defined results: null roles are ``user`` and null texts empty; equal conversations have
empty completions; a null conversation is one without turns; markers inside roles and
texts are broken up by a backslash, and backslashes doubled, so that they cannot be taken
for the format's own and ``unescape`` gives back what was there; turns are ordered by
number, role and text, and repeated rows count once; rows without a conversation id
belong to none; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def conversation_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``turns``, the conversation's turns in order."""
    row = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = turns.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_set(row)).alias("_t"))
    return got.select(id_col, F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(c: Column) -> Column:
    """A text without the mark that begins a turn's head or end."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    """A role that does not end its head either."""
    return F.replace(escape(c), F.lit("|>"), F.lit("|\\>"))


def unescape(c: Column) -> Column:
    """What ``escape`` or ``escape_role`` was given."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit("<|"), escape_role(turn["role"]), F.lit("|>\n"), escape(turn["text"]), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def _mask(turns: Column) -> Column:
    """(start, end) character spans of the rendered turns that are trained on."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(render_turn(t))).alias("at"),
        F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(F.lit(HEAD.format(TRAINED_ROLE)))).alias("start"), (acc["at"] + F.length(render_turn(t)) - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Pairs of turn arrays as ``prompt``, ``chosen``, ``rejected``, their masks and ``prompt_turns``."""
    a, b = (F.coalesce(F.col(c), F.array().cast(_TURNS)) for c in (chosen_col, rejected_col))
    df = pairs.select(*keep, a.alias("_a"), b.alias("_b"))
    differs = F.array_position(F.zip_with("_a", "_b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    df = df.withColumn("_n", F.when(differs > 0, differs - 1).otherwise(F.size("_a")).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.size(c))
    df = df.select(*keep, F.col("_n"), F.slice("_a", F.lit(1), F.col("_n")).alias("_p"), rest("_a").alias("_a"), rest("_b").alias("_b"))
    return df.select(
        *keep, F.col("_n").cast("long").alias("prompt_turns"), _render(F.col("_p")).alias("prompt"),
        _render(F.col("_a")).alias("chosen"), _render(F.col("_b")).alias("rejected"), _mask(F.col("_a")).alias("chosen_mask"), _mask(F.col("_b")).alias("rejected_mask"),
    )


def stale_reply_pairs(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A pair from each conversation: as it is up to the last reply, and with that reply replaced by the one before.

    Without an earlier reply the rejected one is empty; without any reply both are the whole conversation.
    """
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text")))
    df = conversations.withColumn("_r", F.filter(numbered, lambda t: t["role"] == TRAINED_ROLE))
    last, before = F.try_element_at("_r", F.lit(-1)), F.try_element_at("_r", F.lit(-2))
    chosen = F.when(last.isNotNull(), F.slice("turns", F.lit(1), last["i"] + 1)).otherwise(F.col("turns"))
    bad = F.struct(F.lit(TRAINED_ROLE).alias("role"), F.coalesce(before["text"], F.lit("")).alias("text"))
    rejected = F.when(last.isNotNull(), F.concat(F.slice("turns", F.lit(1), last["i"]), F.array(bad))).otherwise(F.col("turns"))
    return df.select(id_col, chosen.alias("chosen"), rejected.alias("rejected"))


def _escape_sql(c: str) -> str:
    return f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"


_TURN_SQL = f"lambda t: '<|' || replace({_escape_sql('t.role')}, '|>', '|\\>') || '|>' || chr(10) || {_escape_sql('t.text')} || '<|end|>' || chr(10)"

ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
r AS (SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS pos FROM c),
p AS (SELECT conv_id,
  CASE WHEN len(pos) > 0 THEN turns[:pos[-1]] ELSE turns END AS a,
  CASE WHEN len(pos) > 0 THEN list_concat(turns[:pos[-1] - 1], [{{'role': 'assistant', 'text': CASE WHEN len(pos) > 1 THEN turns[pos[-2]].text ELSE '' END}}]) ELSE turns END AS b FROM r),
n AS (SELECT conv_id, a, b, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS n FROM p),
s AS (SELECT conv_id, n, list_transform(a[:n], {_TURN_SQL}) AS p,
  list_transform(a[n + 1:], {_TURN_SQL}) AS x,
  list_transform(b[n + 1:], {_TURN_SQL}) AS y, a[n + 1:] AS ta, b[n + 1:] AS tb FROM n),
m AS (SELECT *, list_transform(list_filter(range(1, len(x) + 1), lambda i: ta[i].role = 'assistant'), lambda i: (length(array_to_string(x[:i - 1], '')) + 14) || '-' || (length(array_to_string(x[:i], '')) - 1)) AS mx,
  list_transform(list_filter(range(1, len(y) + 1), lambda i: tb[i].role = 'assistant'), lambda i: (length(array_to_string(y[:i - 1], '')) + 14) || '-' || (length(array_to_string(y[:i], '')) - 1)) AS my FROM s)
SELECT conv_id, CAST(n AS BIGINT) AS prompt_turns, array_to_string(p, '') AS prompt, array_to_string(x, '') AS chosen, array_to_string(y, '') AS rejected,
  array_to_string(mx, ',') AS chosen_mask, array_to_string(my, ',') AS rejected_mask FROM m"""
