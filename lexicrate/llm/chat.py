"""Operator 3: formatting of preference pairs.

A chosen and a rejected conversation usually start alike.  The longest common
prefix of their turns is rendered once, as the prompt; what follows in each is a
completion.  A completion's mask holds the character spans that training counts:
the assistant's turns up to their end mark.  Everything is a Catalyst expression
over arrays of turns, one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh_names

END_MARK = "<|end|>"
TURN = "struct<role:string,text:string>"
SPANS = "array<struct<start:int,end:int>>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """All turns as one text."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END_MARK + "\n"))), ""
    )


def mask(turns: Column, role: str = "assistant") -> Column:
    """Character spans of ``role``'s texts with their end marks in ``render(turns)``."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(_header(turn))
        end = start + F.char_length(turn["text"]) + len(END_MARK)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(
            (end + 1).cast("int").alias("at"),
            F.when(turn["role"] == role, F.array_append(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns, from the first on, are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_common, prompt, and text and mask of both completions to ``pairs``.

    ``chosen`` and ``rejected`` are arrays of (role, text); null arrays count as
    empty, null roles and texts as "".  Where one conversation is the start of
    the other its completion is empty, and so is its mask.  All other columns
    pass through, whatever their names, but for columns of the results' names,
    which are replaced.  Rows stay one to one, repeated ones included.
    """
    results = ["n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    clean = lambda c: F.transform(
        F.coalesce(F.col(f"`{c}`"), F.array().cast(f"array<{TURN}>")),
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )
    others = [c for c in pairs.columns if c not in (chosen, rejected, *results)]
    a, b, p = fresh_names([*others, *results], "left_turns", "right_turns", "common_turns")
    others = [F.col(f"`{c}`") for c in others]
    df = pairs.select(*others, clean(chosen).alias(a), clean(rejected).alias(b))
    df = df.withColumn("n_common", common_turns(F.col(a), F.col(b)))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    df = df.select(
        *others, "n_common",
        F.slice(a, F.lit(1), F.col("n_common")).alias(p),
        rest(a).alias(a), rest(b).alias(b),
    )
    return df.select(
        *others, "n_common",
        render(F.col(p)).alias("prompt"),
        render(F.col(a)).alias("chosen"), mask(F.col(a)).alias("chosen_mask"),
        render(F.col(b)).alias("rejected"), mask(F.col(b)).alias("rejected_mask"),
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows (conv_id, turn, role, text).

    Turns of the same number stand in the order of role and text; null counts
    first.  Repeated rows are repeated turns.
    """
    part = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(part)),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
        ).alias("turns")
    )


def swapped_answers(convs: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) whose rejected side ends with another answer.

    The conversation itself is chosen; in the rejected one, the last answer of
    the partner (conv_id with its lowest bit flipped) takes the place of the last
    answer and of all that follows.  Without an answer of the partner, the
    rejected side ends there.
    """
    places = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)),
        lambda i: i.isNotNull(),
    )
    df = convs.withColumn("at", F.coalesce(F.array_max(places), F.size("turns")))
    answers = df.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("partner"),
        F.slice("turns", F.col("at") + 1, 1).alias("answer"),
    )
    return df.join(answers, df.conv_id == answers.partner, "left").select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.concat(
            F.slice("turns", F.lit(1), F.col("at")),
            F.coalesce("answer", F.array().cast(f"array<{TURN}>")),
        ).alias("rejected"),
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = conversations_of(documents(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ","
    ).alias(c)
    return format_preferences(swapped_answers(convs)).select(
        "conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt",
        "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"),
    )


OP3_SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations
), convs as (
  select conv_id, max(i) as n, coalesce(max(case when role = 'assistant' then i end), max(i) + 1) as at
  from turns group by conv_id
), answers as (
  select c.conv_id, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.i = c.at
), rejected as (
  select t.conv_id, t.i, t.role, t.text from turns t join convs c using (conv_id) where t.i < c.at
  union all
  select c.conv_id, c.at, a.role, a.text from convs c join answers a on a.conv_id = xor(c.conv_id, 1)
), unequal as (
  select coalesce(a.conv_id, b.conv_id) as conv_id, min(coalesce(a.i, b.i)) as first
  from turns a full join rejected b on a.conv_id = b.conv_id and a.i = b.i
  where a.role is distinct from b.role or a.text is distinct from b.text
  group by 1
), common as (
  select c.conv_id, coalesce(u.first - 1, c.n) as n_common from convs c left join unequal u using (conv_id)
), pieces as (
  select 'chosen' as side, t.*, n_common from turns t join common using (conv_id)
  union all by name
  select 'rejected' as side, r.*, n_common from rejected r join common using (conv_id)
), rendered as (
  select *, '<|' || role || E'|>\\n' as head, '<|' || role || E'|>\\n' || text || E'<|end|>\\n' as line from pieces
), placed as (
  select *, coalesce(sum(length(line)) over (partition by side, conv_id, i > n_common order by i
                     rows between unbounded preceding and 1 preceding), 0) as before
  from rendered
), sides as (
  select conv_id, side,
         coalesce(string_agg(line, '' order by i) filter (where i <= n_common), '') as prompt,
         coalesce(string_agg(line, '' order by i) filter (where i > n_common), '') as body,
         coalesce(string_agg((before + length(head))::bigint || '-' || (before + length(line) - 1)::bigint, ',' order by i)
                  filter (where i > n_common and role = 'assistant'), '') as spans
  from placed group by conv_id, side
)
select c.conv_id, c.n_common::bigint as n_common, coalesce(a.prompt, '') as prompt,
       coalesce(a.body, '') as chosen, coalesce(a.spans, '') as chosen_mask,
       coalesce(b.body, '') as rejected, coalesce(b.spans, '') as rejected_mask
from common c
left join sides a on a.conv_id = c.conv_id and a.side = 'chosen'
left join sides b on b.conv_id = c.conv_id and b.side = 'rejected'
"""
