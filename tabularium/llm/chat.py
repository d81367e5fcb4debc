"""Chat formatting: cumulative snapshots of one conversation collapse to the longest, which is rendered.

Each turn's prefix hash is SHA-256 over the hash before it, the role and the text, so that two conversations share
a hash of length k only if their first k turns are equal. A conversation whose full hash is a proper prefix of another
is dropped by an anti-join, and of equal conversations the least ``conv_id`` stays.

Edge cases: turns are ordered by turn, role and text, nulls first; a null role or text is unlike any value and is
rendered as empty; repeated rows are repeated turns. Rows with a null ``conv_id`` are one conversation each and
are dropped, as they can't be told apart. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: How a turn is written.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _marked(c: Column) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, prefixes``: ordered turns and the rolling hash after each."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("t"))
    held = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rolled = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), _marked(t["role"]), F.lit("|"), _marked(t["text"])), 256))),
    )
    return held.withColumn("prefixes", rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of the conversations that no longer one begins with."""
    held = conversations(turns).withColumn("whole", F.element_at("prefixes", -1))
    proper = held.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    first = held.groupBy("whole").agg(F.min("conv_id").alias("conv_id"))
    kept = first.join(proper, "whole", "left_anti").select("conv_id")
    return held.join(kept, "conv_id", "left_semi").select("conv_id", "turns")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, text``: maximal conversations in the chat format."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform("turns", lambda t: F.concat(F.lit(OPEN), blank(t["role"]), F.lit("\n"), blank(t["text"]), F.lit(CLOSE)))
    return maximal(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(lines, "\n").alias("text"))


#: DuckDB: the same conversations found by comparing whole prefixes.
SQL = """
with held as (
  select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn nulls first, role nulls first, text nulls first) as turns
  from conversations where conv_id is not null group by conv_id
), keyed as (
  select conv_id, turns, list_transform(turns, lambda t: {'role': t.role, 'text': t.text}) as said from held
), firsts as (
  select min(conv_id) as conv_id, said from keyed group by said
), prefixes as (
  select distinct list_slice(said, 1, k) as said from (select said, unnest(range(1, len(said))) as k from keyed)
)
select f.conv_id, cast(len(k.turns) as bigint) as n_turns,
  array_to_string(list_transform(k.turns, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>'), chr(10)) as text
from firsts f join keyed k using (conv_id)
where not exists (select 1 from prefixes p where p.said = f.said)
"""
