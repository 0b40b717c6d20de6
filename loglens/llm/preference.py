"""Preference formatting: one prompt, two masked completions.

A pair of conversations, one chosen and one rejected, shares its first turns.  The longest common
prefix of turns (same role and same text) is rendered once as the prompt; what follows on each side is
rendered as a completion with the character ranges that a loss may train on (the assistant's turns).

Only DataFrame functions: one shuffle brings the turns of a pair together as two sorted arrays, and
everything else is array work on the row.  A pair holds two conversations, which is as much as its
rendered texts hold anyway.

Defined results: turns are ordered by turn (null last), role and text; exactly repeated rows count once and
rows that differ in anything all count; a null role is ``unknown`` and a null text empty, and they equal
each other in the prefix; turns without a conversation belong to no pair; a conversation without a partner
forms a pair with a null id, no prefix and an empty completion on the other side; equal conversations
have only a prompt; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is written as START, role, MIDDLE, text, END.
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs an even conversation (chosen) with the odd one after it (rejected)."""
    return turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("bigint")).withColumn(
        "chosen", F.pmod(F.col("conv_id"), F.lit(2)) == 0)


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Ranges [start, end) of the trained turns' texts with their end marks, as start:end joined by commas."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("ranges"))

    def step(state, t):
        start = state["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(END)
        mine = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.cast("bigint").alias("at"),
                        F.when(t["role"] == TRAINED_ROLE, F.concat(state["ranges"], F.array(mine)))
                        .otherwise(state["ranges"]).alias("ranges"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["ranges"]), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair from turns with ``pair_id`` and ``chosen`` (boolean) beside the table's columns."""
    rows = turns.where("conv_id is not null and pair_id is not null").select(
        "pair_id", "chosen", F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNull().alias("late"), F.col("turn"),
                 F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("turn"))

    def side(chosen):
        mine = F.col("chosen") == chosen
        return (F.max(F.when(mine, F.col("conv_id"))),
                F.array_sort(F.array_distinct(F.collect_list(F.when(mine, F.col("turn"))))))

    pairs = rows.groupBy("pair_id").agg(side(True)[0].alias("chosen_id"), side(True)[1].alias("c"),
                                        side(False)[0].alias("rejected_id"), side(False)[1].alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differ = F.transform(F.arrays_zip(F.slice("c", 1, least).alias("a"), F.slice("r", 1, least).alias("b")),
                         lambda x: (x["a"]["role"] != x["b"]["role"]) | (x["a"]["text"] != x["b"]["text"]))
    first = F.array_position(differ, True)
    pairs = pairs.withColumn("n_prefix", F.when(first == 0, least.cast("bigint")).otherwise(first - 1))

    def rest(column):
        return F.slice(F.col(column), (F.col("n_prefix") + 1).cast("int"), F.greatest(F.size(column), F.lit(1)))

    pairs = pairs.withColumns({"prefix": F.slice("c", F.lit(1), F.col("n_prefix").cast("int")), "cr": rest("c"), "rr": rest("r")})
    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_prefix", _render(F.col("prefix")).alias("prompt"),
                        _render(F.col("cr")).alias("chosen_completion"), _mask(F.col("cr")).alias("chosen_mask"),
                        _render(F.col("rr")).alias("rejected_completion"), _mask(F.col("rr")).alias("rejected_mask"))


def _sql_side(column: str) -> str:
    head = f"'{START}' || t.role || E'|>\\n'"
    return f"""
      array_to_string(list_transform({column}, lambda t: {head} || t.text || E'{END[:-1]}\\n'), '') AS {{0}}_completion,
      array_to_string(list_filter(list_transform(range(1, len({column}) + 1), lambda i:
        CASE WHEN {column}[i].role = '{TRAINED_ROLE}' THEN
          CAST(CAST(coalesce(list_sum(list_transform({column}[1:i-1], lambda t: length({head}) + length(t.text) + {len(END)})), 0) AS BIGINT)
               + length('{START}' || {column}[i].role || E'|>\\n') AS VARCHAR) || ':' ||
          CAST(CAST(list_sum(list_transform({column}[1:i], lambda t: length({head}) + length(t.text) + {len(END)})) AS BIGINT) AS VARCHAR)
        END), lambda s: s IS NOT NULL), ',') AS {{0}}_mask"""


def oracle() -> str:
    """The same pairs and renderings in DuckDB."""
    turns = "coalesce(list(DISTINCT {{late: turn IS NULL, turn: turn, role: coalesce(role, 'unknown'), text: coalesce(text, '')}}) FILTER (conv_id % 2 = {0}), [])"
    return f"""
    WITH pairs AS (
      SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
             max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id,
             list_sort({turns.format(0)}) AS c, list_sort({turns.format(1)}) AS r
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    cut AS (
      SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1),
                  lambda i: c[i].role != r[i].role OR c[i].text != r[i].text)), least(len(c), len(r)) + 1) - 1 AS n
      FROM pairs),
    parts AS (SELECT *, c[1:n] AS prefix, c[n+1:] AS cr, r[n+1:] AS rr FROM cut)
    SELECT pair_id, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prefix,
      array_to_string(list_transform(prefix, lambda t: '{START}' || t.role || E'|>\\n' || t.text || E'{END[:-1]}\\n'), '') AS prompt,
      {_sql_side('cr').format('chosen')}, {_sql_side('rr').format('rejected')}
    FROM parts"""
