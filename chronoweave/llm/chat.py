"""Preference formatting of chosen and rejected conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import read_table

#: Roles whose turns a model is trained to write.
TRAINED = ("assistant",)


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Character spans (start, end) of the rendered turns that count for the loss: a trained turn's text and end mark."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(_rendered(turn))
        start = acc["at"] + F.length(turn["role"]) + 5
        span = F.array(F.struct(start.cast("long").alias("start"), (end - 1).cast("long").alias("end")))
        spans = F.when(turn["role"].isin(*TRAINED), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: the turns that both conversations begin with rendered once, and both completions with masks.

    `pair` names the pair of each turn and `chosen` says on which side the turn is; turns where either is null belong
    to no pair and are left out. Turns are compared by role and text, null as empty text and as role "unknown", in
    order of their number (null first) and, where numbers repeat, of role and text. A side without turns gives an empty
    completion, and two equal conversations an all-prompt row with both completions empty; `usable` tells whether the
    completions differ. A mask holds the character spans of the completion that are trained on.
    """
    row = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    side = lambda flag: F.array_sort(F.collect_list(F.when(chosen == F.lit(flag), row)))
    sides = turns.where(pair.isNotNull() & chosen.isNotNull()).groupBy(pair.alias("pair_id")).agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differ = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("c"))
    cut = sides.withColumn("n_shared", shared).select(
        "pair_id", "n_shared",
        F.slice("c", 1, F.col("n_shared")).alias("p"),
        F.slice("c", F.col("n_shared") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("n_shared") + 1, F.size("r")).alias("r"),
    )
    return cut.select(
        "pair_id", F.col("n_shared").cast("long").alias("n_shared"),
        F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"),
        _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
        (_joined(F.col("c")) != _joined(F.col("r"))).alias("usable"),
    )


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k and 2 k + 1 are the chosen and the rejected side of pair k. Masks are spelled "start-end,..."."""
    turns = read_table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return pairs.withColumns({c: spelled(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def _sql_mask(turns: str) -> str:
    ends = f"list_transform({turns}, lambda t, i: list_sum(list_transform({turns}[1:i], lambda u: length(u.s))))"
    spans = f"list_transform(list_filter(list_zip({turns}, {ends}), lambda z: z[1].role = 'assistant'), lambda z: (z[2] - length(z[1].s) + length(z[1].role) + 5)::bigint || '-' || (z[2] - 1)::bigint)"
    return f"coalesce(array_to_string({spans}, ','), '')"


ORACLE = rf"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as body from conversations where conv_id is not null),
s as (select pair_id, coalesce(list({{'role': role, 's': '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10)}} order by turn nulls first, role, body) filter (side = 0), []) as c,
  coalesce(list({{'role': role, 's': '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10)}} order by turn nulls first, role, body) filter (side = 1), []) as r from t group by 1),
n as (select *, (select count(*) from range(1, least(len(c), len(r)) + 1) k(i) where c[1:i] = r[1:i]) as n_shared from s),
x as (select pair_id, n_shared, c[1:n_shared] as p, c[n_shared + 1:] as c, r[n_shared + 1:] as r from n),
y as (select pair_id, n_shared, len(c) as n_chosen, len(r) as n_rejected, coalesce(array_to_string(list_transform(p, lambda v: v.s), ''), '') as prompt,
  coalesce(array_to_string(list_transform(c, lambda v: v.s), ''), '') as chosen, coalesce(array_to_string(list_transform(r, lambda v: v.s), ''), '') as rejected,
  {_sql_mask("c")} as chosen_mask, {_sql_mask("r")} as rejected_mask from x)
select *, chosen <> rejected as usable from y
"""
