"""Preference formatting: one prompt and two masked completions for each pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Roles whose text (and end mark) a model is trained on; all else in a completion is masked.
TRAINED = ("assistant",)
HEAD, HEAD_END, TAIL = "<|", "|>\n", "<|end|>\n"

ORACLE = f"""
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as p
  from conversations where conv_id is not null),
r as (select *, '{HEAD}' || role || '{HEAD_END[:-1]}' || chr(10) || text || '{TAIL[:-1]}' || chr(10) as shown from t),
o as (select *, sum(length(shown)) over (partition by conv_id order by p) as reach from r),
m as (
  select a.pair_id, a.p from o a join o b on a.pair_id = b.pair_id and a.p = b.p and a.side = 0 and b.side = 1
  and a.role = b.role and a.text = b.text),
k as (
  select pair_id, max(case when p = n then p else 0 end) as shared_turns
  from (select pair_id, p, row_number() over (partition by pair_id order by p) as n from m) group by pair_id),
s as (select o.*, coalesce(shared_turns, 0) as shared_turns from o left join k using (pair_id)),
z as (
  select pair_id, side, any_value(conv_id) as conv_id, any_value(shared_turns)::bigint as shared_turns,
         coalesce(string_agg(shown, '' order by p) filter (p <= shared_turns), '') as prompt,
         coalesce(string_agg(shown, '' order by p) filter (p > shared_turns), '') as completion,
         coalesce(sum(length(shown)) filter (p <= shared_turns), 0) as cut
  from s group by pair_id, side),
f as (
  select s.pair_id, s.side,
         string_agg((reach - length(text) - {len(TAIL)} - cut)::bigint || ':' || (reach - 1 - cut)::bigint, ',' order by p) as spans
  from s join z using (pair_id, side) where p > s.shared_turns and role in ('assistant') group by s.pair_id, s.side)
select coalesce(c.pair_id, d.pair_id) as pair_id, c.conv_id as chosen_id, d.conv_id as rejected_id,
       coalesce(c.shared_turns, d.shared_turns) as shared_turns, case when c.pair_id is null or d.pair_id is null then '' else c.prompt end as prompt,
       c.completion as chosen, case when c.pair_id is not null then coalesce(cf.spans, '') end as chosen_spans,
       d.completion as rejected, case when d.pair_id is not null then coalesce(df.spans, '') end as rejected_spans
from (select * from z where side = 0) c full join (select * from z where side = 1) d on c.pair_id = d.pair_id
left join f cf on cf.pair_id = c.pair_id and cf.side = 0 left join f df on df.pair_id = d.pair_id and df.side = 1
"""


def format_preferences(turns: DataFrame, pair: Column, side: Column, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row for each value of ``pair``; ``side`` is 0 for the chosen and 1 for the rejected conversation.

    ``turns`` has conv_id, turn, role, text. The longest run of leading turns equal in role and text is rendered once
    as ``prompt``; what follows on either side is a completion with the spans (start:end, code points of the
    completion, end exclusive, comma-joined) of trained text: the trained roles' texts with their end marks.

    Only built-in functions; rows are shuffled once, by pair. Turns are ordered by turn, role, text, nulls first, and
    repeated rows are turns of their own. A null role is shown as ``unknown``, a null text as empty. Rows without
    conv_id belong to no conversation and are left out. A pair with one side has no shared turns and nulls for the
    other; two equal conversations have empty completions. An empty table gives no rows; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    order = W.partitionBy("pair_id", "side", "conv_id").orderBy(F.col("turn"), F.col("r0"), F.col("t0"))
    shown = F.concat(F.lit(HEAD), F.col("role"), F.lit(HEAD_END), F.col("text"), F.lit(TAIL))
    rows = (
        turns.where("conv_id is not null")
        .select(
            pair.alias("pair_id"), side.cast("int").alias("side"), "conv_id", "turn", F.col("role").alias("r0"),
            F.col("text").alias("t0"), role.alias("role"), text.alias("text"),
        )
        .repartition("pair_id")
        .withColumn("p", F.row_number().over(order))
        .withColumn("reach", F.sum(F.char_length(shown)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    )

    def of(number: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == number, F.struct("p", "role", "text", "reach"))))

    grouped = rows.groupBy("pair_id").agg(
        of(0).alias("c"),
        of(1).alias("r"),
        F.max(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
    )
    c, r, shared = F.col("c"), F.col("r"), F.col("shared_turns")
    same = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(c), F.size(r))),
        F.lit(0),
        lambda n, i: F.when(
            (n == i)
            & (F.get(c, i)["role"] == F.get(r, i)["role"])
            & (F.get(c, i)["text"] == F.get(r, i)["text"]),
            n + 1,
        ).otherwise(n),
    )

    def show(turns: Column) -> Column:
        return F.array_join(
            F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(HEAD_END), t["text"], F.lit(TAIL))), ""
        )

    def completion(side: Column, present: Column) -> tuple[Column, Column]:
        rest = F.slice(side, shared + 1, F.greatest(F.size(side), F.lit(1)))
        cut = F.coalesce(F.get(side, shared - 1)["reach"], F.lit(0))
        kept = F.filter(rest, lambda t: t["role"].isin(*trained))
        spans = F.transform(
            kept,
            lambda t: F.concat_ws(
                ":",
                (t["reach"] - F.char_length(t["text"]) - len(TAIL) - cut).cast("string"),
                (t["reach"] - 1 - cut).cast("string"),
            ),
        )
        return F.when(present, show(rest)), F.when(present, F.array_join(spans, ","))

    chosen, chosen_spans = completion(c, F.col("chosen_id").isNotNull())
    rejected, rejected_spans = completion(r, F.col("rejected_id").isNotNull())
    return grouped.withColumn("shared_turns", same).select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        shared.cast("long").alias("shared_turns"),
        F.when(shared > 0, show(F.slice(c, F.lit(1), shared))).otherwise("").alias("prompt"),
        chosen.alias("chosen"),
        chosen_spans.alias("chosen_spans"),
        rejected.alias("rejected"),
        rejected_spans.alias("rejected_spans"),
    )
