"""Preference formatting of conversations (operator 10), native.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows is rendered as two completions in
which only the assistant's turns bear loss. The result has one row for each
rendered turn, so no conversation is ever gathered: the prefix ends at the
least turn that the two sides don't share, a minimum that is aggregated before
the shuffle. ``assembled`` joins the rows of a pair for export.

Defined cases: equal rows of one conversation count once; different rows with
one turn number are one turn, ordered by role and text; rows with a null turn
come last; null roles are rendered as `unknown`, null texts as empty; rows with
a null conversation id are in no pair, and a conversation without partner is
none; if one side is a prefix of the other, its completion has no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The turn number that null turns are sorted as.
LAST = 9223372036854775807


def rendered(role: Column, text: Column) -> Column:
    """A turn between markers; markers inside the text are broken up."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), safe, F.lit("<|end|>\n"))


def paired_by_id(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(
        F.shiftright(conv, 1).alias("pair_id"), (conv.bitwiseAND(1) == 0).alias("chosen"), "turn", "role", "text"
    )


def paired_by_answer(conversations: DataFrame, answerer: str = "assistant") -> DataFrame:
    """Each conversation up to its last answer as chosen, and the same with the next conversation's last answer as rejected.

    A pair is numbered by its conversation; one whose next (by id) has no answer is left
    out. Rows beside the last answer with its turn number but another role belong to both.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn")
    own = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), turn, "role", "text").filter("pair_id is not null")
    last = own.filter(F.col("role") == answerer).groupBy("pair_id").agg(F.max("turn").alias("last"))
    upto = own.join(last, "pair_id").filter("turn <= last")
    answer = (F.col("turn") == F.col("last")) & F.coalesce(F.col("role") == answerer, F.lit(False))
    others = upto.filter(answer).select((F.col("pair_id") - 1).alias("pair_id"), "role", "text").distinct()
    replaced = others.join(last, "pair_id").select("pair_id", F.lit(False).alias("chosen"), F.col("last").alias("turn"), "role", "text")
    sides = upto.withColumn("side", F.explode(F.when(answer, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    kept = sides.join(replaced.select("pair_id").distinct(), "pair_id", "left_semi")
    return kept.select("pair_id", F.col("side").alias("chosen"), "turn", "role", "text").unionByName(replaced)


def preference_turns(turns: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, rendered, loss) from (pair_id, chosen, turn, role, text); part is prompt, chosen or rejected."""
    own = turns.filter(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
    own = own.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)))
    merged = own.groupBy("pair_id", "turn", "role", "text").agg(
        F.max("chosen").alias("in_chosen"), F.max(~F.col("chosen")).alias("in_rejected")
    )
    both = F.col("in_chosen") & F.col("in_rejected")
    pairs = (
        merged.groupBy("pair_id")
        .agg(
            F.min(F.when(~both, F.col("turn"))).alias("first_other"),
            F.max("in_chosen").alias("has_chosen"),
            F.max("in_rejected").alias("has_rejected"),
        )
        .filter("has_chosen and has_rejected")
        .select("pair_id", "first_other")
    )
    in_prompt = F.col("first_other").isNull() | (F.col("turn") < F.col("first_other"))
    parts = F.when(in_prompt, F.array(F.lit("prompt"))).otherwise(
        F.filter(
            F.array(F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")), lambda x: x.isNotNull()
        )
    )
    return merged.join(pairs, "pair_id").select(
        "pair_id",
        F.explode(parts).alias("part"),
        F.nullif(F.col("turn"), F.lit(LAST)).alias("turn"),
        "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~in_prompt & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("loss"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): the last two as arrays of (rendered, loss). Holds one pair's turns in a row."""

    def part(name: str) -> Column:
        turn = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "rendered", "loss")
        found = F.array_sort(F.collect_list(F.when(F.col("part") == name, turn)))
        return F.transform(found, lambda x: F.struct(x["rendered"].alias("rendered"), x["loss"].alias("loss")))

    got = rows.groupBy("pair_id").agg(*[part(x).alias(x) for x in ("prompt", "chosen", "rejected")])
    return got.withColumn("prompt", F.array_join(F.transform("prompt", lambda x: x["rendered"]), ""))
