"""Preference formatting: a shared prompt and two masked completions for each pair of conversations.

The prompt is the longest run of turns, from the start, that chosen and rejected have in common. It
is rendered once; what follows it in either conversation is that side's completion, in which only
the assistant's words count for the loss. Output comes turn by turn, so that no conversation, however
long, is ever gathered in one place: the end of the common run is an aggregate, and turns are dealt
by (pair, part), where a conversation has at most 64 parts, of runs of 16 turns each. Texts are dealt
once: both functions deal in the same way, so that the second finds the turns of the first in place.
A reader concatenates header and body over (pair_id, part, turn, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = ("<|", "|>\n")
FOOTER = "\n"

#: Parts of a conversation, which are bits of a long, and the bits of a turn that stay in one part.
PARTS, RUN_BITS = 64, 4


def _part(turn: Column) -> Column:
    """The part that holds a turn: the same for all turns of a run, and for both sides of a pair."""
    return F.pmod(F.xxhash64(F.shiftright(turn.cast("long"), RUN_BITS)), F.lit(PARTS)).cast("int")


def _parts(part: Column) -> Column:
    """An aggregate: the parts that hold any turns, a bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part)).alias("_parts")


def _with_facts(turns: DataFrame, part: Column, facts: DataFrame) -> DataFrame:
    """Left join of ``facts``, one row per pair, to its turns. Each part in ``_parts`` gets a copy."""
    held = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda x: F.getbit("_parts", x) == 1)
    others = [c for c in facts.columns if c not in ("pair_id", "_parts")]
    copies = facts.select(F.col("pair_id").alias("_pair"), F.explode(held).alias("_at"), *others)
    same = (F.col("pair_id") == F.col("_pair")) & (part == F.col("_at"))
    return turns.join(copies, same, "left").drop("_pair", "_at")


def _turns(side: DataFrame, chosen: bool) -> DataFrame:
    return side.filter("pair_id is not null and turn is not null").select(
        F.col("pair_id").cast("long").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(chosen).alias("_chosen"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per turn of a part: pair_id, part, turn, copy, role, header, body, trained.

    ``part`` is prompt, chosen or rejected. ``trained`` marks bodies of the assistant in a completion;
    headers and everything else are masked. A pair found on one side only has an empty prompt and one
    completion. A null role or text counts as empty; rows with a null pair_id or turn belong to no
    conversation and are left out; rows that repeat pair and turn are separate turns in a fixed order.
    Further columns are not read, and empty tables give no rows.
    """
    both = _turns(chosen, True).unionByName(_turns(rejected, False))
    # Spark leaves this exchange out where both sides are dealt in this way already.
    dealt = both.repartition("pair_id", _part(F.col("turn"))).withColumn("_part", _part(F.col("turn")))
    place = ["pair_id", "_part"]
    # The sides differ at a turn that one of them holds more often than the other.
    more = F.sum(F.when(F.col("_chosen"), 1).otherwise(-1)).alias("_more")
    said = dealt.groupBy(*place, "turn", "role", "text").agg(more)
    ends = said.groupBy("pair_id").agg(
        F.min(F.when(F.col("_more") != 0, F.col("turn"))).alias("_end"), _parts(F.col("_part"))
    )
    same = Window.partitionBy(*place, "_chosen", "turn").orderBy("role", "text")
    marked = _with_facts(dealt.withColumn("copy", F.row_number().over(same)), F.col("_part"), ends)
    common = F.col("_end").isNull() | (F.col("turn") < F.col("_end"))
    part = F.when(common, "prompt").when(F.col("_chosen"), "chosen").otherwise("rejected")
    return marked.filter(F.col("_chosen") | ~common).select(
        "pair_id",
        part.alias("part"),
        "turn",
        "copy",
        "role",
        F.concat(F.lit(HEADER[0]), "role", F.lit(HEADER[1])).alias("header"),
        F.concat("text", F.lit(FOOTER)).alias("body"),
        (~common & (F.col("role") == "assistant")).alias("trained"),
    )


def echoed_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A preference set from plain conversations: chosen as they are up to the last answer, rejected
    with that answer replaced by the words of the conversation's first turn.

    Conversations without an answer are the same on both sides.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter(
        "pair_id is not null and turn is not null"
    )
    part = _part(F.col("turn"))
    # Uses below share the exchanges of turns and facts, as each reads the same columns: an array is not pruned, and
    # openings carry the role.
    facts = rows.groupBy("pair_id").agg(
        F.array(F.min("turn"), F.max(F.when(F.col("role") == "assistant", F.col("turn")))).alias("_ends"),
        _parts(part),
    )
    known = _with_facts(rows, part, facts)
    first, last = F.col("_ends")[0], F.col("_ends")[1]
    words = F.min(F.when(F.col("text").isNotNull(), F.struct("text", "role")))["text"]
    openings = (
        known.filter(F.coalesce(F.col("turn") <= first, F.lit(False)))
        .groupBy(F.col("pair_id").alias("_pair"), _part(last).alias("_at"))
        .agg(words.alias("_opening"))
    )
    chosen = known.filter(last.isNull() | (F.col("turn") <= last))
    answer = (F.col("turn") == last) & (F.col("role") == "assistant")
    same = (F.col("pair_id") == F.col("_pair")) & (part == F.col("_at"))
    rejected = chosen.join(openings, same, "left").withColumn(
        "text", F.when(answer, F.col("_opening")).otherwise(F.col("text"))
    )
    columns = ["pair_id", "turn", "role", "text"]
    return chosen.select(columns), rejected.select(columns)
