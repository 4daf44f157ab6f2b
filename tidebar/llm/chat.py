"""Chat formatting after collapsing cumulative snapshots of logged conversations.

Logging a conversation after each turn leaves conversations that are prefixes of longer ones. A rolling hash of the
turns names each prefix; a conversation whose hash of all turns is a proper prefix hash of another one goes by an
anti-join, and of equal conversations the one with the smallest id stays. What stays is rendered.

The rolling hash is a sum of hashes of (place, role, text), so prefixes are running sums, which are taken in two levels
(blocks of turns, then turns of a block): a conversation that holds a third of all rows is no single task.

Defined results: turns go by (turn, role, text), nulls first, and exactly repeated rows of a conversation count once; a
null role reads ``user``, a null text is empty; rows with a null conv_id are one conversation; an empty table gives no
rows. Rendered text comes in parts of at most ``PART_TURNS`` turns, so that no row is unbounded. Turns of a conversation that
share a turn number, or have none, are ordered in one task. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns rendered in one row, and ranked together in one window.
PART_TURNS = 256
#: The markers of the common chat template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turn_places(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2 ..), role and text; places are counted per block of turn numbers, then added up."""
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / PART_TURNS))
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = rows.withColumn("k", F.row_number().over(inside))
    same = F.col("a.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("a.block").eqNullSafe(F.col("s.block"))
    return (
        own.alias("a")
        .join(starts.alias("s"), same)
        .select("a.conv_id", (F.col("start") + F.col("k")).alias("place"), "a.role", "a.text")
    )


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "role", "text").cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn n_turns of its conversation and the rolling hash up to it: h1 and h2, sums modulo 2**62 of two hashes."""
    part = F.floor((F.col("place") - 1) / PART_TURNS)
    hashed = turns.select("conv_id", "place", part.alias("part"), _hash(1).alias("x1"), _hash(2).alias("x2"))
    running = Window.partitionBy("conv_id", "part").orderBy("place")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sums = hashed.groupBy("conv_id", "part").agg(F.sum("x1").alias("t1"), F.sum("x2").alias("t2"), F.count(F.lit(1)).alias("n"))
    starts = sums.select(
        "conv_id",
        "part",
        F.sum("n").over(whole).alias("n_turns"),
        F.coalesce(F.sum("t1").over(before), F.lit(0)).alias("s1"),
        F.coalesce(F.sum("t2").over(before), F.lit(0)).alias("s2"),
    )
    own = hashed.withColumn("r1", F.sum("x1").over(running)).withColumn("r2", F.sum("x2").over(running))
    modulus = F.lit(1 << 62).cast("decimal(38,0)")
    same = F.col("a.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("a.part") == F.col("s.part"))
    return (
        own.alias("a")
        .join(starts.alias("s"), same)
        .select(
            "a.conv_id",
            "place",
            "n_turns",
            F.pmod(F.col("r1") + F.col("s1"), modulus).cast("long").alias("h1"),
            F.pmod(F.col("r2") + F.col("s2"), modulus).cast("long").alias("h2"),
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another and the first of their equals."""
    rolling = materialize(prefixes(turns), "chat-prefixes")
    whole = rolling.where(F.col("place") == F.col("n_turns"))
    first = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # a prefix that goes on: a proper prefix of some conversation
    longer = rolling.where(F.col("place") < F.col("n_turns")).select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return first.join(longer, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, part (0, 1 ..) and its rendered text, for each maximal conversation."""
    turns = materialize(turn_places(conversations), "chat-turns")
    kept = materialize(maximal_conversations(turns), "chat-kept")
    part = F.floor((F.col("place") - 1) / PART_TURNS)
    said = F.struct("place", render_turn(F.col("role"), F.col("text")).alias("said"))
    # by part as well, so that a long conversation is many keys
    parts = kept.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / PART_TURNS).cast("long"))))
    placed = turns.withColumn("part", part.cast("long"))
    rendered = (
        placed.alias("t")
        .join(parts.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("t.part") == F.col("k.part")))
        .select("t.conv_id", "n_turns", "t.part", said.alias("turn"))
        .groupBy("conv_id", "n_turns", "part")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    text = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    return rendered.select("conv_id", "n_turns", "part", text.alias("text"))
