"""Prefix trie of conversations, merged family first.

A conversation c is rebuilt before it is placed: the first h original turns of its base conversation (c - c % 100), then its own
turns after its first h; h = crc32(decimal c) % 6. A node is a distinct sequence of first turns (role, text) of rebuilt
conversations; the root is the empty one.

A family (all conversations of one base) is cogrouped with its base's first turns, rebuilt and made into a small trie; only its
combined nodes are shuffled and merged. What a node gathers from below goes the same way: every node is worth something in
the family of its smallest member only, families add up along their own paths, and the sums of equal nodes are merged.

Nodes are named by their depth and 128 bits: two exclusive sums of hashes of (depth, role, text). Such names can be carried
from one stretch of a conversation to the next, so a family goes to tasks in stretches of ``PART`` turns: no task holds more than
the turns of one family in one stretch, however long a conversation is. The ids that end in a node are joined by families,
then by blocks of families, and the hash of a node's ids takes them block by block.

Defined results: turns go by (turn, role, text), a null turn first, and repeated rows are turns of their own; null role or text
is empty; rows with a null conv_id take no part; a base that is not in the table has no turns; an empty table has no nodes, not
even a root. Turns of one conversation that share a block of turn numbers are numbered in one sort. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join

#: Conversations of a family share conv_id - conv_id % FAMILY; at most HEADS - 1 turns come from the base.
FAMILY, HEADS = 100, 6
#: Depths of a stretch, turn numbers of a block, families whose ids are joined at once.
PART, TURNS, JOINED = 1024, 256, 16
_KEY = ["depth", "p1", "p2"]


def _part(depth: Column) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / PART).cast("long")


def _digest(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, base, place, depth, part, x1, x2, c1, c2, chars) and conversations as (conv_id, base, k, n).

    Place counts the turns of the original, depth those of the rebuilt conversation (null where the base's turns stand
    instead); k turns come from the base, n are there in all.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.floor(F.col("turn") / TURNS).cast("string"), F.lit("")).alias("block"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")),
    )
    ordered = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % HEADS
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    own = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    bases = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    lengths = own.select("conv_id", base.alias("base"), h.alias("h"), "n_own").join(bases, "base", "left")
    lengths = lengths.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).select(
        "conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")
    )
    lengths = materialize(lengths, "trie-lengths")
    starts = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(lengths, "conv_id")
    numbered = turns.select(
        "conv_id", "block", F.row_number().over(ordered).alias("i"), _digest(1, "role", "text").alias("c1"), _digest(2, "role", "text").alias("c2"),
        F.char_length("text").cast("long").alias("chars"),
    )
    placed = numbered.join(starts, ["conv_id", "block"]).withColumn("place", F.col("start") + F.col("i"))
    placed = placed.withColumn("depth", F.when(F.col("place") > F.col("h"), F.col("place") - F.col("h") + F.col("k")))
    placed = placed.select("conv_id", "base", "place", "depth", _part(F.col("depth")).alias("part"), _digest(1, "depth", "c1").alias("x1"), _digest(2, "depth", "c2").alias("x2"), "c1", "c2", "chars")
    return materialize(placed, "trie-turns"), lengths


def openings(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(base, part, conv_id, n, s1, s2, heads) for each stretch of each conversation.

    Heads are the turns taken from the base; s1 and s2 are the names' sums over the conversation's own turns before the stretch.
    """
    first = placed.where((F.col("conv_id") == F.col("base")) & (F.col("place") < HEADS))
    first = first.select("base", "place", _digest(1, "place", "c1").alias("x1"), _digest(2, "place", "c2").alias("x2"), "chars")
    heads = first.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("place", "x1", "x2", "chars"))).alias("heads"))  # HEADS - 1 at most
    stretches = lengths.join(heads, "base", "left").select(
        "conv_id", "base", "n", F.when(F.col("k") > 0, F.slice("heads", 1, F.col("k").cast("int"))).alias("heads"),
        F.explode(F.sequence(F.lit(0).cast("long"), _part(F.col("n")))).alias("part"),
    )
    sums = placed.where(F.col("depth").isNotNull()).groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.bit_xor(f"y{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)]
    return stretches.join(sums, ["conv_id", "part"], "left").select("base", "part", "conv_id", "n", *carried, "heads")


def _column(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind)


def rebuilt(own: pa.Table, opened: pa.Table, part: int) -> dict[str, np.ndarray]:
    """Turns of one family in one stretch by (conversation, depth), each with the name of its node and of the node above.

    ``conv`` numbers the conversations of ``opened``, which are in order of their ids; in the first stretch a root comes first in each.
    """
    ids = _column(opened, "conv_id")
    conv, depth = [np.searchsorted(ids, _column(own, "conv_id"))], [_column(own, "depth")]
    sums, chars = [[_column(own, f"x{i}", np.int64)] for i in (1, 2)], [_column(own, "chars")]
    carry = [_column(opened, f"s{i}") for i in (1, 2)]
    for c, heads in enumerate(opened.column("heads").to_pylist()):
        for head in heads or ():
            if part:
                carry[0][c] ^= head["x1"]
                carry[1][c] ^= head["x2"]
            else:
                for to, value in zip((conv, depth, *sums, chars), (c, head["place"], head["x1"], head["x2"], head["chars"])):
                    to.append(np.array([value], np.int64))
    if not part:
        for to in (*sums, chars, depth):
            to.append(np.zeros(len(ids), np.int64))
        conv.append(np.arange(len(ids)))
    conv, depth, chars = (np.concatenate(v) for v in (conv, depth, chars))
    order = np.lexsort((depth, conv))
    conv, depth, chars = conv[order], depth[order], chars[order]
    new = np.diff(conv, prepend=-1) != 0
    out = {"ids": ids, "conv": conv, "depth": depth, "chars": chars}
    for i in (1, 2):
        running = np.bitwise_xor.accumulate(np.concatenate(sums[i - 1])[order])
        past = np.concatenate([[0], running[:-1]])  # up to the turn before
        opening = past[new][np.cumsum(new) - 1] ^ carry[i - 1][conv]
        out[f"p{i}"], out[f"q{i}"] = running ^ opening, past ^ opening
    return out


_FAMILY = "base long, part long, depth long, p1 long, p2 long, q1 long, q2 long, chars long, members array<long>, ends string"


def family_nodes(key, own: pa.Table, opened: pa.Table) -> pa.Table:
    """The small trie of one family in one stretch: a row for each node with its members, and those that end in it as text."""
    base, part = key[0].as_py(), key[1].as_py()
    opened = opened.sort_by("conv_id")
    t = rebuilt(own, opened, part)
    order = np.lexsort((t["conv"], t["p2"], t["p1"], t["depth"]))
    conv = t["conv"][order]
    names = np.stack([t[c][order] for c in _KEY])
    first = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)])) if len(order) else np.zeros(0, np.int64)
    bounds = np.append(first, len(order))
    ids, ending = t["ids"][conv], _column(opened, "n")[conv] == names[0]
    ends = [None] * len(first)
    for node in np.unique(np.searchsorted(first, np.flatnonzero(ending), side="right") - 1):
        a, b = bounds[node], bounds[node + 1]
        ends[node] = ",".join(map(str, ids[a:b][ending[a:b]].tolist()))
    columns = [pa.array(np.full(len(first), v, np.int64)) for v in (base, part)]
    columns += [pa.array(t[c][order][first]) for c in (*_KEY, "q1", "q2", "chars")]
    columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(ends, pa.string())]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in _FAMILY.split(", ")])


_BELOW = "depth long, p1 long, p2 long, saved long, leaves long"


def family_sums(nodes: pa.Table, worth: pa.Table) -> pa.Table:
    """For each node of one family in one stretch, what its members are worth at its depth and below."""
    known = np.unique(_column(worth, "conv_id"))
    conv, depth = np.searchsorted(known, _column(worth, "conv_id")), _column(worth, "depth")
    order = np.lexsort((depth, conv))
    at = np.stack([conv[order], depth[order]])
    flat = nodes.column("members").combine_chunks()
    sizes = np.diff(np.asarray(flat.offsets))
    member = np.asarray(flat.flatten())
    node_depth = np.repeat(_column(nodes, "depth"), sizes)
    slot = np.minimum(np.searchsorted(known, member), max(len(known) - 1, 0))
    has = known[slot] == member if len(known) else np.zeros(len(member), bool)
    # rows of a member from the node's depth on: places in ``worth`` by (conversation, depth)
    width = int(max(at[1].max(initial=0), node_depth.max(initial=0))) + 2
    line = at[0] * width + at[1]
    begin, end = np.searchsorted(line, slot * width + node_depth), np.searchsorted(line, (slot + 1) * width - 1)
    node = np.repeat(np.arange(nodes.num_rows), sizes)
    found = []
    for name in ("saved", "leaves"):
        running = np.concatenate([[0], np.cumsum(_column(worth, name)[order])])
        total = np.zeros(nodes.num_rows, np.int64)
        np.add.at(total, node[has], (running[end] - running[begin])[has])
        found.append(total)
    some = np.flatnonzero((found[0] != 0) | (found[1] != 0))
    columns = [nodes.column(c).take(pa.array(some)) for c in _KEY] + [pa.array(f[some]) for f in found]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in _BELOW.split(", ")])


def merged_nodes(families: DataFrame) -> DataFrame:
    """The nodes of all families merged: members, smallest member, node above, characters of the last text, children."""
    nodes = families.groupBy(*_KEY).agg(
        F.sum(F.size("members")).alias("n_convs"), F.min(F.col("members")[0]).alias("conv_id"), *(F.max(c).alias(c) for c in ("q1", "q2", "chars"))
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    joined = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    return materialize(joined, "trie-nodes")


def gathered(families: DataFrame, nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """saved and leaves of each node's subtree."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    worth = nodes.select(
        base.alias("base"), _part(F.col("depth")).alias("part"), "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
    )
    # what lies in later stretches of a long conversation counts at the end of each stretch before them
    names = ("saved", "leaves")
    long = lengths.where(F.col("n") > PART).select("conv_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), _part(F.col("n")))).alias("part"))
    totals = worth.groupBy("conv_id", "part").agg(*(F.sum(c).alias(c) for c in names))
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = long.join(totals, ["conv_id", "part"], "left").select("base", "part", "conv_id", ((F.col("part") + 1) * PART + 1).alias("depth"), *(F.sum(c).over(later).alias(c) for c in names))
    worth = worth.unionByName(carried.where(F.col("leaves").isNotNull()))
    sums = families.select("base", "part", *_KEY, "members").groupBy("base", "part").cogroup(worth.groupBy("base", "part")).applyInArrow(family_sums, _BELOW)
    return sums.groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in names))


def ends_digests(families: DataFrame) -> DataFrame:
    """ends_sha256 of each node in which conversations end: families' ids, joined by blocks of families, then taken in order."""
    block = F.floor(F.col("base") / (FAMILY * JOINED)).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",")
    blocks = families.where(F.col("ends").isNotNull()).groupBy(*_KEY, block).agg(ids.alias("ids"))

    def run(batches):
        now, state = None, None

        def row():
            values = [pa.array([v], pa.int64()) for v in now] + [pa.array([state.hexdigest()])]
            return pa.RecordBatch.from_arrays(values, names=[*_KEY, "ends_sha256"])

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in _KEY))
            for name, text in zip(names, batch.column("ids")):
                if name != now:
                    if now is not None:
                        yield row()
                    now, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
        if now is not None:
            yield row()

    dealt = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    placed, lengths = placed_turns(conversations)
    own = placed.where(F.col("depth").isNotNull()).select("base", "part", "conv_id", "depth", "x1", "x2", "chars")
    opened = openings(placed, lengths).groupBy("base", "part")
    families = materialize(own.groupBy("base", "part").cogroup(opened).applyInArrow(family_nodes, _FAMILY), "trie-families")
    nodes = merged_nodes(families)
    whole = nodes.join(gathered(families, nodes, lengths), _KEY, "left").join(ends_digests(families), _KEY, "left")
    # the children of one node may be a third of all nodes: they are split, and its row goes to each part
    above = nodes.where(F.col("n_children") > 0).select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_below"))
    below = spread_join(whole.where("depth > 0"), above, ["q1", "q2", "depth"], "n_below", nodes.count(), F.col("p1"))
    root = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return root.unionByName(below.drop("n_below")).select(
        "conv_id", "depth", "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
