"""Operator 11: prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of turns; every distinct prefix is a node. All
sequences are cut at half the (rounded) depth. The cut prefixes are named; the
distinct upper parts form the upper trie, and under each named cut the distinct
lower parts form a forest. Both are cut again, all tries of one recursion level
in one job, until parts are single turns: these are the nodes. A node's name is
the hash of the name above its part and of the part, so a shared prefix is one
row after the first cut that separates it, however many conversations hold it.

Totals are grafted level by level: from the smallest forests up, each forest
total is added to the trie above its cut; then, from the largest block down,
each cut gets what hangs below the end of its own forest. That takes as many
rounds as there are recursion levels, not as there are turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ROOT = "root"
NAME = 32   # hex digits of a turn's or a prefix's hash
UNIT = 48   # a turn in a sequence: hash, then the text's UTF-8 bytes in hex
NO_MEMBER = hashlib.sha256().hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the conversations' turns in order, as hash and size, one row each.

    Null role or text is empty. Turns are ordered by ``turn``, null first; rows
    that share a turn by the hash of role and text. Repeated rows are turns of
    their own. Rows of a null conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    unit = F.concat(F.substring(digest, 1, NAME), F.lpad(F.lower(F.hex(F.octet_length(text))), UNIT - NAME, "0"))
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), unit.alias("c"))
    return (conversations.filter("conv_id is not null")
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select("conv_id", F.col("t.c").alias("turns")))


def share_openings(turns: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % every, h = crc32(c) % longest."""
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    heads = turns.select(F.col("conv_id").alias("_c"), F.slice("turns", 1, longest).alias("_head"))
    own = turns.withColumn("_h", opening.cast("int"))
    both = own.join(heads, own.conv_id - own.conv_id % every == heads["_c"], "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def _first(n: int) -> Column:
    return F.substring("seg", 1, n * UNIT)


def _rest(n: int) -> Column:
    return F.expr(f"substring(seg, {n * UNIT + 1})")


def _named(n: int) -> Column:
    """Name of the prefix that ends ``n`` turns into the part."""
    return F.substring(F.sha2(F.concat(F.col("root"), _first(n)), 256), 1, NAME)


def end_names(seqs: DataFrame, half: int) -> DataFrame:
    """``(conv_id, name)``: the node at which each conversation ends; cuts a row by itself."""
    ends = seqs.withColumn("root", F.lit(ROOT))
    while half:
        reaches = F.length("seg") >= half * UNIT
        ends = ends.select("conv_id", F.when(reaches, _named(half)).otherwise(F.col("root")).alias("root"),
                           F.when(reaches, _rest(half)).otherwise(F.col("seg")).alias("seg"))
        half //= 2
    return ends.select("conv_id", F.col("root").alias("name"))


def member_hashes(ends: DataFrame) -> DataFrame:
    """``(name, ends_sha256)``: SHA-256 of the ids that end at a node, ascending, comma-joined.

    A SHA-256 is sequential: a node's ids pass one task, as a sorted stream;
    only ids are moved and none is held.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == name:
                    state.update(b",%d" % conv)
                else:
                    if state:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(b"%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])],
                                             names=["name", "ends_sha256"])

    return (ends.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
            .mapInArrow(fold, "name string, ends_sha256 string"))


def _summed(totals: DataFrame) -> DataFrame:
    return totals.groupBy("name").agg(F.max("chain").alias("chain"), F.sum("saved").alias("saved"),
                                      F.sum("leaves").alias("leaves"))


def _grafted(totals: DataFrame, which: Column, onto: Column) -> DataFrame:
    """Totals with those of the chosen names added to the names ``onto``; their own stay."""
    own = F.struct("name", "chain", "saved", "leaves")
    added = F.struct(onto.alias("name"), F.lit(None).cast("string").alias("chain"), "saved", "leaves")
    return _summed(totals.select(F.inline(F.when(which, F.array(own, added)).otherwise(F.array(own)))))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie over ``turns(conv_id, turns)``, as ``sequences`` returns it.

    Columns name, parent (names), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, text_bytes,
    ends_sha256. A conversation without turns ends at the root. Repeated
    conv_ids are members of their own. An empty table has no node. A
    conversation's turns (48 characters each, whatever the texts) are one row.
    """
    scratch = Scratch(turns.sparkSession)
    seqs = scratch.keep("sequences", turns.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                                                  F.array_join("turns", "").alias("seg")))
    longest = seqs.agg(F.max(F.length("seg"))).first()[0]
    top_half = 1
    while 2 * top_half * UNIT <= (longest or 0):  # a block of 2 * top_half turns is longer than any sequence
        top_half *= 2

    # cut: rows are the distinct parts of one level. A part that fills its block has a tail, the name of the node at
    # its end, and that node's chain: the name at the start of the part that the cut made, then, for each later cut of
    # this part, the name cut in front of the node
    rows = seqs.filter("seg <> ''").groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    rows = rows.select(F.lit(ROOT).alias("root"), F.lit(0).alias("at"), "seg", F.lit(None).cast("string").alias("tail"),
                       F.lit(None).cast("string").alias("chain"), "n", "low")
    levels, half = [], top_half
    while half:
        levels.append(half)
        name, longer, fills = _named(half), F.length("seg") > half * UNIT, F.length("seg") >= half * UNIT
        upper = F.struct("root", "at", _first(half).alias("seg"), F.when(fills, name).alias("tail"),
                         F.when(fills, F.rpad("root", NAME, " ")).alias("chain"), "n", "low")
        lower = F.struct(name.alias("root"), (F.col("at") + half).alias("at"), _rest(half).alias("seg"),
                         "tail", F.concat("chain", name).alias("chain"), "n", "low")
        rows = (rows.select(F.inline(F.when(longer, F.array(upper, lower)).otherwise(F.array(upper))))
                .groupBy("root", "at", "seg").agg(F.max("tail").alias("tail"), F.max("chain").alias("chain"),
                                                  F.sum("n").alias("n"), F.min("low").alias("low")))
        half //= 2
    rows = scratch.keep("parts", rows)

    children = rows.groupBy(F.col("root").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    size = F.conv(F.substring("seg", NAME + 1, UNIT - NAME), 16, 10).cast("bigint")
    nodes = rows.select(F.col("tail").alias("name"), F.col("root").alias("parent"), "chain",
                        (F.col("at") + 1).alias("depth"), F.col("low").alias("conv_id"), F.col("n").alias("n_convs"),
                        size.alias("text_bytes"))
    top = seqs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("chain"),
        F.lit(0).alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("text_bytes"))
    nodes = scratch.keep("nodes", nodes.unionByName(top).join(children, "name", "left").select(
        "*", ((F.col("n_convs") - 1) * F.col("text_bytes")).alias("own_saved"),
        F.col("n_children").isNull().cast("bigint").alias("own_leaf")))
    scratch.drop("parts")

    # graft upward, smallest blocks first: the forest under a cut goes to the name at the start of its block
    below = nodes.select("name", "chain", F.lit(0).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("leaves"))
    below = _summed(below.unionByName(nodes.filter("parent is not null").select(
        F.col("parent").alias("name"), F.lit(None).cast("string").alias("chain"),
        F.col("own_saved").alias("saved"), F.col("own_leaf").alias("leaves"))))
    for i in range(len(levels)):
        below = _grafted(below, F.length("chain") == (i + 1) * NAME, F.rtrim(F.substring("chain", 1, NAME)))
    # and, largest blocks first, what hangs below the end of a part goes to the name at its start
    for i in reversed(range(len(levels))):
        place = F.length("chain") - (i + 1) * NAME + 1
        below = _grafted(below, F.length("chain") > (i + 1) * NAME, F.substring(F.col("chain"), place, F.lit(NAME)))

    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    members = member_hashes(end_names(seqs, top_half))
    out = (nodes.join(parents, "parent", "left").join(below.select("name", "saved", "leaves"), "name", "left").join(members, "name", "left")
           .select("name", "parent", "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id",
                   "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
                   (F.col("own_leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
                   (F.col("own_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "text_bytes",
                   F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256")))
    result = scratch.keep("result", out)
    scratch.close("result")
    return result
