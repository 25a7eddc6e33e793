"""Prefix trie of conversations: one row for every distinct sequence of first turns.

Conversations become rows of positional turn-id columns, ``width`` turns to a row, and Spark SQL's ROLLUP
over these columns aggregates the prefixes of all lengths together; grouping_id tells the length. A longer
conversation goes on in further rows, whose key is the node that the row before ended in.

Two such passes are enough. The first gives each node its smallest member. A conversation stays the smallest
of its node from some depth on, so that the second pass can sum over members what is wanted of whole
subtrees: a conversation brings the code points of the turns that it shares with a smaller one, one child
where it is the smallest of the node below, and one leaf where it ends as the smallest of a childless node.

A node's key is the exclusive or of two 64-bit hashes of each (depth, turn id); a turn id is half of the
SHA-256 of role and text. Nothing of a conversation or node is gathered in one row: counts are aggregated
before they are shuffled, and the ids that end in a node are hashed from sorted pieces, one after another.

Defined results: rows without conv_id are left out; null roles and texts are empty; of turns with equal
numbers the smaller turn id stands first, so that repeated rows all count; a conversation without any turn
belongs to the root; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.shared import written

WIDTH = 8  # turns in a row of positional columns
SHARED_TURNS = 5  # the most turns that a conversation takes over
PIECE_IDS = 8_192  # ids in one piece of a node's list
HEAVY_SHARE = 1_000  # a node with more than this part of all nodes below it is broadcast: fewer than so many
NEVER = (1 << 62) - 1


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn's role and text."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, chars: the turns without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(role, text).alias("id"),
        F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "id", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their lengths, turns) where each conversation takes its first h turns from the first of
    its hundred, h = crc32 of its number mod 6; ``turns`` as of ``ordered_turns``."""
    heads = (
        turns.where(f"conv_id % 100 = 0 AND pos <= {SHARED_TURNS}")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("head"))  # five at most
    )
    convs = (
        turns.groupBy("conv_id").agg(F.count("*").alias("own"))
        .withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % 6, "base": F.expr("conv_id - conv_id % 100")})
        .join(heads, "base", "left")
        .withColumn("head", F.expr("coalesce(slice(head, 1, CAST(h AS INT)), array())"))
        .select("conv_id", "h", "head", F.size("head").cast("long").alias("taken"), "own")
        .withColumn("length", F.expr("taken + greatest(own - h, 0)"))
    )
    convs = written(convs, "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", F.expr("pos - h + taken").alias("pos"), "id", "chars")
    taken = convs.select("conv_id", F.explode("head").alias("turn")).select("conv_id", "turn.*")
    return convs.select("conv_id", "length"), own.unionByName(taken)


def _hashed(seed: int, pos: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos, turn)


def positional(convs: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``width`` positional columns: conv_id, length, start (turns before the row), hi and lo (the node
    that the row goes on from), before (code points so far), t1.. (turn ids), n1.. (code points), end_hi and
    end_lo (the node that the conversation ends in, on its last row)."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"hi": _hashed(1, F.col("pos"), F.col("id")), "lo": _hashed(2, F.col("pos"), F.col("id"))}
    rows = turns.withColumns({k: v.alias(k) for k, v in own.items()}).withColumns(
        {"xhi": F.bit_xor("hi").over(upto), "xlo": F.bit_xor("lo").over(upto),
         "before": F.sum("chars").over(upto) - F.col("chars")}
        | {f"t{k}": F.lead("id", k - 1).over(order) for k in range(1, width + 1)}
        | {f"n{k}": F.lead("chars", k - 1, 0).over(order) for k in range(1, width + 1)})
    rows = rows.where(f"(pos - 1) % {width} = 0").select(
        "conv_id", (F.col("pos") - 1).alias("start"), F.col("xhi").bitwiseXOR(F.col("hi")).alias("hi"),
        F.col("xlo").bitwiseXOR(F.col("lo")).alias("lo"), "before",
        *(f"t{k}" for k in range(1, width + 1)), *(f"n{k}" for k in range(1, width + 1)))
    rows = rows.join(convs, "conv_id")
    empty = convs.where("length = 0").select(
        "conv_id", "length", *(F.lit(0).cast("long").alias(c) for c in ("start", "hi", "lo", "before")),
        *(F.lit(None).cast("binary").alias(f"t{k}") for k in range(1, width + 1)),
        *(F.lit(0).cast("long").alias(f"n{k}") for k in range(1, width + 1)))
    last = F.col("length") <= F.col("start") + width
    return rows.unionByName(empty).withColumns(
        {f"end_{c}": F.when(last, _node(c, width)) for c in ("hi", "lo")})


def _node(part: str, width: int) -> Column:
    """Half of a node's key, from the row's key and those turn ids that are not null."""
    key = F.col(part)
    for k in range(1, width + 1):
        key = key.bitwiseXOR(F.when(F.col(f"t{k}").isNotNull(), _hashed(
            1 if part == "hi" else 2, F.col("start") + k, F.col(f"t{k}"))).otherwise(F.lit(0)))
    return key


def _rollup(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """``measures`` of every node: start, hi, lo, t1.. (null behind the node's last turn), level, depth."""
    ids = ", ".join(f"t{k}" for k in range(1, width + 1))
    groups = rows.sparkSession.sql(
        f"SELECT start, hi, lo, {ids}, {width} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{rows}} GROUP BY start, hi, lo, ROLLUP ({ids})", rows=rows)
    # a row's own key is the node that the row before ended in, but for the root
    return groups.where(
        f"CASE WHEN level = 0 THEN start = 0 ELSE element_at(array({ids}), CAST(greatest(level, 1) AS INT)) IS NOT NULL END"
    ).withColumn("depth", F.col("start") + F.col("level"))


def _at_level(names: str, width: int) -> Column:
    return F.element_at(F.array(*(F.col(f"{names}{k}") for k in range(width + 1))), (F.col("level") + 1).cast("int"))


def _with_first(rows: DataFrame, width: int) -> DataFrame:
    """Rows with first (the depth from which the conversation is the smallest of its nodes, or NEVER), leaf (1 if it
    stands for a childless node) and shared (code points of its turns above ``first``)."""
    nodes = _rollup(rows, width, "min(conv_id) AS conv_id, max(length) AS longest")
    smallest = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.max(F.expr("IF(longest = depth, 1L, 0L)")).alias("leaf"))
    of_row = sum((F.when(F.col("start") + k < F.col("first"), F.col(f"n{k}")).otherwise(F.lit(0))
                  for k in range(1, width + 1)), F.lit(0).cast("long"))
    return (
        rows.drop("end_hi", "end_lo").join(smallest, "conv_id", "left")
        .withColumns({"first": F.coalesce("first", F.lit(NEVER)), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
        .withColumn("shared", F.sum(of_row).over(Window.partitionBy("conv_id")))
    )


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """The second pass: sums over members that count whole subtrees."""
    up_to = F.col("before")
    wide = {}
    for k in range(width + 1):
        # code points from depth start + k on that a smaller conversation has as well
        if k > 1:
            up_to = up_to + F.col(f"n{k - 1}")
        above = up_to if k else F.when(F.col("start") == 0, F.lit(0)).otherwise(F.col("before"))
        below = F.col("start") + k + 1
        wide[f"s{k}"] = F.greatest(F.col("shared") - above, F.lit(0).cast("long"))
        wide[f"c{k}"] = F.when((F.col("first") <= below) & (below <= F.col("length")), 1).otherwise(0)
    sums = ", ".join(f"sum(s{k}) AS s{k}, sum(c{k}) AS c{k}" for k in range(width + 1))
    nodes = _rollup(
        rows.select("conv_id", "start", "hi", "lo", *(f"t{k}" for k in range(1, width + 1)), "first", "leaf",
                    *(c.alias(k) for k, c in wide.items())),
        width, f"min(conv_id) AS conv_id, count(*) AS n_convs, min(first) AS first, sum(leaf) AS n_leaves, {sums}")
    ends = F.col("level") == 0
    parents = {}
    for part, seed in (("hi", 1), ("lo", 2)):
        last = F.coalesce(*(F.when(F.col("level") == k, _hashed(seed, F.col("start") + k, F.col(f"t{k}")))
                            for k in range(1, width + 1)), F.lit(0))
        parents[f"up_{part}"] = F.when(~ends, _node(part, width).bitwiseXOR(last))
    return nodes.select(
        "conv_id", "depth", "first", "n_convs", "n_leaves", _node("hi", width).alias("hi"), _node("lo", width).alias("lo"),
        *(v.alias(k) for k, v in parents.items()),
        _at_level("s", width).alias("saved_tokens"), _at_level("c", width).cast("long").alias("n_children"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, conv_id) as comma-joined pieces of bounded length."""
    for batch in batches:
        hi, lo, ids = (batch.column(c).to_numpy() for c in ("hi", "lo", "conv_id"))
        new = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
        cuts = np.unique(np.concatenate([[0], new, np.arange(0, len(ids), PIECE_IDS), [len(ids)]]))
        at = cuts[:-1]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hi[at]), pa.array(lo[at]), pa.array(ids[at]), pa.array(texts, pa.string())],
            names=["hi", "lo", "least", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node from its sorted pieces; holds one state."""
    open_key, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for hi, lo, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
            if (hi, lo) == open_key:
                state.update(b"," + text.encode())
                continue
            if open_key is not None:
                done.append((*open_key, state.hexdigest()))
            open_key, state = (hi, lo), hashlib.sha256(text.encode())
        yield _digest_rows(done)
        done = []
    if open_key is not None:
        yield _digest_rows([(*open_key, state.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    hi, lo, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sha, pa.string())],
        names=["hi", "lo", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes in which conversations end.

    SHA-256 reads its input in order, so a node's ids must pass one task; what passes there is one row for
    thousands of ids, sorted and joined in many tasks before."""
    pieces = (
        rows.where("end_hi IS NOT NULL").select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id")
        .repartitionByRange("hi", "lo", "conv_id")
        .sortWithinPartitions("hi", "lo", "conv_id")
        .mapInArrow(_pieces, "hi long, lo long, least long, ids string")
    )
    return (
        pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "least")
        .mapInArrow(_digests, "hi long, lo long, ends_sha256 string")
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """hi, lo, parent_conv_id of those nodes where a conversation begins to be the smallest, but the root.

    A parent may have any number of such nodes below it: the few with a thousandth of all are broadcast, and
    the rows that found theirs are dealt by their own keys instead."""
    below = nodes.where("depth > 0 AND depth = first").select("hi", "lo", "up_hi", "up_lo")
    above = nodes.where("n_children > 0").select(
        F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("found"), "n_children")
    total = nodes.count()
    heavy = above.where(F.col("n_children") * HEAVY_SHARE > total)  # children are nodes: fewer than HEAVY_SHARE rows
    met = below.join(F.broadcast(heavy.select("up_hi", "up_lo", F.col("found").alias("early"))), ["up_hi", "up_lo"], "left")
    dealt = {f"up_{c}": F.when(F.col("early").isNull(), F.col(f"up_{c}")).otherwise(F.col(c)) for c in ("hi", "lo")}
    light = above.where(F.col("n_children") * HEAVY_SHARE <= total).drop("n_children")
    return met.withColumns(dealt).join(light, ["up_hi", "up_lo"], "left").select(
        "hi", "lo", F.coalesce("early", "found").alias("parent_conv_id"))


def trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of ``turns`` (conv_id, pos, id, chars) of ``convs`` (conv_id, length): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(positional(convs, turns, width), "trie-rows")
    nodes = written(_nodes(_with_first(rows, width), width), "trie-nodes")
    own = F.when(F.col("depth") > F.col("first"), F.col("conv_id"))
    return (
        nodes.join(_parents(nodes), ["hi", "lo"], "left").join(_ends(rows), ["hi", "lo"], "left")
        .select("conv_id", "depth", F.coalesce(own, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
                "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    turns = written(ordered_turns(conversations), "trie-turns")
    return trie(turns.groupBy("conv_id").agg(F.count("*").alias("length")), turns, width)


def rebuilt_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of ``conversations`` whose beginnings are taken from the first of their hundred (``rebuilt``)."""
    return trie(*rebuilt(written(ordered_turns(conversations), "trie-turns")), width)
