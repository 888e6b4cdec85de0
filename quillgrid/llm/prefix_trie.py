"""Conversation prefix trie: what conversations share from their first turn on.

Prefix doubling names turns, and then blocks of 2, 4, 8, ... turns at aligned places, by
dense numbers: a block's name is the rank of the pair of its halves' names among all such
pairs, 0 standing for turns beyond the end. A round for each power of two names them all.
The first d turns are the blocks of d's binary digits, largest first, so their name is
made from a shorter prefix's and one block's, in a round for each further digit. Rows of
one depth and name are a node.

Ranks keep order, so the name of the block that covers the longest conversation orders
whole conversations as a dictionary does. A node's members are then a run of that order,
and its subtree a run of the nodes sorted by first member and depth: sums over subtrees
are differences of running totals, however deep the trie is.

Cases: turns are ordered by turn (null first), then role, then the SHA-256 of role and
text, so repeated rows are turns of their own; null roles and texts are empty; rows
without a conv_id take no part; a conversation whose rebuilt form has no turn belongs to
the root; an empty table gives no node, not even a root; c - c % 100 takes the sign of c
for negative ids, as SQL does; columns beyond the four are not read.

A turn is told by the SHA-256 of role and text, which keeps texts out of every shuffle.
No conversation, turn or node is gathered in one task, but for one thing: the digest of
the ids that end at a node has to be taken in their order. They are packed into runs of
at most RUN ids where they were sorted, and a task streams a node's runs through the
digest, one in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import Folder, in_order, table

#: Conversations of a family, whose first one lends turns; the most turns lent, plus one.
FAMILY, LENT = 100, 6
#: Ids of a packed run.
RUN = 4_096
EMPTY = hashlib.sha256(b"").hexdigest()


def positions(conversations: DataFrame, folder: Folder) -> DataFrame:
    """conv_id, pos (from 0), turn_key and chars of every turn, in the order of its conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)).alias("turn_key"), F.length(text).cast("long").alias("chars"),
    )
    # Repeated rows are told apart by where they were read.
    placed = in_order(turns.withColumn("read", F.monotonically_increasing_id()), ["conv_id", "known", "turn", "role", "turn_key", "read"], folder)
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "turn_key", "chars")


def rebuild(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns, and every conversation with its number of them (n): the first turns of a family's first conversation, then the conversation's own after as many."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    convs = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    lender = own.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(lender, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("lent"), "own")
    kept = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where(F.col("pos") >= F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_key", "chars")
    given = turns.where(F.col("pos") < LENT).withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "lent"), "base").where(F.col("pos") < F.col("lent"))
    sizes = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return kept.unionByName(given.select("conv_id", "pos", "turn_key", "chars")), sizes


def named(rows: DataFrame, keys: tuple[str, ...], ties: tuple[str, ...], folder: Folder) -> DataFrame:
    """rows with name in place of keys: the rank of their keys among all distinct ones, from 1. Rows are sorted by keys, then ties, and counted off, so a key of very many rows spreads over tasks."""
    return in_order(rows, [*keys, *ties], folder, named=keys).drop("at", *[k for k in keys if k != "depth"])


def block_names(turns: DataFrame, longest: int, folder: Folder) -> list[DataFrame]:
    """For each level k conv_id, block, name and chars (of the last turn in it) of the blocks of 2**k turns, up to a level that covers the longest conversation."""
    levels = [named(turns.withColumnRenamed("pos", "block"), ("turn_key",), ("conv_id", "block"), folder)]
    even = F.col("block") % 2 == 0
    for _ in range(max(0, longest - 1).bit_length()):
        of = lambda c, side: F.max(F.when(even if side == 0 else ~even, F.col(c)))
        halves = levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("pair")).agg(
            of("name", 0).alias("left"), F.coalesce(of("name", 1), F.lit(0)).alias("right"), F.coalesce(of("chars", 1), of("chars", 0)).alias("chars")
        )
        levels.append(named(halves.withColumnRenamed("pair", "block"), ("left", "right"), ("conv_id", "block"), folder))
    return levels


def prefix_names(levels: list[DataFrame], sizes: DataFrame, longest: int, folder: Folder) -> DataFrame:
    """conv_id, depth, name and chars of every prefix of one turn or more; names tell prefixes of one depth apart."""
    ends = None
    for k, level in enumerate(levels):  # a depth ends with the block of its lowest digit, which has an even number
        one = level.where(F.col("block") % 2 == 0).select("conv_id", F.shiftleft(F.col("block"), k).alias("rest"), F.shiftleft(F.col("block") + 1, k).alias("depth"), F.col("name").alias("block"), "chars")
        ends = one if ends is None else ends.unionByName(one)
    ends = folder.put(ends.join(sizes, "conv_id").where(F.col("depth") <= F.col("n")).drop("n"))
    digits = F.bit_count("depth")
    made = [ends.where(digits == 1).select("conv_id", "depth", F.col("block").alias("name"), "chars")]
    for d in range(2, longest.bit_length() + 1):
        shorter = made[-1].select("conv_id", F.col("depth").alias("rest"), F.col("name").alias("prefix"))
        made.append(named(ends.where(digits == d).join(shorter, ["conv_id", "rest"]).select("conv_id", "depth", "prefix", "block", "chars"), ("depth", "prefix", "block"), ("conv_id",), folder))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m.select(*out.columns))
    return out


def end_digests(whole: DataFrame) -> DataFrame:
    """first and ends_sha256: of the ids of the conversations that share a whole sequence, by its rank."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        ready: list[tuple[int, int, bytes]] = []

        def close() -> None:
            if ids:
                ready.append((key, ids[0], ",".join(map(str, ids)).encode()))
                ids.clear()

        for b in batches:
            for first, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if first != key or len(ids) == RUN:
                    close()
                    key = first
                ids.append(conv)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ready, strict=True)], ["first", "lowest", "ids"])
                ready.clear()
        close()
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ready, strict=True)], ["first", "lowest", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ready = None, None, []
        for b in batches:
            for first, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if first != key:
                    if state:
                        ready.append((key, state.hexdigest()))
                    key, state = first, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ready, strict=True)], ["first", "ends_sha256"])
                ready.clear()
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["first", "ends_sha256"])

    runs = whole.select("first", "conv_id").repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id").mapInArrow(pack, "first long, lowest long, ids binary")
    return runs.repartition("first").sortWithinPartitions("first", "lowest").mapInArrow(digest, "first long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Every node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folder, kept = Folder(spark, "trie"), Folder(spark, "trie-nodes")
    turns = folder.put(positions(conversations, folder))
    turns, sizes = (folder.put(x) for x in rebuild(turns, conversations))
    longest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    levels = block_names(turns, longest, folder)
    prefixes = folder.put(prefix_names(levels, sizes, longest, folder))
    order = levels[-1].where("block = 0").select("conv_id", F.col("name").alias("whole"))
    whole = folder.put(sizes.join(order, "conv_id", "left").select("conv_id", "n", F.coalesce("whole", F.lit(0)).alias("first")))

    members = prefixes.join(whole.drop("n"), "conv_id").unionByName(whole.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"), "first"))
    nodes = folder.put(members.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("first").alias("first"), F.max("first").alias("last")))

    up = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("up_name"))
    below = nodes.where("depth > 0").join(up, ["conv_id", "depth"], "left").select("conv_id", "depth", (F.col("depth") - 1).alias("up_depth"), F.coalesce("up_name", F.lit(0)).alias("up_name"))
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("name").alias("up_name"), F.col("conv_id").alias("parent_conv_id"))
    below = folder.put(below.join(parents, ["up_depth", "up_name"]).select("conv_id", "depth", "up_depth", "parent_conv_id"))
    children = below.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below.drop("up_depth"), ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = folder.put(in_order(nodes.withColumns({"leaves": F.col("leaf"), "total": F.col("saved")}), ["first", "depth"], folder, ("leaves", "total")))
    upto = nodes.groupBy(F.col("first").alias("last")).agg(F.max("leaves").alias("to_leaves"), F.max("total").alias("to_total"))
    ends = end_digests(whole).join(whole.groupBy("first").agg(F.max("n").alias("depth")), "first")
    out = nodes.join(upto, "last").join(ends, ["first", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("to_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_total") - F.col("total") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = kept.put(out)
    folder.remove()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_prefix_trie: every node of the trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit over eight items for each byte, as DuckDB has no such function.
ORACLE = """
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as pos, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as turn
               from conversations where conv_id is not null),
own as (select conv_id, list(turn order by pos) as turns from turns group by conv_id),
hashed as (select *, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
               lambda a, b: xor(xor(a, b) >> 1, 3988292384::bigint * (xor(a, b) & 1))) as crc from own),
convs as (select conv_id, turns, xor(crc, 4294967295) % 6 as h from hashed),
rebuilt as (select c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) as turns from convs c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
prefixes as (select conv_id, d as depth, turns[:d] as path, len(turns) as n from (select *, unnest(range(len(turns) + 1)) as d from rebuilt)),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, list(conv_id order by conv_id) filter (where n = depth) as ends from prefixes group by path, depth),
children as (select path[:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
full_nodes as (select n.*, coalesce(c.n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(n.path[depth].t) end as saved from nodes n left join children c using (path)),
sums as (select u.path, sum((v.n_children = 0)::int) as n_leaves, sum(v.saved) as saved_tokens from full_nodes v, lateral (select v.path[:d] as path from (select unnest(range(v.depth + 1)) as d)) u group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens,
       sha256(coalesce(array_to_string(n.ends, ','), '')) as ends_sha256
from full_nodes n left join nodes p on n.depth > 0 and p.path = n.path[:n.depth - 1] join sums s on s.path = n.path
"""
