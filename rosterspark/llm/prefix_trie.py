"""Prefix trie of conversations by vertical bitmaps (operator 11).

A conversation is a sequence of turns (role, text); every distinct prefix is a
node of the trie.  Spark deals conversations to shards of consecutive ids.  A
shard indexes (position, turn) to the bitset of its conversations that have
this turn there.  A depth-first walk starts with all of them: the lowest member
of a node names a posting, the intersection of both bitsets is a child, and the
members that are left name the next.  That is one intersection a node; its
popcount is the members, its lowest bit the smallest of them, and the members
of that length are its end list.

A node is named by a hash of its path, so shards agree on names and a node
that many shards have (a frequent first turn) is one row of each.  Counts are
summed by name, which gives every node its owner: the smallest member.  An
owner's shard knows all nodes above the node, so each shard adds up what its
owned nodes give to the nodes above (leaves, children, saved tokens) from the
deepest up, and these partial sums are summed by name once more.  The hash of
an end list is updated in a stream of the shards' parts, which are in order.

A shard holds at most ``SHARD_TURNS`` turns (16 bytes of hash and a length
each) or one conversation.

Defined cases: a null role or text is empty; turns go by turn (null first),
then role, then the hash of the text; a repeated row is a turn of its own; rows
without conv_id belong to no conversation and are left out; an empty table has
no trie (no rows); further columns are left out.  Turns and paths are compared
by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import bucket_count
from rosterspark.session import materialize, ship_package

SHARD_TURNS = 1 << 16
SHARD_CONVERSATIONS = 1 << 12
HEADS = 6  # the rebuilt head of a conversation has fewer turns than this
NOTHING = hashlib.sha256(b"").hexdigest()

TURNS = "conv_id long, part int, turn long, role string, token binary, length long"
NODES = ("shard long, path binary, parent binary, depth int, n_convs long, first long, length long, "
         "n_ends long, ends binary")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows of ``TURNS``: what orders a turn, a hash of (role, text), code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), token.alias("token"), F.length(text).cast("long").alias("length"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 100 in place of its own first h (part 0), h = crc32(c) % 6.

    Own turns keep part 1; ``skip`` is h.  Every conversation has a row of part -1, so a turnless one is not lost.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "token"]
    first = Window.partitionBy("conv_id").orderBy(*order)
    bases = (turns.filter(F.pmod("conv_id", F.lit(100)) == 0).withColumn("n", F.row_number().over(first))
             .filter(F.col("n") < HEADS).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("n", "role", "token", "length"))).alias("head")))  # at most 5 turns
    skip = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(100)))
    heads = (convs.join(bases, "base", "left")
             .select("conv_id", F.explode(F.concat(
                 F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("n"), F.lit("").alias("role"), F.lit(b"").alias("token"), F.lit(0).cast("long").alias("length"))),
                 F.coalesce(F.transform(F.slice("head", 1, skip), lambda t: F.struct(
                     F.lit(0).alias("part"), t.n.alias("n"), t.role.alias("role"), t.token.alias("token"), t.length.alias("length"))),
                     F.array()))).alias("t"))
             .select("conv_id", "t.part", F.col("t.n").cast("long").alias("turn"), "t.role", "t.token", "t.length"))
    return turns.unionByName(heads).withColumn("skip", skip)


class Shard:
    """Conversations of one shard: ids ascending, the turns of each in a row."""

    def __init__(self, max_turns: int, max_conversations: int):
        self.ids, self.tokens, self.lengths = [], [], []
        self.turns, self.limits = 0, (max_turns, max_conversations)

    def add(self, conv_id: int, tokens: list, lengths: list) -> None:
        self.ids.append(conv_id)
        self.tokens.append(tokens)
        self.lengths.append(lengths)
        self.turns += len(tokens)

    def full(self) -> bool:
        return self.turns >= self.limits[0] or len(self.ids) >= self.limits[1]

    def index(self) -> tuple[list[dict[bytes, int]], dict[int, int]]:
        """(postings by position: turn to bitset of conversations, bitset of the conversations by number of turns)."""
        members: list[dict[bytes, list[int]]] = []
        ends: dict[int, list[int]] = {}
        for k, tokens in enumerate(self.tokens):
            while len(members) < len(tokens):
                members.append({})
            for position, token in enumerate(tokens):
                members[position].setdefault(token, []).append(k)
            ends.setdefault(len(tokens), []).append(k)
        size = len(self.ids)
        return ([{t: bitset(ks, size) for t, ks in at.items()} for at in members], {n: bitset(ks, size) for n, ks in ends.items()})

    def nodes(self):
        """Rows of ``NODES`` by a depth-first walk over the postings."""
        postings, ends = self.index()
        ids, tokens, lengths = self.ids, self.tokens, self.lengths
        shard = ids[0]
        stack = [(b"", b"", 0, (1 << len(ids)) - 1, 0)]
        while stack:
            path, parent, depth, members, length = stack.pop()
            ended = members & ends.get(depth, 0)
            yield (shard, path, parent, depth, members.bit_count(), ids[lowest(members)], length, ended.bit_count(),
                   ",".join([str(ids[k]) for k in bits(ended)]).encode())
            left = members & ~ended
            while left:
                k = lowest(left)
                token = tokens[k][depth]
                child = left & postings[depth][token]
                left ^= child
                stack.append((hashlib.blake2b(path + token, digest_size=16).digest(), path, depth + 1, child, lengths[k][depth]))


def bitset(positions: list[int], size: int) -> int:
    flags = np.zeros(size, np.uint8)
    flags[positions] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def lowest(x: int) -> int:
    return (x & -x).bit_length() - 1


def bits(x: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


def _batches(rows, schema: pa.Schema, size: int = 1 << 13):
    """Record batches of an iterator of tuples."""
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _shards(batches, *limits):
    """Shards of a partition's rows (sorted by conversation, part and order)."""
    shard, conv, tokens, lengths, own = Shard(*limits), None, [], [], 0
    for batch in batches:
        for c, part, token, length, skip in zip(*(col.to_pylist() for col in batch.columns)):
            if c != conv:
                if conv is not None:
                    shard.add(conv, tokens, lengths)
                    if shard.full():
                        yield shard
                        shard = Shard(*limits)
                conv, tokens, lengths, own = c, [], [], 0
            if part == 1:
                own += 1
            if part == 0 or part == 1 and own > skip:
                tokens.append(token)
                lengths.append(length)
    if conv is not None:
        shard.add(conv, tokens, lengths)
        yield shard


def shard_nodes(sequences: DataFrame, max_turns: int = SHARD_TURNS, max_conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """Rows of ``NODES``: the local trie of each shard, from the rows of ``rebuilt``."""
    ship_package(sequences.sparkSession)
    dealt = (sequences.repartitionByRange(bucket_count(sequences.sparkSession), "conv_id")
             .sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "token")
             .select("conv_id", "part", "token", "length", "skip"))

    def run(batches):
        yield from _batches((n for shard in _shards(batches, max_turns, max_conversations) for n in shard.nodes()), _schema(NODES))

    return dealt.mapInArrow(run, NODES)


def end_hashes(nodes: DataFrame) -> DataFrame:
    """(path, ends_sha256) of the nodes at which conversations end; a node's parts come as a stream in order of shards."""
    parts = nodes.filter("n_ends > 0").select("path", "shard", "ends").repartition(bucket_count(nodes.sparkSession), "path")

    def stream(batches):
        path, state = None, None
        for batch in batches:
            for p, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != path:
                    if state is not None:
                        yield path, state.hexdigest()
                    path, state = p, hashlib.sha256(ends)
                else:
                    state.update(b"," + ends)
        if state is not None:
            yield path, state.hexdigest()

    def run(batches):
        yield from _batches(stream(batches), _schema("path binary, ends_sha256 string"))

    return parts.sortWithinPartitions("path", "shard").select("path", "ends").mapInArrow(run, "path binary, ends_sha256 string")


SUMS = "path binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def partial_sums(named: DataFrame) -> DataFrame:
    """Rows of ``SUMS``: what the owned nodes of each shard add to the nodes above them (nodes with n_all, owner, all_ends)."""
    dealt = (named.select("shard", "path", "parent", "depth", "first", "length", "n_all", "owner", "all_ends")
             .repartition(bucket_count(named.sparkSession), "shard").sortWithinPartitions("shard", F.desc("depth")).drop("depth"))

    def shard_sums(rows):
        sums: dict[bytes, list[int]] = {}
        for path, parent, first, length, n, owner, ends in rows:  # deepest first: a node's own sums are whole
            own = owner == first
            children, leaves, saved = sums.pop(path, (0, 0, 0))
            if own:
                saved += (n - 1) * length
                leaves += n == ends
            if path:
                above = sums.setdefault(parent, [0, 0, 0])
                above[0] += own
                above[1] += leaves
                above[2] += saved
            yield path, parent, owner, own, children, leaves, saved

    def shard_rows(rows):
        found = list(shard_sums(rows))
        owners = {r[0]: r[2] for r in found}
        for path, parent, _, own, children, leaves, saved in found:
            yield path, owners[parent] if own and path else None, children, leaves, saved

    def shards(batches):
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(col.to_pylist() for col in batch.columns)):
                if s != shard and rows:
                    yield from shard_rows(rows)
                    rows = []
                shard = s
                rows.append(row)
        yield from shard_rows(rows)

    def run(batches):
        yield from _batches(shards(batches), _schema(SUMS))

    return dealt.mapInArrow(run, SUMS)


def trie(sequences: DataFrame, **limits) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node."""
    nodes = materialize(shard_nodes(sequences, **limits), "trie-nodes")
    whole = nodes.groupBy("path").agg(F.sum("n_convs").alias("n_all"), F.min("first").alias("owner"), F.sum("n_ends").alias("all_ends"),
                                      F.first("depth").alias("depth"))
    sums = partial_sums(nodes.join(whole.drop("depth"), "path")).groupBy("path").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    return whole.join(sums, "path").join(end_hashes(nodes), "path", "left").select(
        F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n_all").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the rebuilt conversations."""
    return trie(rebuilt(turns_of(conversations)))
