"""The prefix trie of conversations against brute force, and its defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rosterspark.llm import prefix_trie
from rosterspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (conv_id, turn, role, text).  {(conv_id, depth): the other columns}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    out = {}

    def sums(path):
        leaves, saved = (0, 0) if children[path] else (1, 0)
        saved += (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        for x in children[path]:
            a, b = sums(x)
            leaves, saved = leaves + a, saved + b
        out[(members[path][0], len(path))] = (
            members[path[:-1]][0] if path else None, len(members[path]), len(children[path]), leaves, saved,
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest())
        return leaves, saved

    if own:
        sums(())
    return out


def found(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def made():
    """Many conversations with common first turns, copies, prefixes of others and missing bases."""
    rnd, rows = random.Random(11), []
    for c in range(0, 420):
        if c in (100, 300):
            continue
        n = rnd.choice([0, 1, 2, 3, 7, 9])
        first = rnd.choice(["hello", "hi", "hello", "hello"])
        turns = [("user" if k % 2 == 0 else "assistant", first if k == 0 else rnd.choice(["yes", "no", "ünd so"])) for k in range(n + 1)]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("limit", [1, 7, 4096])
def test_any_size_of_shard_gives_the_same(spark, made, limit):
    """Shards of one, seven and many conversations, within one partition and over many."""
    sequences = prefix_trie.rebuilt(prefix_trie.turns_of(frame(spark, made)))
    assert found(prefix_trie.trie(sequences, max_conversations=limit)) == brute(made)


def test_shards_in_one_process(made):
    """The walk alone: local tries of small shards hold the same members as one of all."""
    shard = prefix_trie.Shard(100, 100)
    for c, tokens in enumerate([[b"a", b"b"], [b"a"], [], [b"a", b"b"], [b"c", b"b"]]):
        shard.add(c, tokens, [1] * len(tokens))
    rows = {(r[3], r[5]): (r[4], r[7], r[8]) for r in shard.nodes()}
    assert rows == {(0, 0): (5, 1, b"2"), (1, 0): (3, 1, b"1"), (2, 0): (2, 2, b"0,3"), (1, 4): (1, 0, b""), (2, 4): (1, 1, b"4")}


def test_defined_cases(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (7, 3, "user", "a" * 50000), (None, 1, "user", "x"),
            (200, 0, "user", "base"), (200, 1, "user", "base 2"), (207, 5, "user", "own"), (100, 0, None, ""), (-3, 0, "user", "a"), (8, 0, "x:y", "z"),
            (9, 0, "x", "y:z")] + [(50, k, "user", f"turn {k}") for k in range(3000)]
    d = frame(spark, rows)
    for c in ("path", "shard", "token", "skip", "part", "n", "base", "_id", "key", "owner", "first", "ends"):
        d = d.withColumn(c, F.lit("x"))
    got = found(prefix_trie.prefix_trie(d))
    import sys

    sys.setrecursionlimit(10000)
    assert got == brute(rows)
    assert prefix_trie.prefix_trie(d.limit(0)).collect() == []
