"""Sharding (operator 4) by longest-processing-time scheduling; law ``bytes``: shard sizes near equal.

Rows with equal texts form a group and stay together.  Groups go to the least
loaded shard, largest first, through a heap.  To keep that off one machine, the
heap works on bounded tables: the ``HEAD`` largest groups one by one, the rest
as size classes (64 to each power of two, so at most some 2,600 rows), each
class dealt as the heap would deal groups of its mean size.  Spark ranks the
groups of a class (salted) and joins the ranges that the driver planned.

Defined cases: a null text is empty (size 16).  Repeated rows are a group like
other copies.  Equal sizes are ordered by the md5 of the text; slots within a
shard by (doc_id, crc).  An empty table gives an empty result.  Only doc_id
and text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import NULL_ID, public_id
from rosterspark.llm.packing import numbered
from rosterspark.session import materialize

SHARDS = 40
HEAD = 4096
EXTRA = 16  # bytes counted for a row besides its text


def deal(loads: list[float], n: int, size: float) -> list[int]:
    """How many of n groups of one size each shard gets, when each in turn goes to the least loaded one."""
    got = [0] * len(loads)
    order = sorted(range(len(loads)), key=loads.__getitem__)
    # the level that all shards under it reach
    level, total = loads[order[0]], 0.0
    for k, i in enumerate(order):
        total += loads[i]
        level = (total + n * size) / (k + 1)
        if k + 1 == len(order) or level <= loads[order[k + 1]]:
            break
    for i in order:
        got[i] = max(0, int((level - loads[i]) / size) - 1)
    heap = [(loads[i] + got[i] * size, i) for i in range(len(loads))]
    heapq.heapify(heap)
    for _ in range(n - sum(got)):
        load, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return got


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(g, shard) for a written table of groups (g, total)."""
    spark = groups.sparkSession
    top = groups.orderBy(F.desc("total"), "g").limit(HEAD).collect()  # HEAD rows
    heap, head = [(0, i) for i in range(shards)], []
    for r in top:
        load, i = heap[0]
        head.append((r["g"], i))
        heapq.heapreplace(heap, (load + r["total"], i))
    head = spark.createDataFrame(head, "g string, shard int")
    if len(top) < HEAD:
        return head
    last = top[-1]
    size = F.col("total")
    power = F.floor(F.log2(size)).cast("int")
    rest = (groups.filter((size < last["total"]) | ((size == last["total"]) & (F.col("g") > last["g"])))
            .withColumn("class", (power * 64 + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 64)).cast("int")))
    rest = materialize(rest, "size-classes")
    loads = [0.0] * shards
    for load, i in heap:
        loads[i] = float(load)
    ranges = []
    for r in sorted(rest.groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("s")).collect(),  # bounded: see above
                    key=lambda r: -r["class"]):
        lo = 0
        for i, n in enumerate(deal(loads, r["n"], r["s"] / r["n"])):
            if n:
                ranges.append((r["class"], lo, lo + n, i))
                loads[i] += n * r["s"] / r["n"]
                lo += n
    ranges = spark.createDataFrame(ranges, "class int, lo long, hi long, shard int").alias("q")
    ranked = numbered(rest, ["class"], ["g"], "rank").alias("p")
    placed = ranked.join(F.broadcast(ranges), (F.col("p.class") == F.col("q.class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return head.union(placed.select("g", "shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` (module docstring)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
                                   (F.octet_length(body) + EXTRA).cast("long").alias("size"),
                                   F.crc32(body).alias("text_crc32"), F.md5(body).alias("g")), "rows")
    groups = materialize(rows.groupBy("g").agg(F.sum("size").alias("total")), "groups")
    placed = materialize(rows.join(shard_groups(groups, shards), "g").drop("g"), "placed")
    return (numbered(placed, ["shard"], ["id", "text_crc32"], "slot")
            .select(public_id(), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
