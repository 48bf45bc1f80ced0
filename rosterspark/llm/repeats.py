"""Exact search for windows that occur more than once: the Spark rounds shared by the two substring operators.

A *parse* (``substring.parse`` or ``suffix.parse``) gives for a chunk of
documents the name of every window and an *anchor* name: the name of a piece
inside the window that is chosen by the window's content alone.  Equal windows
therefore have equal anchors.

Round 1  counts anchors over all documents (one record per distinct anchor and
         chunk) and returns to each document its anchors that occur elsewhere.
Round 2  names the windows at those anchors only, groups them by (anchor,
         window name) and returns the covered windows of each document as runs.

Both rounds send a name at most once per chunk; copies inside a chunk are
settled in the chunk.  What a bucket finds goes back as one block for each
group of documents (``doc_group``), not as a row for each document; a group's
blocks are read before its documents, which pass one by one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import (
    BLOCK, block_batch, bucket_count, bucket_of, chunks, expand, mix, pack, per_bucket, small, split_by, starts_of, unpack,
    unzip, zip_body,
)

#: Rows from a round: what the documents of a group (values of each) have in some bucket.
FOUND = "grp int, block binary"
CHUNK = 3_000_000  # bytes of text in a chunk


def doc_group(ids, keys, n_groups):
    """The group of each document: its rows and all that is found for it come together there."""
    return bucket_of(mix(ids.view(np.uint64), keys.view(np.uint64)), n_groups)


def _found(ids, keys, doc, vals, n_groups) -> pa.Table:
    """One block per group (documents, how many values each has, the values) from records sorted by document."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    lens, d = np.diff(np.append(first, len(doc))), doc[first]
    rows = [(g, pack(ids[d[at]], keys[d[at]], small(lens[at]), vals[expand(first[at], lens[at])]))
            for g, at in split_by(doc_group(ids[d], keys[d], n_groups), n_groups)]
    return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})


def anchor_blocks(parse, n_buckets, batches):
    """Round 1, map side.  Block: (anchor, document, seen twice here) of the chunk's distinct anchors, and the chunk's own finds."""
    for ids, keys, bodies in chunks(batches, CHUNK):
        doc, anchor = parse(bodies).anchors()
        if len(anchor) == 0:
            continue
        order = np.argsort(anchor, kind="stable")
        doc, anchor = doc[order], anchor[order]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        twice = count > 1
        own = np.repeat(twice, count)
        rep_a, rep_d = anchor[first], doc[first]
        o_doc, o_anchor = doc[own], anchor[own]
        rows = []
        rep_b, own_b = bucket_of(rep_a, n_buckets), o_doc % n_buckets
        own_at = dict(split_by(own_b, n_buckets))
        rep_at = dict(split_by(rep_b, n_buckets))
        for b in sorted({*own_at, *rep_at}):
            r, o = rep_at.get(b, np.zeros(0, int)), own_at.get(b, np.zeros(0, int))
            used, at = np.unique(np.concatenate([rep_d[r], o_doc[o]]), return_inverse=True)
            rows.append((b, pack(ids[used], keys[used], rep_a[r], small(at[:len(r)]), twice[r].astype(np.uint8),
                                 o_anchor[o], small(at[len(r):]))))
        yield block_batch(rows)


def _gather(table: pa.Table):
    """The blocks of a bucket with document numbers running on over the blocks."""
    base, parts = 0, []
    for data in table.column("block").to_pylist():
        p = unpack(data)
        parts.append((base, p))
        base += len(p[0])
    ids = np.concatenate([p[0] for _, p in parts])
    keys = np.concatenate([p[1] for _, p in parts])
    return ids, keys, parts


def anchor_bucket(n_groups, table: pa.Table) -> pa.Table:
    """Round 1, one bucket: the anchors that occur at least twice, for each document that has them."""
    ids, keys, parts = _gather(table)
    anchor = np.concatenate([p[2] for _, p in parts])
    doc = np.concatenate([p[3].astype(np.int64) + base for base, p in parts])
    twice = np.concatenate([p[4] for _, p in parts]) > 0
    own_a = np.concatenate([p[5] for _, p in parts])
    own_d = np.concatenate([p[6].astype(np.int64) + base for base, p in parts])
    order = np.argsort(anchor, kind="stable")
    anchor, doc, twice = anchor[order], doc[order], twice[order]
    same = np.zeros(len(anchor) + 1, bool)
    same[1:-1] = anchor[1:] == anchor[:-1]
    hit = (same[1:] | same[:-1]) & ~twice  # what a chunk saw twice is among its own finds
    doc, anchor = np.concatenate([doc[hit], own_d]), np.concatenate([anchor[hit], own_a])
    order = np.lexsort((anchor, doc))
    doc, anchor = doc[order], anchor[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    return _found(ids, keys, doc[keep], anchor[keep].view(np.int64), n_groups)


LOW = (1 << 32) - 1


def runs_of(doc, start):
    """(doc, lo, hi) of maximal runs of consecutive starts, from records sorted by document and start, without repeats."""
    if len(doc) == 0:
        return doc, start, start
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], start[last] + 1


def doc_ranks(ids, keys):
    """The rank of each document in the order (id, key), repeated rows alike; and a document of each rank."""
    order = np.lexsort((keys, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def by_name(anchor, name):
    """An order that puts equal (anchor, name) together, and where each group of them begins."""
    both = name ^ (anchor * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    a, n = anchor[order], name[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
    return order, np.flatnonzero(new)


def halves(name):
    """The high 48 bits of window names: with the 64 bits of their anchor they tell windows apart."""
    return (name >> np.uint64(32)).astype(np.uint32), ((name >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def _pairs(lo, hi):
    out = np.empty(2 * len(lo), np.int64)
    out[0::2], out[1::2] = lo, hi
    return out


def window_blocks(parse, keep_first, n_buckets, batches):
    """Round 2, map side.  Rows of batches: those of ``with_finds``, the values being anchors found elsewhere.

    Block: the chunk's distinct windows as (name) with runs (document, start,
    length, anchor), flags of windows met twice here, and the windows that the
    chunk itself settles as covered.
    """
    for ids, keys, bodies, cores in _with_cores(batches):
        p = parse(bodies)
        doc, start, anchor, name = p.windows(np.unique(np.concatenate(cores).view(np.uint64)))
        if len(doc) == 0:
            continue
        rank, place = doc_ranks(ids, keys)
        position = (rank[doc] << 32) | start  # a repeated row has the positions of the first one
        order, first = by_name(anchor, name)
        position = position[order]
        least = np.minimum.reduceat(position, first)
        twice = np.maximum.reduceat(position, first) > least
        size = np.diff(np.concatenate([first, [len(order)]]))
        covered = position > np.repeat(least, size) if keep_first else np.repeat(twice, size)
        covered = np.unique(position[covered])
        c_doc, c_lo, c_hi = runs_of(place[covered >> 32], covered & LOW)
        r_doc, r_start, r_anchor, r_name = place[least >> 32], least & LOW, anchor[order[first]], name[order[first]]
        own_at = dict(split_by(c_doc % n_buckets, n_buckets))
        rep_at = dict(split_by(bucket_of(r_anchor, n_buckets), n_buckets))
        rows = []
        for b in sorted({*own_at, *rep_at}):
            r, o = rep_at.get(b, np.zeros(0, int)), own_at.get(b, np.zeros(0, int))
            r = r[np.lexsort((r_start[r], r_doc[r]))]
            cut = np.ones(len(r), bool)
            cut[1:] = (r_doc[r[1:]] != r_doc[r[:-1]]) | (r_start[r[1:]] != r_start[r[:-1]] + 1) | (r_anchor[r[1:]] != r_anchor[r[:-1]])
            at = np.flatnonzero(cut)
            lens = np.diff(np.concatenate([at, [len(r)]]))
            used, where = np.unique(np.concatenate([r_doc[r[at]], c_doc[o]]), return_inverse=True)
            rows.append((b, pack(ids[used], keys[used], *halves(r_name[r]), twice[r].astype(np.uint8), small(where[:len(at)]),
                                 small(r_start[r[at]]), small(lens), r_anchor[r[at]],
                                 small(where[len(at):]), small(c_lo[o]), small(c_hi[o]))))
        yield block_batch(rows)


def _with_cores(batches):
    """Chunks of the documents that have finds; of a repeated row (they come together) only the first."""
    size, part, last = 0, ([], [], [], []), None
    for batch in batches:
        for i, k, body, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if not c.is_valid or (i, k) == last:
                continue
            last, body = (i, k), unzip(body)
            if part[0] and size + len(body) > CHUNK:
                yield np.array(part[0], np.int64), np.array(part[1], np.int64), part[2], part[3]
                size, part = 0, ([], [], [], [])
            for held, x in zip(part, (i, k, body, c.values.to_numpy())):
                held.append(x)
            size += len(body)
    if part[0]:
        yield np.array(part[0], np.int64), np.array(part[1], np.int64), part[2], part[3]


def window_bucket(keep_first, n_groups, table: pa.Table) -> pa.Table:
    """Round 2, one bucket: runs [lo, hi) of covered window starts of each document."""
    ids, keys, parts = _gather(table)
    whole = lambda k, kind=np.int64: np.concatenate([p[k].astype(kind) for _, p in parts])
    of = lambda k: np.concatenate([p[k].astype(np.int64) + base for base, p in parts])
    name = (whole(2, np.uint64) << np.uint64(16)) | whole(3, np.uint64)
    twice = whole(4, bool)
    run_doc, run_start, lens = of(5), whole(6), whole(7)
    anchor = np.repeat(whole(8, np.uint64), lens)
    own = of(9), whole(10), whole(11)
    del parts
    rank, place = doc_ranks(ids, keys)
    position = (np.repeat(rank[run_doc], lens) << 32) | expand(run_start, lens)
    if len(name):
        order, first = by_name(anchor, name)
        del anchor, name
        position, twice = position[order], twice[order]
        size = np.diff(np.concatenate([first, [len(order)]]))
        least = np.minimum.reduceat(position, first)
        if keep_first:
            covered = position > np.repeat(least, size)
        else:
            covered = np.repeat((np.maximum.reduceat(position, first) > least) | ((size > 1) & np.logical_or.reduceat(twice, first)), size)
        position = np.sort(position[covered])
    d, lo, hi = runs_of(place[position >> 32], position & LOW) if len(position) else (position,) * 3
    d, lo, hi = np.concatenate([d, own[0]]), np.concatenate([lo, own[1]]), np.concatenate([hi, own[2]])
    order = np.lexsort((lo, d))
    d, lo, hi = d[order], lo[order], hi[order]
    return _found(ids, keys, np.repeat(d, 2), _pairs(lo, hi), n_groups)


def _merged(blocks):
    """For each document (id, key) of a group's blocks its values, as a place in the second array."""
    parts = [unpack(b) for b in blocks]
    ids, keys, lens, vals = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(4))
    order = np.lexsort((keys, ids))
    vals = vals[expand(starts_of(lens)[:-1][order], lens[order])]
    ids, keys, ends = ids[order], keys[order], starts_of(lens[order])
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    bounds = np.append(ends[new], len(vals)).tolist()
    return dict(zip(zip(ids[new].tolist(), keys[new].tolist()), zip(bounds[:-1], bounds[1:]))), vals


DOC = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("body", pa.binary()), ("vals", pa.list_(pa.int64()))])


def with_finds(batches):
    """Document rows (id, key, compressed body, values or null).  Rows of batches: for each group its blocks, then its documents."""
    group, blocks, found, vals = None, [], {}, None
    for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        docs = []
        for g, i, k, data in zip(*(c.to_pylist() for c in part.columns)):
            if g != group:
                group, blocks, found = g, [], {}
            if i is None:
                blocks.append(data)
                continue
            if blocks:
                (found, vals), blocks = _merged(blocks), []
            at = found.get((i, k))
            docs.append((i, k, data, at and vals[at[0]:at[1]]))
        if docs:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*docs), DOC)], schema=DOC)


def _gathered(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Rows for ``with_finds``, a partition per group: its blocks (no id) sorted before its documents."""
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            packed = [zip_body(b) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([pa.array(doc_group(ids.to_numpy(), keys.to_numpy(), n), pa.int32()), ids, keys, pa.array(packed, pa.binary())],
                                  names=["grp", "id", "key", "data"])
    none = F.lit(None).cast("long")
    return (rows.mapInArrow(run, "grp int, id long, key long, data binary")
            .unionByName(found.select("grp", none.alias("id"), none.alias("key"), F.col("block").alias("data")))
            .repartitionById(n, "grp").sortWithinPartitions("grp", F.col("id").asc_nulls_first(), "key"))


def shared_anchors(rows: DataFrame, parse) -> DataFrame:
    """Round 1: blocks of ``FOUND``, the values of a document being its anchors that occur elsewhere."""
    n = bucket_count(rows.sparkSession)
    return per_bucket(rows.mapInArrow(partial(anchor_blocks, parse, n), BLOCK), partial(anchor_bucket, n), FOUND)


def covered_runs(rows: DataFrame, parse, keep_first: bool) -> DataFrame:
    """Blocks of ``FOUND``: for each document with covered windows, runs [lo, hi) of their starts, as lo, hi, lo, hi, ...

    A window is covered if an equal one starts elsewhere; with ``keep_first``
    only if an equal one starts earlier, in the order (id, key, start).
    """
    n = bucket_count(rows.sparkSession)
    blocks = _gathered(rows, shared_anchors(rows, parse), n).mapInArrow(
        lambda batches: window_blocks(parse, keep_first, n, with_finds(batches)), BLOCK)
    return per_bucket(blocks, partial(window_bucket, keep_first, n), FOUND)


def apply_runs(rows: DataFrame, runs: DataFrame, fn, schema: str) -> DataFrame:
    """Each document row with its runs (null: none) through ``fn(batches)``; bodies arrive compressed."""
    return _gathered(rows, runs, bucket_count(rows.sparkSession)).mapInArrow(lambda batches: fn(with_finds(batches)), schema)


def union_length(runs, window: int):
    """Maximal spans [lo, hi) covered by windows that start in the runs (flat lo, hi, ...)."""
    if runs is None or len(runs) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.asarray(runs[0::2]), np.asarray(runs[1::2]) - 1 + window
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.ones(len(lo), bool)
    cut[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(lo)]]) - 1
    return lo[first], hi[last]
